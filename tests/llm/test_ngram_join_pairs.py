"""The pairs that the n-gram join tries in a group whose leaders are ill chosen."""

import random

from scalewright.llm import ngram_join, setjoin


def _shingles(text):
    words = text.split()
    return {tuple(words[k : k + 5]) for k in range(len(words) - 4)}


def test_a_group_of_near_copies_is_not_tried_pair_by_pair(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{k}" for k in range(150)]

    def edited(n):
        words = list(base)
        for at in rng.sample(range(150), n):
            words[at] = f"x{rng.randrange(10**6)}"
        return words

    texts = [" ".join(base)]
    for _ in range(40):  # Pairs that hold no words alone, and link with hardly any but the base.
        words = edited(4)
        texts += [" ".join(words), " ".join([*words, "end", f"y{rng.randrange(10**6)}"])]
    texts += [" ".join(edited(3)) for _ in range(400)]
    rng.shuffle(texts)
    tried, real = [], setjoin.linked
    monkeypatch.setattr(setjoin, "linked", lambda sets, pairs, scratch: tried.append(pairs.count()) or real(sets, pairs, scratch))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.component_rows(docs).collect()}
    sets, label = [_shingles(t) for t in texts], list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and label[a] != label[b]:
                low, high = sorted((label[a], label[b]))
                label = [low if x == high else x for x in label]
    assert got == dict(enumerate(label))
    assert sum(tried) < 20 * len(texts), tried
