import random

import numpy as np
import pytest

from scalewright.llm import line_dedup, ngram_join, setjoin

from .helpers import components, corpus, deduped, frame, key, prose, shingles


def rows_of(df):
    return sorted(key((r.doc_id, r.n_shingles, r.component_id)) for r in df.collect())


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    rows = corpus(seed)
    df = frame(spark, rows).selectExpr("*", "'x' AS node", "1 AS token")
    assert rows_of(ngram_join.component_rows(df)) == sorted(map(key, components(rows)))


def chain(n=30):
    """Each text differs from the next in one word: a component without a centre."""
    rng = random.Random(4)
    words = prose(rng, 80, 10**6).split()
    out = []
    for k in range(n):
        words[(k * 7) % 80] = f"changed{k}"
        out.append((1000 - k, " ".join(words)))
    return out


def test_chains_and_large_groups_are_whole(spark, monkeypatch):
    rng = random.Random(8)
    base = prose(rng, 100, 10**6).split()
    group = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.randrange(4)):
            words[rng.randrange(100)] = f"y{rng.randrange(10**6)}"
        group.append((5000 + k, " ".join(words)))
    rows = chain() + group + [(9000, None), (9001, "")]
    monkeypatch.setattr(setjoin, "HUB", 10)
    assert rows_of(ngram_join.component_rows(frame(spark, rows))) == sorted(map(key, components(rows)))


def test_frequent_tokens_come_last():
    counts = np.full(setjoin.COUNTERS, 50)
    counts[5], counts[6] = 5000, 50000
    table = setjoin.classes(counts)
    assert table[0] == 0 and 0 < table[5] < table[6]


def test_without_links_or_rows(spark):
    assert ngram_join.component_rows(frame(spark, [])).count() == 0
    got = ngram_join.component_rows(frame(spark, [(1, "a b c d e f"), (2, "g h i j k l"), (3, None)])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == [(1, 2, 1), (2, 2, 2), (3, 0, 3)]


def test_one_of_each_group_stays(spark):
    rows = [r for r in dict.fromkeys(corpus()) if r[0] is not None]
    want = sorted(i for i, _, c in components(rows) if i == c)
    assert sorted(r.doc_id for r in ngram_join.keep_one(frame(spark, rows)).collect()) == want
    twice = ngram_join.keep_one(frame(spark, [(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f")])).collect()
    assert [r.doc_id for r in twice] == [1]


def test_sets_equal_plain_ones():
    rows = [t for _, t in corpus() if t is not None]
    data = "".join(t + "\n" for t in rows).encode()
    offsets = np.cumsum([0] + [len((t + "\n").encode()) for t in rows])
    s = setjoin.token_sets(np.frombuffer(data, np.uint8), offsets, False)
    sizes = dict(zip(s.row.tolist(), s.size.tolist(), strict=True))
    assert [sizes.get(k, 0) for k in range(len(rows))] == [len(shingles(t)) for t in rows]
    same = {}
    for k, n in zip(s.row.tolist(), s.node.tolist(), strict=True):
        assert same.setdefault(shingles(rows[k]), n) == n
    assert len(set(same.values())) == len(same)


@pytest.mark.parametrize("seed", [1, 3])
def test_lines_equal_brute_force(spark, seed):
    rows = list({i: (i, t) for i, t in corpus(seed) if i is not None}.values()) + chain()
    got = line_dedup.dedup(frame(spark, rows).selectExpr("*", "'x' AS n_lines", "7 AS line")).collect()
    want = deduped(rows)
    assert {r.doc_id: r.text for r in got} == want and {r.line for r in got} == {7}
    for r in got:
        before = dict(rows)[r.doc_id]
        assert r.n_lines == (0 if before is None else before.count("\n") + 1)


def test_awkward_lines(spark):
    assert line_dedup.dedup(frame(spark, [])).count() == 0
    got = line_dedup.dedup(frame(spark, [(None, "a b\nc"), (1, "a b\n\nd"), (1, "a b\n\nd"), (2, None)])).collect()
    assert sorted((repr(r.doc_id), r.text, r.n_removed) for r in got if r.text is not None) == [("1", "", 2), ("1", "a b\n\nd", 0), ("None", "c", 1)]


def test_keep_one_judges_rows_not_ids(spark):
    rng = random.Random(8)
    a, b, c, d = (prose(rng, 60, 5000) for _ in range(4))
    rows = [(1, a), (5, a), (5, b), (5, b), (None, a), (None, c), (None, c + " more"), (None, c), (None, d), (7, c.upper() + " x"), (None, ""), (None, ""), (8, ""), (8, ""), (8, None)]
    got = [(r.doc_id, r.text) for r in ngram_join.keep_one(frame(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted([(1, a), (5, b), (7, c.upper() + " x"), (None, d), (None, ""), (None, ""), (8, ""), (8, None)], key=repr)
    lost = [(None, c), (None, c), (None, c + " more"), (2, d)]
    got = [(r.doc_id, r.text) for r in ngram_join.keep_one(frame(spark, lost)).collect()]
    assert len(got) == 2 and (2, d) in got and got[0] != got[1] and {i for i, _ in got} == {None, 2}


def test_links_beside_a_leader_of_other_length(spark):
    rng = random.Random(12)
    one = prose(rng, 40, 10**6)
    two = one.rsplit(" ", 1)[0] + " changed"
    for k in range(99):
        long = f"{prose(rng, 300, 10**6)} {k} {one} {prose(rng, 300, 10**6)} {two} {k}"
        data = [f"{t}\n".encode() for t in (long, one, two)]
        nodes = setjoin.token_sets(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]), False).node
        if nodes[0] == min(nodes):
            break
    rows = [(1, long), (2, one), (3, two)]
    assert rows_of(ngram_join.component_rows(frame(spark, rows))) == sorted(map(key, components(rows)))
    assert {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, rows)).collect()} == deduped(rows)
    assert components(rows)[2][2] == 2 and deduped(rows)[3] == ""
