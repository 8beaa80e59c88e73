"""Small tables with the awkward cases, and plain versions of what the operators compute."""

import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def prose(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}" + ("." if rng.random() < 0.15 else "") for _ in range(n))


def corpus(seed=1):
    """(doc_id, text) with copies, near copies, shared lines, empty, null and long texts, and repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.choice((3, 5, 20, 60, 200))) + "." for _ in range(25)]
    texts += ["\n".join(prose(rng, 12) + "." for _ in range(6)) for _ in range(10)]
    base = [prose(rng, 120) for _ in range(3)]
    for b in base:
        words = b.split()
        for k in range(6):
            edited = list(words)
            for _ in range(k % 3):
                edited[rng.randrange(len(edited))] = f"x{rng.randrange(999)}"
            texts.append(" ".join(edited))
    common = "This very line stands in many documents of the corpus again."
    texts += [f"{prose(rng, 30)}.\n{common}\n{prose(rng, 30)}." for _ in range(8)]
    texts += [texts[0], texts[0], "", None, "   \n\t ", "one", "one", "ONE", "one two three four", "a b c d e", "a b c d e f", "é ü ß 的 word", prose(rng, 5000)]
    rows = [(i * 3, t) for i, t in enumerate(texts)]
    rng.shuffle(rows)
    return rows + [rows[0], (None, "a null id with some words here"), (None, None)]


def shingles(text):
    w = WORD.findall((text or "").translate(_LOW))
    if len(w) < 5:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def linked_pairs(sets):
    index = defaultdict(list)
    for i, s in enumerate(sets):
        for t in s:
            index[t].append(i)
    both = defaultdict(int)
    for members in index.values():
        for x in range(len(members)):
            for y in range(x):
                both[members[y], members[x]] += 1
    return [(a, b) for (a, b), n in both.items() if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n)]


def components(rows):
    """(doc_id, size, smallest id reachable) of each row."""
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked_pairs(sets):
        up[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return [(i, len(s), least.get(root(k)) if s else i) for k, ((i, _), s) in enumerate(zip(rows, sets, strict=True))]


def key(row):
    return tuple((x is None, x if x is not None else 0) for x in row)


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def deduped(rows):
    """Texts of (id, text) rows of distinct ids without lines that match an earlier one."""
    lines = [(i, n, line) for i, t in sorted(rows) for n, line in enumerate((t or "").split("\n"))]
    sets = [shingles(line) for _, _, line in lines]
    first = {}
    gone = set()
    for k, s in enumerate(sets):
        if s in first:
            gone.add(k)
        elif s:
            first[s] = k
    kept = list(first.values())
    for a, b in linked_pairs([sets[k] for k in kept]):
        gone.add(max(kept[a], kept[b]))
    out = defaultdict(list)
    for k, (i, _, line) in enumerate(lines):
        if k not in gone:
            out[i].append(line)
    return {i: None if t is None else "\n".join(out[i]) for i, t in rows}
