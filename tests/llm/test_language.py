import math
import random
import unicodedata
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from pyspark.sql import functions as F

from scalewright.llm import language_id as L

WORDS = {"en": "the and ing tion with that for", "fr": "les eau que ment dans être avec", "de": "der und sch ich ung mit ßen"}


def table(n=150):
    rng = random.Random(5)
    return [(i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(20)), lang) for i in range(n) for lang in [rng.choice(list(WORDS))]]


def test_held_out_rows(spark):
    df = spark.createDataFrame(table(), "doc_id long, text string, lang string")
    model = L.train(df)
    assert model.langs == ("de", "en", "fr") and model.table.shape == (L.BUCKETS, 3)
    got = L.predict(df, model).withColumn("held_out", L.held_out(F.col("doc_id"))).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got)
    held = [r for r in got if r.held_out]
    assert held and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in got)


def test_labels_of_held_out_rows_are_not_learned(spark):
    rows = [(i, t, "xx" if zlib.crc32(str(i).encode()) % 3 == 1 else lang) for i, t, lang in table()]
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert "xx" not in model.langs


def test_awkward_rows(spark):
    schema = "doc_id long, text string, lang string, lang_pred int, score string"
    rows = [(i, t, lang, 1, "s") for i, t, lang in table(60)] + [(1000, None, "en", 1, None), (1001, "", "en", None, None), (1002, "12 !? \n", None, None, None), (None, "the and the", "en", 0, None), (1003, "the and " * 20000, None, 0, None)]
    df = spark.createDataFrame(rows, schema)
    got = {r.doc_id: r for r in L.predict(df, L.train(df)).collect()}
    assert all(got[k].lang_pred == L.UNKNOWN and got[k].score == 0 for k in (1000, 1001, 1002))
    assert got[None].lang_pred == "en" and got[1003].lang_pred == "en"
    none = df.limit(0)
    assert L.train(none).langs == () and L.predict(none, L.train(none)).count() == 0
    assert {r.lang_pred for r in L.predict(df, L.train(none)).collect()} == {L.UNKNOWN}


def plain_buckets(text):
    """Buckets of the framed text's n-grams, one after another."""
    points = [ord(c) for c in f" {text.lower()} "]
    out, mask = [], (1 << 64) - 1
    for n in L.SIZES:
        for at in range(len(points) - n + 1):
            h = sum(points[at + k] * (int(L._SALT[k]) | 1) for k in range(n)) + int(L._SALT[8 + n]) & mask
            for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
                h = (h ^ h >> shift) * factor & mask
            out.append((h ^ h >> 31) % L.BUCKETS)
    return out


@pytest.mark.parametrize("block", [7, 1000])
def test_scores_equal_plain_naive_bayes(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK_CHARS", block)
    rows = table(60)
    model = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    counts, seen = defaultdict(Counter), Counter()
    for i, t, lang in rows:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            counts[lang].update(plain_buckets(t))
            seen[lang] += 1
    texts = [t for _, t, _ in rows[:20]] + ["the", "é", "Straße 的", "a\nb"]
    langs, sure = L.scores(model, texts)
    for text, lang, score in zip(texts, langs, sure, strict=True):
        logs = {}
        for x, c in counts.items():
            total = sum(c.values()) + 0.5 * L.BUCKETS
            logs[x] = math.log(seen[x] / sum(seen.values())) + sum(math.log((c[g] + 0.5) / total) for g in plain_buckets(text))
        best = max(sorted(logs), key=logs.get)
        assert lang == best and abs(score - 1 / sum(math.exp(v - logs[best]) for v in logs.values())) < 1e-9


def test_texts_without_a_letter_are_undetermined(spark):
    model = L.train(spark.createDataFrame(table(60), "doc_id long, text string, lang string"))
    signs = [c for c in map(chr, range(0x3100)) if not unicodedata.category(c).startswith("L") and unicodedata.category(c) != "Cs"]
    assert set(L.scores(model, ["½ ²", "Ⅷ ① 12", "_", "".join(signs), *signs[:500]])[0]) == {L.UNKNOWN}
    letters = [c for c in map(chr, range(0x3100)) if unicodedata.category(c).startswith("L")]
    assert L.UNKNOWN not in L.scores(model, letters[::9])[0]


def test_columns_of_any_name(spark):
    df = spark.createDataFrame(table(30), "doc_id long, text string, lang string").selectExpr("*", "1 AS LANG_PRED", "2 AS Score", "3 AS _lang", "4 AS _in0")
    got = L.predict(df, L.train(df))
    assert got.columns == ["doc_id", "text", "lang", "_lang", "_in0", "lang_pred", "score"]
    assert {(r["_lang"], r["_in0"]) for r in got.collect()} == {(3, 4)} and np.isfinite([r.score for r in got.collect()]).all()
