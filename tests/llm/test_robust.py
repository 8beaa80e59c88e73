"""Names that clash, empty tables, and the ways beyond the limits of broadcasts, for all operators."""

import random

import public_tokenizers as P
import pytest

from scalewright.llm import byte_bpe, common, html_text, language_id, licenses, line_dedup, merkle, ngram_join, packing, quality, setjoin, warc
from scalewright.llm.common import shared_dir

from .helpers import components, corpus, deduped, frame, key, prose

CLASHES = ["_doc", "_key", "_text", "_words", "_lines", "_seq", "_hits", "_in0", "_id", "_out", "node", "NODE2", "N_LINES", "LANG_PRED", "Score", "Sentence_IDs", "RULES", "KEPT", "Decoded", "part", "token", "first", "lines", "again", "repeats", "text_key", "host", "payload"]


def archived(df):
    path = shared_dir(df.sparkSession)
    warc.write_archive(df, f"{path}/a", id_col="doc_id", html_col="text")
    warc.export_files(df.sparkSession, f"{path}/a", f"{path}/f")
    return warc.read_records(warc.import_files(df.sparkSession, f"{path}/f"))


OPERATORS = {
    "line_dedup": line_dedup.dedup,
    "byte_bpe": lambda df: byte_bpe.decode(byte_bpe.encode(df, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN).selectExpr("*", "1 AS DECODED", "2 AS _out"), P.path("byte_bpe_multi_50k.tiktoken")),
    "quality": quality.assess,
    "ngram_join": ngram_join.component_rows,
    "keep_one": ngram_join.keep_one,
    "merkle": merkle.fingerprints,
    "language_id": lambda df: language_id.predict(df, language_id.train(df)),
    "warc": archived,
    "licenses": licenses.scan,
    "html_text": lambda df: html_text.extract(df, id_col="doc_id", html_col="text"),
    "packing": lambda df: packing.pack(df, P.path("word_bpe_49k.json")),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_clashing_names(spark, name):
    rows = [(1, "Some words of a text here.", "en", "u"), (2, None, None, None), (None, "", "en", "u"), (1, "Some words of a text here.", "en", "u"), (3, "x " * 3000, "en", "v")]
    df = frame(spark, rows, "doc_id long, text string, lang string, url string").selectExpr("*", *(f"{k} AS `{c}`" for k, c in enumerate(CLASHES)))
    got = OPERATORS[name](df)
    folded = [c.lower() for c in got.columns]
    assert len(folded) == len(set(folded))
    got.write.parquet(f"{shared_dir(spark)}/{name}")
    assert got.count() >= 3
    plain = OPERATORS[name](df.select("doc_id", "text", "lang", "url"))
    mine = sorted(repr([r[c] for c in plain.columns if c != "sequence_id"]) for r in got.collect())
    assert mine == sorted(repr([r[c] for c in plain.columns if c != "sequence_id"]) for r in plain.collect())
    for c in CLASHES:
        if c in got.columns and name in ("line_dedup", "quality", "language_id", "licenses"):
            assert {r[c] for r in got.select(f"`{c}`").collect()} == {CLASHES.index(c)}
    assert OPERATORS[name](df.limit(0)).count() == 0


def test_beyond_all_limits(spark, monkeypatch):
    rows = list({i: (i, t) for i, t in corpus(5) if i is not None}.values())
    monkeypatch.setattr(common, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(setjoin, "HUB", 2)
    monkeypatch.setattr(setjoin, "LEADERS", 1)
    monkeypatch.setattr(setjoin, "HELD", 64)
    got = sorted(key((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_join.component_rows(frame(spark, rows)).collect())
    assert got == sorted(map(key, components(rows)))
    assert {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, rows)).collect()} == deduped(rows)


@pytest.mark.parametrize("hot", [1, 20])
def test_sets_with_a_common_passage(spark, monkeypatch, hot):
    """Passages that fill most of a text, near the bound on either side; frequent tokens counted or not."""
    monkeypatch.setattr(setjoin, "HOT", hot)
    rng = random.Random(21)
    passage = prose(rng, 60, 10**6)
    texts = [f"{prose(rng, rng.randrange(3, 22), 10**6)} {passage} {prose(rng, rng.randrange(1, 9), 10**6)}" for _ in range(60)]
    texts += [t.replace("w1", "v1", rng.randrange(3)) for t in texts[:25]] + [passage, passage + " and more"]
    rows = [(900 - k, t) for k, t in enumerate(texts)]
    got = sorted(key((r.doc_id, r.n_shingles, r.component_id)) for r in ngram_join.component_rows(frame(spark, rows)).collect())
    assert got == sorted(map(key, components(rows)))
    lines = [(k, "\n".join(texts[k::9])) for k in range(9)]
    assert {r.doc_id: r.text for r in line_dedup.dedup(frame(spark, lines)).collect()} == deduped(lines)
