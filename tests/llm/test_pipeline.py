import random

import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from scalewright.llm import quality

from .helpers import components, deduped, prose

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(6)
    said = lambda n, v: "\n".join(prose(rng, 15, v) + " end." for _ in range(n))
    texts = [said(6, 5000) for _ in range(30)]
    texts += [texts[0], texts[1] + "\nOne more line here that is new, quite so.", texts[2].replace("end", "stop", 1)]
    texts += ["short.", "", None, "123 456\n789", "\n".join("Home | News | About | Contact" for _ in range(20)), texts[5], "   "]
    texts += [said(4, 5000) + "\nAll rights reserved." for _ in range(3)]
    rows = [(k, t, "en" if k % 4 else None, "s", len(t or "")) for k, t in enumerate(texts)]
    path = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{path}/documents.parquet")
    return path, rows


def test_stages_equal_brute_force(spark, tables):
    path, rows = tables
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "quality_rules", "line_dedup", "ngram_join", "packing"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    before = {r[0]: r[1] for r in rows}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, path)
        assert docs.columns == list(corpus_pipeline.COLUMNS)
        after = {r.doc_id: r for r in docs.collect()}
        assert all(r.n_chars == len(r.text) for r in after.values())
        if name == "language_id":
            want = {i: t for i, t in before.items() if t and any(c.isalpha() for c in t)}
        elif name == "quality_rules":
            judged = quality.assess(spark.createDataFrame(list(before.items()), "doc_id long, text string")).collect()
            want = {r.doc_id: r.clean_text for r in judged if r.kept}
            assert {i for i, t in before.items() if len(t.split()) >= 60 and "|" not in t} <= set(want)
        elif name == "line_dedup":
            want = {i: t for i, t in deduped(list(before.items())).items() if t and t.split()}
        else:
            want = {i: before[i] for i, _, c in components(list(before.items())) if i == c}
        assert {i: r.text for i, r in after.items()} == want
        before = want
    assert len(before) >= 25
    tokens = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, path).collect()
    assert sum(r.length for r in packed) == sum(len(tokens.encode(t, add_special_tokens=False).ids) + 1 for t in before.values())
    whole = corpus_pipeline.run(spark, path).collect()
    bare = lambda rs: sorted((r.doc_id, r.start, bytes(r.ids)) for r in rs)
    assert bare(whole) == bare(packed)


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_every_operator_is_registered():
    names = list(entry.queries())
    assert [n for n in names if n.startswith("op")] and {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 11)}
    assert "pipeline" in names and set(entry.oracle_sql()) <= set(names)
