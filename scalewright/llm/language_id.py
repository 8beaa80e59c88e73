"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T
from pyspark.sql import functions as F

from .common import bare, bound_batches, column_at, mix, stream, trimmed

SIZES = (1, 2, 3)
BUCKETS = 1 << 15
#: Characters whose n-grams are looked up together.
BLOCK_CHARS = 1 << 16
UNKNOWN = "und"
_SALT = stream(3, 16)
_LATIN = re.compile("[A-Za-z]")


def has_letter(text: str) -> bool:
    """Whether a character of the Unicode categories L occurs."""
    return bool(_LATIN.search(text)) or any(map(str.isalpha, text))


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text, bucket) of all character n-grams of texts in lower case, each framed by one space, block by block.

    A block takes in the characters behind it that its last n-grams reach, so none is lost
    at a seam.
    """
    framed = [f" {t.lower()} ".encode("utf-32-le", "surrogatepass") for t in texts]
    ends = np.cumsum([len(f) // 4 for f in framed])
    points = np.frombuffer(b"".join(framed), dtype=np.uint32)
    for a in range(0, len(points), BLOCK_CHARS):
        b = min(a + BLOCK_CHARS, len(points))
        here = points[a : b + SIZES[-1] - 1].astype(np.uint64)
        text = np.searchsorted(ends, np.arange(a, b), "right")
        left = ends[text] - np.arange(a, b)
        for n in SIZES:
            h = np.zeros(max(min(b - a, len(here) - n + 1), 0), np.uint64)
            for k in range(n):
                h += here[k : k + len(h)] * (_SALT[k] | np.uint64(1))
            whole = left[: len(h)] >= n
            yield text[: len(h)][whole], (mix(h[whole] + _SALT[8 + n]) & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass(frozen=True)
class Model:
    """langs in order, log priors, log probabilities as (bucket, language)."""

    langs: tuple[str, ...]
    prior: np.ndarray
    table: np.ndarray


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 1 when divided by 3; false for a null id."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", smoothing: float = 0.5) -> Model:
    """Learn from all rows with text and language that are not held out.

    Each task sums n-gram counts of its rows per language and sends one row for each
    bucket that occurs; these rows are summed by key, so what reaches the driver has a
    size fixed by the number of languages and BUCKETS. No rows to learn from give a
    model without languages.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    rows = docs.filter(~held_out(F.col(id_col)) & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        seen: dict[str, int] = {}
        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(text)
            for lang, texts in by_lang.items():
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                seen[lang] = seen.get(lang, 0) + len(texts)
                for _, bucket in grams(texts):
                    total += np.bincount(bucket, minlength=BUCKETS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (len(at) + 1), pa.string()), pa.array(np.append(at, -1), pa.int64()), pa.array(np.append(total[at], seen[lang]), pa.int64())], names=["lang", "bucket", "n"])

    got = rows.mapInArrow(trimmed(count), "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("bucket", "n"))).alias("counts"))  # BUCKETS + 1 entries at most
    langs, prior, table = [], [], []
    for lang, pairs in sorted((r["lang"], r["counts"]) for r in got.collect()):
        counts = np.full(BUCKETS, smoothing)
        for bucket, n in pairs:
            if bucket < 0:
                prior.append(n)
            else:
                counts[bucket] += n
        langs.append(lang)
        table.append(np.log(counts / counts.sum()))
    share = np.log(np.array(prior, float) / sum(prior)) if prior else np.zeros(0)
    return Model(tuple(langs), share, np.array(table, dtype=np.float64).T.copy() if table else np.zeros((BUCKETS, 0)))


def scores(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """The likeliest language of each text, and its posterior probability.

    The sparse counts of a batch meet the matrix block by block: its rows of all n-grams
    are looked up together and summed by text.
    """
    fit = [k for k, t in enumerate(texts) if t and model.langs and has_letter(t)]
    langs, sure = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if fit:
        logs = np.tile(model.prior, (len(fit), 1))
        for text, bucket in grams([texts[k] for k in fit]):
            if len(text):
                first = np.flatnonzero(np.diff(text, prepend=-1))
                logs[text[first]] += np.add.reduceat(model.table[bucket], first, axis=0)
        best = logs.argmax(axis=1)
        sure[fit] = 1 / np.exp(logs - logs.max(axis=1, keepdims=True)).sum(axis=1)
        for k, x in zip(fit, best, strict=True):
            langs[k] = model.langs[x]
    return langs, sure


def predict(docs: DataFrame, model: Model, *, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its posterior probability.

    The matrix of log probabilities (BUCKETS x languages) is broadcast; a task scores
    its own rows and nothing is shuffled. A text that is null or has no letter gives
    ``und`` with score 0, as does a model without languages; ties go to the first
    language by name. Columns of these names, in any case, are replaced; repeated rows are
    scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rows, given = bare(docs)
    kept = [f"_in{k}" for k, c in enumerate(given) if c.lower() not in (pred_col.lower(), score_col.lower())]
    at, names = kept.index(column_at(given, text_col)), [given[int(c[3:])] for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            langs, sure = scores(m, batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(sure, pa.float64())], names=[*kept, "_lang", "_sure"])

    schema = T.StructType([*rows.select(*kept).schema, T.StructField("_lang", T.StringType()), T.StructField("_sure", T.DoubleType())])
    return rows.select(*kept).mapInArrow(trimmed(run), schema).toDF(*names, pred_col, score_col)
