"""Packing by power-of-two decomposition: every piece is a sequence of its own document."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, trimmed

#: Words kept with their ids in a worker; beyond, the memory starts anew.
CACHED_WORDS = 600_000
#: Characters that Python's split() takes as white space and the tokenizer does not.
_ODD = re.compile("[\x1c-\x1f]").search

#: Characters by which byte-level tokenizers write those bytes that have no mark of their own.
_BYTES = dict(zip([*range(0x21), *range(0x7F, 0xA1), 0xAD], range(0x100, 0x144), strict=True))
#: Letters that lower to one letter each and are in composed form, then marks.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,|!?;:%$#&*]*)").fullmatch

SCHEMA = "doc_id long, start long, length long, doc_tokens long, ids binary"


class _Memory(dict):
    """Results of a function by argument, each made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        super().__init__()
        self.make = make

    def __missing__(self, key: str) -> bytes:
        out = self[key] = self.make(key)
        return out


class WordEncoder:
    """Ids of texts by a tokenizer that lowers case and whose pretokens never span white space.

    Such a tokenizer gives a text the joined ids of its white-space separated words, so
    each distinct word is encoded once and remembered. A word of Latin letters with
    marks behind is two pretokens, the letters in lower case and the marks, which are
    remembered by themselves. The letters are already normal and one pretoken, so their
    bytes go to the tokenizer's merges at once; all else takes its whole path.
    """

    def __init__(self, definition: str) -> None:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(definition)
        self.tokenizer.encode_special_tokens = True
        self.merged = self.tokenizer.model.tokenize
        self.packed = [n.to_bytes(4, "little") for n in range(self.tokenizer.get_vocab_size())]
        self.words, self.stems, self.marks = _Memory(self.word), _Memory(self.stem), _Memory(self.whole)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def stem(self, letters: str) -> bytes:
        """Ids of a word of lower-case letters, whose bytes the merges take as characters."""
        text = letters if letters.isascii() else letters.encode().decode("latin-1").translate(_BYTES)
        packed = self.packed
        return b"".join([packed[t.id] for t in self.merged(text)])

    def word(self, word: str) -> bytes:
        m = _SIMPLE(word)
        if m is None:
            return self.whole(word)
        letters, marks = m.groups()
        return self.stems[letters.lower()] + self.marks[marks] if marks else self.stems[letters.lower()]

    def __call__(self, texts: list[str]) -> list[bytes]:
        for known in (self.words, self.stems, self.marks):
            if len(known) > CACHED_WORDS:
                known.clear()
        known = self.words.__getitem__
        return [self.whole(t) if _ODD(t) else b"".join(map(known, t.split())) for t in texts]


@cache
def _encoder(definition: str) -> WordEncoder:
    return WordEncoder(definition)


def pieces(n: int, longest: int) -> list[tuple[int, int]]:
    """(start, length) of the binary decomposition of n tokens, longest pieces first."""
    out, at = [], 0
    while n - at >= longest:
        out.append((at, longest))
        at += longest
    size = longest >> 1
    while at < n:
        if n - at >= size:
            out.append((at, size))
            at += size
        size >>= 1
    return out


def pack(docs: DataFrame, tokenizer_path: str, *, max_tokens: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cut every document into pieces whose lengths are powers of two.

    A document is its ids followed by ``end_id``. It is cut into as many pieces of
    ``max_tokens`` (a power of two) as it holds, then into one piece for every bit of
    the rest, so no piece needs padding and none crosses documents. A piece is one
    sequence; sequences of equal length form a bucket, from which batches of one shape
    can be read (see ``write_buckets``).

    Returns doc_id, start, length, doc_tokens, ids (little-endian unsigned 32-bit
    integers), bucket (log2 of the length), sequence_id and offset (always 0). A null or
    empty text gives one piece with ``end_id`` alone, a null id is kept as null,
    repeated rows are packed each, other columns are ignored, an empty table gives no
    rows. No shuffle: a task reads, encodes and cuts its own rows, and sequence ids
    join the task's number with a running number.
    """
    if max_tokens < 1 or max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    spark = docs.sparkSession
    bound_batches(spark)
    with open(tokenizer_path, encoding="utf-8") as f:
        definition = spark.sparkContext.broadcast(f.read())  # the size of one vocabulary file

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = _encoder(definition.value), end_id.to_bytes(4, "little")
        for batch in batches:
            ids, starts, lengths, totals, payload = [], [], [], [], []
            for doc, tokens in zip(batch.column(0).to_pylist(), encode([t or "" for t in batch.column(1).to_pylist()]), strict=True):
                tokens += end
                total = len(tokens) // 4
                for at, n in pieces(total, max_tokens):
                    ids.append(doc)
                    starts.append(at)
                    lengths.append(n)
                    totals.append(total)
                    payload.append(tokens[4 * at : 4 * (at + n)])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(totals, pa.int64()), pa.array(payload, pa.binary())], names=["doc_id", "start", "length", "doc_tokens", "ids"])

    cut_rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(trimmed(cut), SCHEMA)
    return cut_rows.withColumns({"bucket": F.bit_count(F.col("length") - 1), "sequence_id": F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})


def write_buckets(packed: DataFrame, path: str) -> None:
    """Sequences as Parquet, one folder for each length."""
    packed.write.partitionBy("bucket").parquet(path)
