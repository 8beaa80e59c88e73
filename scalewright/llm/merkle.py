"""Document fingerprints: Merkle trees over sections, paragraphs and sentences."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, part_keys, trimmed

#: A leaf longer than this is cut behind words chosen by their checksum.
LONG_LEAF = 400
_AFTER_MARK = re.compile(r"(?<=[^\w\s]\s)")
_WORD = re.compile(r"\S+\s*")


@dataclass(frozen=True, slots=True)
class Node:
    """A hash, the characters below it, and its children in order."""

    hash: bytes
    size: int
    below: tuple[Node, ...] = ()


def _leaf(text: str) -> Node:
    return Node(sha256(b"\0" + text.encode("utf-8", "surrogatepass")).digest(), len(text))


def _join(level: int, below: list[Node]) -> Node:
    return Node(sha256(bytes([level]) + b"".join(n.hash for n in below)).digest(), sum(n.size for n in below), tuple(below))


def _sentences(paragraph: str) -> Iterator[str]:
    for part in _AFTER_MARK.split(paragraph):
        if len(part) <= LONG_LEAF:
            if part:
                yield part
            continue
        start = 0
        for m in _WORD.finditer(part):
            if crc32(m[0].encode("utf-8", "surrogatepass")) % 8 == 0:
                yield part[start : m.end()]
                start = m.end()
        if start < len(part):
            yield part[start:]


def tree(text: str) -> Node:
    """The tree of a text. Its leaves, joined, are the text.

    A paragraph is a line with its newline; a section ends with an empty line, or with a
    paragraph whose hash is a multiple of 8, so that an edit moves no later bounds.
    """
    sections, section = [], []
    for line in text.split("\n") if text else ():
        paragraph = _join(1, [_leaf(s) for s in _sentences(line)] + [_leaf("\n")])
        section.append(paragraph)
        if not line or paragraph.hash[0] % 8 == 0:
            sections.append(_join(2, section))
            section = []
    if section:
        sections.append(_join(2, section))
    return _join(3, sections)


def likeness(a: Node, b: Node) -> float:
    """Share of the characters below equal nodes; only nodes without a twin are opened."""
    if a.hash == b.hash:
        return 1.0
    total, common = a.size + b.size, 0
    left, right = a.below, b.below
    while left and right:
        there = Counter(n.hash for n in right)
        rest: list[Node] = []
        twins: Counter[bytes] = Counter()
        for n in left:
            if there[n.hash] > 0:
                there[n.hash] -= 1
                twins[n.hash] += 1
                common += 2 * n.size
            else:
                rest.append(n)
        other = []
        for n in right:
            if twins[n.hash] > 0:
                twins[n.hash] -= 1
            else:
                other.append(n)
        left, right = tuple(c for n in rest for c in n.below), tuple(c for n in other for c in n.below)
    return min(1.0, common / total) if total else 1.0


def edits(a: Node, b: Node, at: int = 0) -> list[tuple[int, int]]:
    """(start, size) of the parts of ``a`` whose nodes have no twin among those of ``b``, leaf by leaf."""
    known: set[bytes] = set()
    todo = [b]
    while todo:
        n = todo.pop()
        known.add(n.hash)
        todo.extend(n.below)
    out: list[tuple[int, int]] = []

    def walk(n: Node, at: int) -> None:
        if n.hash in known:
            return
        if not n.below:
            out.append((at, n.size))
        for c in n.below:
            walk(c, at)
            at += c.size

    walk(a, at)
    return out


def fingerprint(text: str | None) -> str:
    return tree(text or "").hash.hex()


def ring(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (part, copy, doc_id, text) dealt by descending id; the first of a part is also, as a copy, the last of the part before.

    Bounds of the parts are approximate quantiles of the ids, one for each shuffle
    partition; texts are shuffled once.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    ids = rows.select("doc_id")
    bounds = ids.select(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 10000)).first()[0] or []
    bounds = sorted(set(bounds))

    def part(c: Column) -> Column:
        above = F.size(F.filter(F.array(*map(F.lit, bounds)).cast("array<long>"), lambda b: b > c)) if bounds else F.lit(0)
        return F.when(c.isNull(), len(bounds) + 1).otherwise(above).cast("int")

    heads = sorted(ids.groupBy(part(F.col("doc_id")).alias("part")).agg(F.max("doc_id").alias("head")).collect(), key=lambda r: r["part"])  # a row for each part
    head, before = [None] * (len(bounds) + 2), [None] * (len(bounds) + 2)
    for k, r in enumerate(heads):
        head[r["part"]], before[r["part"]] = r["head"], heads[k - 1]["part"]
    at = F.col("part") + 1
    array = lambda xs, kind: F.array(*map(F.lit, xs)).cast(f"array<{kind}>")
    first = F.element_at(array(head, "long"), at).eqNullSafe(F.col("doc_id"))
    dealt = rows.withColumn("part", part(F.col("doc_id"))).withColumn("to", F.array_compact(F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("copy")), F.when(first, F.struct(F.element_at(array(before, "int"), at).alias("part"), F.lit(True).alias("copy"))))))
    spread = dealt.select("doc_id", "text", F.explode("to").alias("to")).select("to.part", "to.copy", "doc_id", "text")
    # An integer that hashing deals to the partition of its own stands for each part.
    key = F.element_at(array(part_keys(parts)[np.arange(len(bounds) + 2) % parts].tolist(), "int"), at)
    return spread.repartition(parts, key).sortWithinPartitions("part", "copy", F.col("doc_id").desc_nulls_last(), "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every document and of its text with the last half taken from the next one.

    The fingerprint is the root of the tree, in hex: equal roots mean equal texts. The
    edited text has the last floor(n_chars / 2) code points replaced by the first as
    many, or all, of the next document in descending id (after the last: the first).
    near_edited and near_next compare the document's tree with those of the edited text
    and of the next document. Null texts count as empty. Rows of equal id stand in order
    of their texts, rows without an id come last; a document that is alone is its own
    next; repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    bound_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(doc: int | None, text: str, own: Node, then: str, after: Node) -> tuple:
            n = len(text) // 2
            edited = text[: len(text) - n] + then[:n]
            changed = tree(edited)
            return (doc, len(text), sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), own.hash.hex(), changed.hash.hex(), likeness(own, changed), likeness(own, after))

        waiting: tuple | None = None  # part, doc, text, tree
        for batch in batches:
            out = []
            for part, copy, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if waiting and waiting[0] == part:
                    own = tree(text)
                    out.append(row(*waiting[1:], text, own))
                    waiting = None if copy else (part, doc, text, own)
                elif not copy:
                    waiting = (part, doc, text, tree(text))
            columns = list(zip(*out, strict=True)) or [()] * 7
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ring(docs, id_col=id_col, text_col=text_col).mapInArrow(trimmed(run), SCHEMA)
