"""Near-duplicate lines over a whole corpus: the first stays, later matches go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import setjoin
from .common import Scratch, bare, column_at, small

_FIRST = ("none", "doc_id", "text_key", "line")


def _matched(sets: DataFrame, nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """Nodes that link with one whose first line comes earlier.

    First each is tried with leaders of its tokens that come earlier: the earliest, and
    the one with the least share of tokens of its own; then those without a match with
    all earlier nodes of their tokens.
    """
    order = scratch.put(nodes.join(sets.select("node"), "node", "left_semi").select("node", F.struct(*_FIRST).alias("first")), "order")
    rows = scratch.put(setjoin.prefixes(sets, scratch).join(small(order, 40), "node"), "placed")
    leaders = F.array_distinct(F.array(F.min(F.struct("own", "first", "node", "at")).dropFields("own"), F.min(F.struct("first", "node", "at"))))
    lead = scratch.put(rows.groupBy("token").agg(leaders.alias("l"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("token", F.explode("l").alias("l")).select("token", F.col("l.first").alias("a_first"), F.col("l.node").alias("a"), F.col("l.at").alias("a_at")), "leaders")
    later = rows.select("token", F.col("node").alias("b"), F.col("at").alias("b_at"), F.col("first").alias("b_first"))
    tried = scratch.put(setjoin.leading(later.join(lead, "token").filter(F.col("a_first") < F.col("b_first")), setjoin.LEADERS), "pairs")
    matched = scratch.put(setjoin.linked(sets, tried, scratch).select(F.col("b").alias("node")).distinct(), "matched")

    late = rows.join(small(matched), "node", "left_anti").select(F.col("token").alias("t"), F.col("node").alias("b"), F.col("at").alias("b_at"), F.col("first").alias("b_first"))
    early = rows.select("token", F.col("node").alias("a"), F.col("at").alias("a_at"), F.col("first").alias("a_first"))
    meet = (F.col("token") == F.col("t")) & (F.col("a_first") < F.col("b_first")) & setjoin.may_link(F.col("a_at"), F.col("b_at"))
    found = setjoin.candidates(scratch.put(late, "late").join(early, meet))
    new = scratch.put(found.join(tried, ["a", "b"], "left_anti"), "pairs")
    if new.isEmpty():
        return matched
    # The later node is the hub here: it may have many partners.
    more = setjoin.linked(sets, new.select(F.col("b").alias("a"), F.col("a").alias("b")), scratch)
    return scratch.put(matched.union(more.select("a")).distinct(), "matched")


def removed_lines(docs: DataFrame, scratch: Scratch, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_key, lines, repeats): the numbers, from 0, of each document's lines that match an earlier line, and whether rows repeat id and text.

    Lines come in order of document id (null last), text hash and number. A line's set
    holds its five-word shingles; a line of fewer words has all of them as its only one.
    A line matches an earlier one if their sets link (see ``setjoin``), whether that one
    stays or not; equal sets always do.
    """
    rows = setjoin.input_of(docs, id_col, text_col)
    units, nodes, table = setjoin.profile(rows, True, scratch)
    matched = _matched(setjoin.ranked(rows, nodes, table, True, scratch), nodes, scratch)
    marked = matched.withColumn("matched", F.lit(True))
    judged = nodes.join(small(marked), "node", "left").filter(F.col("matched") | (F.col("k") > 1)).select("node", F.coalesce("matched", F.lit(False)).alias("matched"), F.struct(*_FIRST).alias("first"))
    judged = scratch.put(judged, "judged")
    mine = units.select("doc_id", "text_key", "line", "node").join(small(judged, 48), "node")
    goes = F.col("matched") | (F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key", "line") != F.col("first"))
    lines = mine.groupBy("doc_id", "text_key").agg(F.collect_set(F.when(goes, F.col("line").cast("int"))).alias("lines"), (F.count(F.lit(1)) > F.size(F.collect_set("line"))).alias("repeats"))
    return lines.filter((F.size("lines") > 0) | F.col("repeats"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the lines that are left as text, and n_lines, n_removed (long).

    Lines end at a newline; lines without a word always stay. A null text stays null and
    has no lines. Of rows that repeat both id and text one has the lines that are left; in
    the others every line with a word matches and goes. Columns named n_lines or
    n_removed, in any case, are replaced; others stay, whatever their names; an empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows, names = bare(docs)
    doc, text = column_at(names, id_col), column_at(names, text_col)
    gone = scratch.keep(removed_lines(rows, scratch, id_col=doc, text_col=text), "removed")
    scratch.close()
    key = F.xxhash64(F.col(text).cast("string"))
    mine = F.col(doc).cast("long").eqNullSafe(F.col("doc_id")) & (key == F.col("text_key"))
    joined = rows.join(small(gone, 24 + 4 * F.size("lines")), mine, "left").withColumn("again", F.lit(False))
    if not gone.filter("repeats").isEmpty():
        # Numbered in a written table, so that a task that runs again numbers alike.
        numbered = scratch.keep(joined.filter("repeats").withColumn("number", F.monotonically_increasing_id()), "repeated")
        first = numbered.groupBy("doc_id", "text_key").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("one"))
        again = numbered.join(first, "number", "left").withColumn("again", F.col("one").isNull()).drop("number", "one")
        joined = joined.filter(~F.coalesce("repeats", F.lit(False))).unionByName(again)
    value = F.col(text).cast("string")
    parts = F.split(value, "\n", -1)
    # The numbers that stay come by hashing, so many removed lines cost no more than few.
    left = F.transform(F.array(parts), lambda p: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(p) - 1), F.col("lines")), lambda i: F.get(p, i)), "\n"))[0]
    without = F.array_join(F.filter(parts, lambda x: ~F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))), "\n")
    cleaned = F.when(F.col("again"), without).when(F.size("lines") > 0, left).otherwise(value)
    worded = F.size(F.filter(parts, lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))))
    removed = F.when(F.col("again"), worded).otherwise(F.coalesce(F.size("lines"), F.lit(0)))
    columns = [(cleaned if f"_in{k}" == text else F.col(f"_in{k}")).alias(c) for k, c in enumerate(names) if c.lower() not in ("n_lines", "n_removed")]
    return joined.select(*columns, F.when(value.isNull(), 0).otherwise(F.size(parts)).cast("long").alias("n_lines"), removed.cast("long").alias("n_removed"))
