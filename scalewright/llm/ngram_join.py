"""N-gram Jaccard join of documents, and what hangs together by it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import setjoin
from .common import Scratch, bare, column_at, small

#: Leaders of a token's largest component that a node outside it is tried with at a time.
MET = 8
#: Times that it is, at most, before all pairs that are left.
TRIES = 3


def _labels(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, label) of the nodes that link with another: the least node of the component."""
    rows = setjoin.prefixes(sets, scratch)
    leaders = F.array_distinct(F.array(F.min(F.struct("own", "node", "at")).dropFields("own"), F.min(F.struct("node", "at"))))
    lead = scratch.put(rows.groupBy("token").agg(leaders.alias("l"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("token", F.explode("l").alias("l")).select("token", F.col("l.node").alias("a"), F.col("l.at").alias("a_at")), "leaders")
    tried = scratch.put(setjoin.leading(rows.select("token", F.col("node").alias("b"), F.col("at").alias("b_at")).join(lead, "token"), setjoin.LEADERS), "pairs")
    edges = scratch.put(setjoin.linked(sets, tried, scratch), "links")
    labels = setjoin.components(edges, scratch)

    # Nodes outside a token's largest component meet the few of it with the least share of own
    # tokens: leaders may have been ill chosen, and a link to one of a group spares all others.
    for _ in range(TRIES):
        apart = _apart(rows, labels, scratch)
        if apart.isEmpty():
            return labels
        met = setjoin.leading(_met_leaders(apart).join(_ways(tried), ["a", "b"], "left_anti"), MET)
        new = scratch.put(met, "pairs")
        more = scratch.put(setjoin.linked(sets, new, scratch), "links")
        tried = tried.select("a", "b").unionAll(new)
        if more.isEmpty():
            break
        edges = edges.unionAll(more)
        labels = setjoin.components(edges, scratch)
    else:
        apart = _apart(rows, labels, scratch)

    # Then they meet all others that still lie elsewhere.
    one = apart.filter("label <> main").select("token", F.col("node").alias("a"), F.col("at").alias("a_at"), F.col("label").alias("a_label"))
    other = apart.select(F.col("token").alias("t"), F.col("node").alias("b"), F.col("at").alias("b_at"), F.col("label").alias("b_label"), "main")
    meet = (F.col("token") == F.col("t")) & (F.col("a_label") != F.col("b_label")) & ((F.col("b_label") == F.col("main")) | (F.col("a") < F.col("b"))) & setjoin.may_link(F.col("a_at"), F.col("b_at"))
    found = setjoin.candidates(one.join(other, meet))
    new = scratch.put(found.join(_ways(tried), ["a", "b"], "left_anti"), "pairs")
    if new.isEmpty():
        return labels
    more = scratch.put(setjoin.linked(sets, new, scratch), "links")
    return labels if more.isEmpty() else setjoin.components(edges.union(more), scratch)


def _apart(rows: DataFrame, labels: DataFrame, scratch: Scratch) -> DataFrame:
    """The rows of tokens whose nodes lie in several components, with label and main, the token's largest component."""
    with_label = scratch.put(rows.join(small(labels), "node", "left").withColumn("label", F.coalesce("label", "node")), "labelled")
    counted = with_label.groupBy("token", "label").agg(F.count(F.lit(1)).alias("c"))
    several = scratch.put(counted.groupBy("token").agg(F.max(F.struct("c", "label")).alias("m"), F.count(F.lit(1)).alias("k")).filter("k > 1").select("token", F.col("m.label").alias("main")), "several")
    return scratch.put(with_label.join(small(several), "token"), "apart")


def _met_leaders(apart: DataFrame) -> DataFrame:
    """Rows (a, b, a_at, b_at): each b outside its token's largest component beside the token's MET leaders a of it."""
    first = F.row_number().over(Window.partitionBy("token").orderBy("own", "node"))
    lead = apart.filter("label = main").withColumn("k", first).filter(F.col("k") <= MET).select("token", F.col("node").alias("a"), F.col("at").alias("a_at"))
    return apart.filter("label <> main").select("token", F.col("node").alias("b"), F.col("at").alias("b_at")).join(lead, "token")


def _ways(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _grouped(docs: DataFrame, id_col: str, text_col: str, scratch: Scratch) -> DataFrame:
    """The units of ``docs`` with the label of their component, null for texts without a word."""
    rows = setjoin.input_of(docs, id_col, text_col)
    units, nodes, table = setjoin.profile(rows, False, scratch)
    labels = _labels(setjoin.ranked(rows, nodes, table, False, scratch), scratch)
    return units.join(small(labels), "node", "left").withColumn("label", F.coalesce("label", "node"))


def component_rows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, node, component_id for every row.

    The set of a document, and when two link, is said in ``setjoin``. Components are
    those of the links: first each node is tried with leaders of its tokens; then with
    leaders of their largest components; then all pairs that still lie in different components. ``component_id`` is the smallest id in
    the component. Texts without a word have size 0 and stay alone; ids may be null
    (ignored for the smallest) or repeat (each row is judged by its text); other columns
    are ignored, whatever their names; an empty table gives no rows. Equal sets are one
    node; sets and tokens are known by 64-bit hashes.
    """
    scratch = Scratch(docs.sparkSession)
    known = scratch.put(_grouped(docs, id_col, text_col, scratch), "grouped")
    least = known.filter("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("k")).filter("k > 1").drop("k")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.coalesce("component_id", "doc_id"))
    out = scratch.keep(known.join(small(scratch.put(least, "least")), "label", "left").select("doc_id", F.col("n").alias("n_shingles"), "node", component.alias("component_id")), "components")
    scratch.close()
    return out


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``, and every row of a text without a word.

    The one is that of the smallest id, then of the smallest text hash; rows without an
    id come last, so one of them stays where all lack it. Rows are known by id and text:
    an id may stand for several texts, each judged on its own. Of rows that repeat both,
    one stays, but without an id and a word all do. All columns stay, whatever their
    names; an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession)
    rows, names = bare(docs)
    doc, text = column_at(names, id_col), column_at(names, text_col)
    units = scratch.put(_grouped(rows, doc, text, scratch), "components")
    pair = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_key")
    least = units.filter("label IS NOT NULL").groupBy("label").agg(F.min(pair).alias("least"))
    keys = units.groupBy("doc_id", "text_key", "label").agg(F.count(F.lit(1)).alias("k"))
    judged = scratch.put(keys.join(least, "label", "left").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.coalesce(pair == F.col("least"), F.lit(True)).alias("stays"), F.expr("k > 1 AND (label IS NOT NULL OR doc_id IS NOT NULL)").alias("repeats")), "judged")
    gone, repeated = scratch.keep(judged.filter("NOT stays").select("_id", "_key"), "gone"), scratch.keep(judged.filter("stays AND repeats").select("_id", "_key"), "repeated")
    scratch.close()
    named = rows.withColumns({"_doc": F.col(doc).cast("long"), "_text": F.xxhash64(F.col(text).cast("string"))})

    def matched(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        return left.join(small(right), F.col("_doc").eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")), how)

    kept = matched(named, gone, "left_anti")
    if not repeated.isEmpty():
        kept = matched(kept, repeated, "left_anti").union(matched(kept, repeated, "left_semi").dropDuplicates(["_doc", "_text"]))
    return kept.drop("_doc", "_text").toDF(*names)
