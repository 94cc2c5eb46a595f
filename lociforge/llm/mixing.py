"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's documents stand in order of size; each expects target / source size
copies; a document is emitted once for every integer that the running sum of
expected copies, shifted by one random offset a source, crosses.  The running
sum needs only a document's rank, which is counted in two levels: rows are
numbered within (source, size class, salt), and the cells' counts, of which a
source has a bounded number, give each cell's start.  No source is ever
gathered in one task.  Words are counted once: what is ranked are rows of
(key, source, size, hash of the text), and texts move only to meet their copies.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Fresh, own, small_side, written

#: Cells of a size class that are numbered independently.
SALTS = 4096
#: Size classes in a factor of e.
FINE = 8


def _unit(text):
    """A number in [0, 1) from the text: the first 32 bits of its MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame, weights=(5, 2, 1), most: float = 3.0) -> DataFrame:
    """(source, source_size, target) for sizes(source, source_size), a row a source.

    Weights repeat over the sources in code-point order, null last.  Targets
    share the sum of all sizes; one that exceeds `most` times its source's size
    stops there and its excess is shared anew by weight.  In order of
    size / weight the sources that stop come first, so one running sum finds
    the final state.
    """
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("_i") - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("_i", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))).withColumn("_w", weight)
    all_rows = Window.partitionBy(F.lit(1))
    first = Window.orderBy(F.col("source_size") / F.col("_w"), "_i")
    before = first.rowsBetween(Window.unboundedPreceding, -1)
    after = first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    total, cap = F.sum("source_size").over(all_rows), F.lit(most) * F.col("source_size")
    share = (total - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("_w").over(after)
    stops = ranked.withColumn("_share", share).withColumn("_cap", cap).withColumn("_stop", F.col("_cap") < F.col("_share") * F.col("_w"))
    left = F.sum("source_size").over(all_rows) - F.sum(F.when(F.col("_stop"), F.col("_cap")).otherwise(F.lit(0.0))).over(all_rows)
    rest = F.sum(F.when(~F.col("_stop"), F.col("_w")).otherwise(F.lit(0.0))).over(all_rows)
    return stops.select("source", "source_size", F.when(F.col("_stop"), F.col("_cap")).otherwise(left / rest * F.col("_w")).alias("target"))


def _planned(docs: DataFrame, weights, most: float, seed: int, key: str, text: str, source: str) -> DataFrame:
    """(k, s, h, n, size, source_size, target, u, each, before): the n rows of one key, source and text, and the rank before their first."""
    words = F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
    one = docs.select(F.col(key).alias("k"), F.col(source).alias("s"), F.xxhash64(text).alias("h"), words.alias("size"))
    rows = written(one.groupBy("k", "s", "h", "size").agg(F.count("*").alias("n")), "sizes")
    rows = rows.withColumn("c", F.floor(F.log(F.col("size") + 1.0) * FINE).cast("int")).withColumn(
        "a", F.pmod(F.conv(F.substring(F.md5(F.coalesce(F.col("k").cast("string"), F.lit(""))), 9, 6), 16, 10).cast("int"), F.lit(SALTS))
    )
    cells = rows.groupBy("s", "c", "a").agg(F.sum("n").alias("cell"), F.sum(F.col("n") * F.col("size")).alias("words"))
    sizes = cells.groupBy(F.col("s").alias("source")).agg(F.sum("words").alias("source_size"))
    targets = source_targets(sizes, weights, most).withColumnRenamed("source", "t")
    upto = Window.partitionBy("s").orderBy("c", "a").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    offset = _unit(F.concat(F.lit(f"{seed}|"), F.coalesce(F.concat(F.lit("s"), F.col("s")), F.lit("null"))))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    starts = cells.join(targets, F.col("s").eqNullSafe(F.col("t"))).select(
        F.col("s").alias("s2"), F.col("c").alias("c2"), F.col("a").alias("a2"), (F.sum("cell").over(upto) - F.col("cell")).alias("start"), "source_size", "target", offset.alias("u"), each.alias("each")
    )
    cell = Window.partitionBy("s", "c", "a").orderBy("size", "k", "h").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("in_cell", F.sum("n").over(cell) - F.col("n"))
    out = rows.join(starts, F.col("s").eqNullSafe(F.col("s2")) & (F.col("c") == F.col("c2")) & (F.col("a") == F.col("a2")))
    return out.select("k", "s", "h", "n", "size", "source_size", "target", "u", "each", (F.col("start") + F.col("in_cell")).alias("before"))


def _copies(u, each, rank, most: float):
    """How many whole numbers the running sum crosses at a rank (from 1)."""
    crossed = F.floor(u + rank * each) - F.floor(u + (rank - 1) * each)
    return F.least(crossed, F.ceil(F.lit(most))).cast("long")


def plan_rows(docs: DataFrame, weights=(5, 2, 1), most: float = 3.0, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(key, source, size, source_size, target, copies), a row a row of docs, without its texts.

    size counts words.  Null texts have size 0; a null source is a source of its
    own and a null key a key; a source without words has target 0 and no
    copies; repeated rows count as rows of their own, ties in size stand in
    order of key and text; an empty table gives no rows.
    """
    p = _planned(docs, weights, most, seed, key, text, source)
    rows = p.select("*", F.explode(F.sequence(F.lit(1).cast("long"), "n")).alias("i"))
    return rows.select(F.col("k").alias(key), F.col("s").alias(source), "size", "source_size", "target", _copies(F.col("u"), F.col("each"), F.col("before") + F.col("i"), most).alias("copies"))


def mix(docs: DataFrame, weights=(5, 2, 1), most: float = 3.0, seed: int = 0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents: each row of docs, as it is, as often as plan_rows says.

    Columns of any name stay as they are.  Rows of one key, source and text
    are told apart by no rule: which of them is taken how often is not fixed.
    """
    f = Fresh(docs)
    p = _planned(docs, weights, most, seed, key, text, source)
    total = lambda n: F.floor(F.col("u") + (F.col("before") + n) * F.col("each")) - F.floor(F.col("u") + F.col("before") * F.col("each"))
    p = p.where((F.col("n") > 1) | (total(F.lit(1)) > 0))  # single rows without copies are gone before texts move
    names = {"k": f.k, "s": f.s, "h": f.h, "n": f.n, "u": f.u, "each": f.each, "before": f.before}
    p = written(p.select(*[F.col(a).alias(b) for a, b in names.items()]), "copies")
    rows, again = p.agg(F.count("*"), F.count_if(F.col(f.n) > 1)).first()
    same = F.col(key).eqNullSafe(F.col(f.k)) & F.col(source).eqNullSafe(F.col(f.s)) & (F.col(f.t) == F.col(f.h))
    out = docs.withColumn(f.t, F.xxhash64(text)).join(small_side(p, rows), same)
    taken = lambda df, i: df.withColumn(f.copies, _copies(F.col(f.u), F.col(f.each), F.col(f.before) + i, most)).where(F.col(f.copies) > 0).select(*own(docs.columns), F.explode(F.sequence(F.lit(1).cast("long"), F.col(f.copies))).alias(f.copy)).drop(f.copy)
    if not again:
        return taken(out, F.lit(1))
    nth = F.row_number().over(Window.partitionBy(f.k, f.s, f.h).orderBy(f.before))
    more = out.where(F.col(f.n) > 1).withColumn(f.nth, nth)
    return taken(out.where(F.col(f.n) == 1), F.lit(1)).unionByName(taken(more, F.col(f.nth)))
