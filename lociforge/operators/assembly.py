"""Contigs of reads: a graph of k-mers, its unbranched paths joined by pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import tabled
from .kmers import CHUNK, spread

LOCUS = ["sample_id", "locus"]


def read_kmers(reads: DataFrame, key: list[str], k: int, least: int) -> DataFrame:
    """(key, km, n): the k-mers of A, C, G and T, as they run, that at least `least` windows of reads(key, seq) have."""
    rows = spread(reads.select(*key, F.upper("seq").alias("_s")).where(F.length("_s") >= k), *key)
    chunks = rows.select(*key, "_s", F.explode(F.sequence(F.lit(0), F.length("_s") - k, F.lit(CHUNK))).alias("_i")).select(*key, F.substring("_s", F.col("_i") + 1, F.lit(CHUNK + k - 1)).alias("_c"))
    windows = chunks.select(*key, "_c", F.explode(F.sequence(F.lit(1), F.length("_c") - (k - 1))).alias("_i")).select(*key, F.substring("_c", F.col("_i"), F.lit(k)).alias("km"))
    n = windows.where(~F.col("km").rlike("[^ACGT]")).groupBy(*key, "km").agg(F.count("*").alias("n"))
    return n.where(F.col("n") >= least)


def links(nodes: DataFrame, key: list[str], k: int) -> DataFrame:
    """(key, km, before): k-mers that alone go on from another that goes on to them alone: they share k - 1 letters that end one k-mer and begin one."""
    ends = nodes.select(*key, F.substring("km", 2, k - 1).alias("_x"), F.col("km").alias("_u"), F.lit(None).cast("string").alias("_v"))
    begins = nodes.select(*key, F.substring("km", 1, k - 1).alias("_x"), F.lit(None).cast("string").alias("_u"), F.col("km").alias("_v"))
    met = ends.unionByName(begins).groupBy(*key, "_x").agg(F.count("_u").alias("_in"), F.count("_v").alias("_out"), F.max("_u").alias("before"), F.max("_v").alias("km"))
    return met.where("_in = 1 and _out = 1 and before <> km").select(*key, "km", "before")


def unitigs(reads: DataFrame, key: list[str] | None = None, k: int = 31, least: int = 2, shortest: int | None = None) -> DataFrame:
    """(key, seq, n_kmers, depth) of reads(key, seq) that run in one direction, such as those turned to their alleles.

    Contigs are the paths without a branch of the graph whose nodes are k-mers
    (of `least` occurrences or more: fewer are mostly errors) and whose edges
    share k - 1 letters; depth is the mean number of occurrences.  Each node
    points to the one before it and, in every round, to where that one points:
    the number of rounds grows with the logarithm of the longest path, and the
    nodes stay dealt by key and k-mer.  Closed rings have no first node and
    are left out, and so are contigs under `shortest` letters (2 * k).  Keys
    may be null; null and short sequences and those of other letters have no
    k-mers; no reads give no rows.
    """
    key = key or LOCUS
    nodes = tabled(read_kmers(reads, key, k, least))
    at = nodes.alias("n").join(links(nodes, key, k).alias("l"), [F.col(f"n.{c}").eqNullSafe(F.col(f"l.{c}")) for c in key] + [F.col("n.km") == F.col("l.km")], "left")
    # p: where a node points, itself if it is first; d: how many steps away that is.
    state = tabled(at.select(*[F.col(f"n.{c}").alias(c) for c in key], F.col("n.km").alias("km"), "n", F.coalesce("l.before", "n.km").alias("p"), F.col("l.before").isNotNull().cast("long").alias("d")))
    moving = -1
    while True:
        there = state.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("km").alias("_km"), F.col("p").alias("_p"), F.col("d").alias("_d"))
        jump = state.join(there, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key] + [F.col("p") == F.col("_km")])
        state = tabled(jump.select(*key, "km", "n", F.col("_p").alias("p"), (F.col("d") + F.col("_d")).alias("d"), (F.col("_p") != F.col("p")).alias("moved")))
        left = state.where("moved").agg(F.count("*")).first()[0]
        state = state.drop("moved")
        # A path's nodes are at their first one after a round without a move; what moves on without end, as many each time, are rings.
        if not left or left == moving:
            break
        moving = left
    first = state.where("p = km and d = 0").select(*[F.col(c).alias(f"_{c}") for c in key], F.col("km").alias("_km"))
    paths = state.join(first, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key] + [F.col("p") == F.col("_km")], "left_semi")
    letters = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("d", F.right("km", F.lit(1)).alias("c")))), lambda x: x.c), "")
    out = paths.groupBy(*key, "p").agg(letters.alias("_l"), F.count("*").alias("n_kmers"), F.avg("n").alias("depth"))
    seq = F.concat(F.substring("p", 1, k - 1), "_l")
    return out.select(*key, seq.alias("seq"), "n_kmers", "depth").where(F.length("seq") >= (2 * k if shortest is None else shortest))
