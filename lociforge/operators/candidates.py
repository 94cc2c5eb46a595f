"""Candidate funnel: from all alleles to a few groups a locus."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names

LOCUS = ["sample_id", "locus"]


def prefilter(alignments: DataFrame, k: int = 80, min_mapq: int = 1, share: float = 0.01, least: int = 2) -> DataFrame:
    """The k alleles of each locus with most alignments, of those with max(least, share of the sample's) or more."""
    mapped = alignments.where(F.col("mapq") >= min_mapq)
    n = mapped.groupBy(*LOCUS, "allele").agg(F.count("*").alias("n"))
    total = n.groupBy("sample_id").agg(F.sum("n").alias("_total"))
    enough = n.join(total, "sample_id").where(F.col("n") >= F.greatest(F.lit(least), F.floor(F.col("_total") * share)))
    order = Window.partitionBy(*LOCUS).orderBy(F.col("n").desc(), "allele")
    return enough.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k).drop("_total")


def allele_scores(alignments: DataFrame) -> DataFrame:
    """Sum of alignment scores (mapping quality where there is none, never below 0)."""
    return alignments.groupBy(*LOCUS, "allele").agg(F.sum(F.greatest(F.lit(0), F.coalesce("as_score", "mapq"))).alias("score"))


def best_groups(scores: DataFrame, digits: int, k: int) -> DataFrame:
    """The k best groups of each locus at two or four digits, with score, members and rank."""
    p = names.parse(F.col("allele"))
    group = names.two_digit(p) if digits == 2 else names.four_digit(p)
    g = scores.withColumn("grp", group).groupBy(*LOCUS, "grp").agg(F.sum("score").alias("score"), F.count("*").alias("members"))
    order = Window.partitionBy(*LOCUS).orderBy(F.col("score").desc(), "grp")
    return g.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def refine(alignments: DataFrame, two: int = 6, four: int = 20, found: DataFrame | None = None) -> DataFrame:
    """Alleles left after keeping the best two-digit and then the best four-digit groups; alignments are summed up once.

    found(locus keys, allele), if given, are the alleles that count.
    """
    p = names.parse(F.col("allele"))
    scores = allele_scores(alignments)
    if found is not None:  # sums of alleles are few, alignments are not
        scores = scores.join(found.select(*LOCUS, "allele"), [*LOCUS, "allele"], "left_semi")
    rows = scores.withColumn("_p", p).withColumn("g2", names.two_digit(F.col("_p"))).withColumn("g4", names.four_digit(F.col("_p"))).drop("_p")
    locus = Window.partitionBy(*LOCUS)
    for group, k in (("g2", two), ("g4", four)):
        rows = rows.withColumn("_s", F.sum("score").over(Window.partitionBy(*LOCUS, group)))
        rows = rows.withColumn("_r", F.dense_rank().over(locus.orderBy(F.col("_s").desc(), group))).where(F.col("_r") <= k).drop("_s", "_r")
    return rows.select(*LOCUS, "allele", "score", "g2", "g4")


def add_phased(candidates: DataFrame, phased: DataFrame) -> DataFrame:
    """candidates with the phased alleles that are missing."""
    extra = phased.join(candidates, [*LOCUS, "allele"], "left_anti")
    return candidates.select(*LOCUS, "allele").unionByName(extra.select(*LOCUS, "allele"))
