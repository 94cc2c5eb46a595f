"""Heterozygous sites, haplotype bins and their alleles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOCUS = ["sample_id", "locus"]


def het_sites(bases: DataFrame, min_depth: int = 5, low: float = 0.15, high: float = 0.85, min_quality: int = 20) -> DataFrame:
    """Positions of enough depth whose second base is neither too rare nor too frequent.

    Deletions and skips have no base and do not count; where bases have a
    quality, those below min_quality do not count either.
    """
    good = F.col("base").isin("A", "C", "G", "T")
    if "quality" in bases.columns:
        good = good & (F.coalesce("quality", F.lit(min_quality)) >= min_quality)
    n = bases.where(good).groupBy(*LOCUS, "pos", "base").agg(F.count("*").alias("n"))
    at = Window.partitionBy(*LOCUS, "pos")
    r = n.withColumn("depth", F.sum("n").over(at)).withColumn("_r", F.row_number().over(at.orderBy(F.col("n").desc(), "base")))
    pick = lambda k, c: F.max(F.when(F.col("_r") == k, F.col(c)))
    s = r.where("_r <= 2").groupBy(*LOCUS, "pos").agg(F.max("depth").alias("depth"), pick(1, "base").alias("major"), pick(2, "base").alias("minor"), pick(2, "n").alias("_m"))
    return s.where((F.col("depth") >= min_depth) & (F.col("_m").cast("double") / F.col("depth")).between(low, high)).drop("_m")


def read_matrix(bases: DataFrame, sites: DataFrame) -> DataFrame:
    """(locus keys, read_id, pos, v): 0 for the major, 1 for the minor base; other bases are missing."""
    b = bases.groupBy(*LOCUS, "read_id", "pos").agg(F.min("base").alias("base"))
    j = b.join(sites.select(*LOCUS, "pos", "major", "minor"), [*LOCUS, "pos"])
    v = F.when(F.col("base") == F.col("major"), 0).when(F.col("base") == F.col("minor"), 1)
    return j.withColumn("v", v).where("v is not null").select(*LOCUS, "read_id", "pos", "v")


def bin_consensus(matrix: DataFrame, bins: DataFrame, sites: DataFrame) -> DataFrame:
    """The base of each bin at each site, halves rounded to even; bins(locus keys, read_id, bin)."""
    c = matrix.join(bins.where("bin >= 0"), [*LOCUS, "read_id"]).groupBy(*LOCUS, "bin", "pos").agg(F.bround(F.avg("v"), 0).cast("int").alias("v"), F.count("*").alias("n"))
    return c.join(sites.select(*LOCUS, "pos", "major", "minor"), [*LOCUS, "pos"]).select(*LOCUS, "bin", "pos", F.when(F.col("v") == 0, F.col("major")).otherwise(F.col("minor")).alias("base"), "n")


def match_bins(consensus: DataFrame, sequences: DataFrame, by: str | list[str] = "locus") -> DataFrame:
    """The allele of each bin whose sequence agrees with most of its bases; sequences(by, allele, seq): those of the locus, or of the sample's locus."""
    j = consensus.join(sequences, by)
    inside = F.col("pos") < F.length("seq")
    s = j.groupBy(*LOCUS, "bin", "allele").agg(
        F.count_if(inside & (F.substring("seq", F.col("pos") + 1, F.lit(1)) == F.col("base"))).alias("matches"), F.count_if(inside).alias("compared")
    )
    s = s.withColumn("score", F.col("matches") / F.greatest(F.col("compared"), F.lit(1)))
    order = Window.partitionBy(*LOCUS, "bin").orderBy(F.col("score").desc(), "allele")
    return s.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def balance(bins: DataFrame) -> DataFrame:
    """Sizes of the two bins, the smaller as a share of the reads assigned, and the share of reads assigned."""
    n = bins.groupBy(*LOCUS).agg(*[F.count_if(F.col("bin") == b).alias(f"n{b}") for b in (0, 1)], F.count("*").alias("reads"))
    some = F.col("n0") + F.col("n1")
    ratio = F.when(F.greatest("n0", "n1") > 0, F.least("n0", "n1") / F.greatest("n0", "n1")).otherwise(F.lit(0.0))
    return n.select(*LOCUS, "n0", "n1", "reads", ratio.alias("balance"), (some / F.col("reads")).alias("confidence"))
