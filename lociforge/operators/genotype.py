"""Diploid genotype selection."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LOCUS = ["sample_id", "locus"]


def objective(weighted: DataFrame) -> DataFrame:
    """Column sums: what an allele adds to the weighted objective."""
    return weighted.groupBy(*LOCUS, "allele").agg(F.round(F.sum("weight"), 6).alias("obj"), F.count("*").alias("n"))


def top_pair(weighted: DataFrame, k: int = 2) -> DataFrame:
    """The k alleles of largest objective, ties by name: the optimum of the weighted two-allele program."""
    order = Window.partitionBy(*LOCUS).orderBy(F.col("obj").desc(), "allele")
    return objective(weighted).withColumn("rn", F.row_number().over(order).cast("long")).where(F.col("rn") <= k)


def calls(weighted: DataFrame) -> DataFrame:
    """One row a locus: allele1, allele2, objective, reads_explained, total_reads, is_homozygous, status.

    A locus with one candidate is trivially homozygous.
    """
    best = top_pair(weighted)
    pair = best.groupBy(*LOCUS).agg(F.min("allele").alias("allele1"), F.max("allele").alias("allele2"), F.round(F.sum("obj"), 6).alias("objective"), F.count("*").alias("_k"))
    hits = weighted.join(best.select(*LOCUS, "allele"), [*LOCUS, "allele"], "left_semi")
    explained = hits.where(F.col("weight") > 0).groupBy(*LOCUS).agg(F.countDistinct("read_id").alias("reads_explained"))
    total = weighted.groupBy(*LOCUS).agg(F.countDistinct("read_id").alias("total_reads"))
    out = pair.join(total, LOCUS).join(explained, LOCUS, "left")
    return out.select(
        *LOCUS, "allele1", "allele2", "objective", F.coalesce("reads_explained", F.lit(0)).cast("long").alias("reads_explained"), "total_reads",
        (F.col("_k") == 1).alias("is_homozygous"), F.when(F.col("_k") == 1, F.lit("trivial")).otherwise(F.lit("optimal")).alias("status"),
    )


def allele_pairs(scores: DataFrame, distinct: bool = False) -> DataFrame:
    """Unordered allele pairs of each locus; alleles of a locus are few, reads are not involved."""
    a = scores.select(*LOCUS, "allele").distinct()
    x, y = a.withColumnRenamed("allele", "a1"), a.withColumnRenamed("allele", "a2")
    pairs = x.join(y, LOCUS)
    return pairs.where(F.col("a1") < F.col("a2")) if distinct else pairs.where(F.col("a1") <= F.col("a2"))


def pair_sums(weighted: DataFrame) -> DataFrame:
    """(locus keys, a1, a2, s, k) of every pair a1 <= a2: the sum of ln((w1 + w2) / 2) over the k reads that either explains.

    The sum over a pair is that of each allele alone plus a correction for the
    reads that hold both, so only alleles that meet in a read are paired: a
    read's evidence is gathered once, its few pairs are added up before the
    shuffle, and what is shuffled are rows of alleles, not of reads.
    """
    read = weighted.where("weight > 0").groupBy(*LOCUS, "read_id").agg(F.array_sort(F.collect_list(F.struct("allele", F.col("weight").alias("w")))).alias("e"))
    inside = F.expr(
        "flatten(transform(e, (x, i) -> transform(slice(e, i + 1, size(e) - i), y -> struct(x.allele as a1, y.allele as a2,"
        " if(x.allele = y.allele, ln(x.w), ln((x.w + y.w) / 2) - ln(x.w / 2) - ln(y.w / 2)) as s))))"
    )
    met = read.select(*LOCUS, F.explode(inside).alias("p")).groupBy(*LOCUS, "p.a1", "p.a2").agg(F.sum("p.s").alias("s"), F.count("*").alias("k"))
    alone = met.where("a1 = a2").select(*LOCUS, F.col("a1").alias("allele"), "s", "k")
    one = lambda i: alone.select(*LOCUS, F.col("allele").alias(f"a{i}"), F.col("s").alias(f"_s{i}"), F.col("k").alias(f"_k{i}"))
    pairs = allele_pairs(weighted).join(one(1), [*LOCUS, "a1"], "left").join(one(2), [*LOCUS, "a2"], "left").join(met.where("a1 <> a2"), [*LOCUS, "a1", "a2"], "left")
    pairs = pairs.na.fill(0, ["_k1", "_k2", "k"]).na.fill(0.0, ["_s1", "_s2", "s"])
    half = F.log(F.lit(2.0))
    both = F.col("_s1") - half * F.col("_k1") + F.col("_s2") - half * F.col("_k2") + F.col("s")
    same = F.col("a1") == F.col("a2")
    return pairs.select(*LOCUS, "a1", "a2", F.when(same, F.col("_s1")).otherwise(both).alias("s"), F.when(same, F.col("_k1")).otherwise(F.col("_k1") + F.col("_k2") - F.col("k")).alias("k"))


def max_coverage_pair(scores: DataFrame) -> DataFrame:
    """The pair of different alleles that hits most reads, ties by names; reads are counted as pair_sums does."""
    hits = scores.where(F.col("score") > 0).select(*LOCUS, "read_id", "allele").distinct().withColumn("weight", F.lit(1.0))
    pairs = pair_sums(hits).where("a1 < a2").withColumnRenamed("k", "covered")
    order = Window.partitionBy(*LOCUS).orderBy(F.col("covered").desc(), "a1", "a2")
    return pairs.withColumn("_r", F.row_number().over(order)).where("_r = 1").select(*LOCUS, "a1", "a2", "covered")


def pair_loglik(weighted: DataFrame) -> DataFrame:
    """Sum of ln of the mean weight of the two alleles over reads that either explains."""
    return pair_sums(weighted).where("k > 0").select(*LOCUS, "a1", "a2", F.round("s", 4).alias("ll"), F.col("k").alias("n_reads"))
