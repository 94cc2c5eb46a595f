"""Posteriors of allele pairs and confidence tiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .genotype import LOCUS, pair_sums

#: Log-likelihood of a read that neither allele explains.
UNMAPPED = 1e-10


def pair_posteriors(weighted: DataFrame, weights: DataFrame | None = None, most: int = 60) -> DataFrame:
    """(locus keys, a1, a2, ll, p): softmax of the pairs' log-likelihoods under a uniform prior.

    Reads without either allele add ln 1e-10 each; they are counted, not
    joined.  Where a locus has one allele there is nothing to weigh it
    against: its posterior is a twentieth for each read with evidence, 1 at
    most.  All pairs enter the softmax; weights(locus keys, allele, weight),
    if given, leave the `most` pairs of the largest sum of weights, ties by name.
    """
    reads = weighted.groupBy(*LOCUS).agg(F.countDistinct("read_id").alias("_n"), F.min("allele").alias("_x"), F.max("allele").alias("_y"))
    ll = F.col("s") + (F.col("_n") - F.col("k")) * F.log(F.lit(UNMAPPED))
    out = pair_sums(weighted).join(reads, LOCUS).withColumn("ll", ll)
    locus = Window.partitionBy(*LOCUS)
    if weights is not None:
        w = weights.select(*LOCUS, "allele", "weight")
        one = lambda i: w.select(*LOCUS, F.col("allele").alias(f"a{i}"), F.col("weight").alias(f"_w{i}"))
        sums = F.coalesce("_w1", F.lit(0.0)) + F.coalesce("_w2", F.lit(0.0))
        out = out.join(one(1), [*LOCUS, "a1"], "left").join(one(2), [*LOCUS, "a2"], "left")
        out = out.withColumn("_r", F.row_number().over(locus.orderBy(F.round(sums, 9).desc(), "a1", "a2"))).where(F.col("_r") <= most)
    out = out.withColumn("_e", F.exp(F.col("ll") - F.max("ll").over(locus)))
    p = F.when(F.col("_x") == F.col("_y"), single_allele(F.col("k"))[0]).otherwise(F.col("_e") / F.sum("_e").over(locus))
    return out.select(*LOCUS, "a1", "a2", "ll", p.alias("p"))


def ranked(posteriors: DataFrame, k: int = 20) -> DataFrame:
    """The k likeliest pairs with rank; posteriors are not renormalised."""
    order = Window.partitionBy(*LOCUS).orderBy(F.round("p", 9).desc(), F.round("ll", 6).desc(), "a1", "a2")
    return posteriors.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def alternatives(posteriors: DataFrame, k: int = 5) -> DataFrame:
    """Ranks 2 to k + 1."""
    return ranked(posteriors, k + 1).where("rank > 1")


def best_with_gap(posteriors: DataFrame) -> DataFrame:
    """The likeliest pair with gap: its lead over the second, 1 if there is none."""
    order = Window.partitionBy(*LOCUS).orderBy("rank")
    r = ranked(posteriors, 2).withColumn("gap", F.coalesce(F.col("p") - F.lead("p").over(order), F.lit(1.0)))
    return r.where("rank = 1").drop("rank")


def entropy(posteriors: DataFrame) -> DataFrame:
    """Entropy of a locus's renormalised posteriors, in nats."""
    share = F.col("p") / F.sum("p").over(Window.partitionBy(*LOCUS))
    return posteriors.where("p > 0").withColumn("_q", share).groupBy(*LOCUS).agg((-F.sum(F.col("_q") * F.log("_q"))).alias("entropy"))


def tier(p: Column, gap: Column) -> Column:
    """Tier of a call by posterior and gap, limits included."""
    return F.when((p >= 0.99) & (gap >= 0.10), "HIGH").when((p >= 0.90) & (gap >= 0.05), "MEDIUM").when(p >= 0.50, "LOW").otherwise("VERY_LOW")


def strict_class(p: Column) -> Column:
    """Class of a posterior alone, limits excluded."""
    return F.when(p > 0.99, "HIGH").when(p > 0.90, "MEDIUM").otherwise("LOW")


def single_allele(reads: Column) -> tuple[Column, Column]:
    """(posterior, class) where a locus has one candidate allele."""
    return F.least(F.lit(1.0), reads / F.lit(20.0)), F.when(reads > 10, "HIGH").when(reads > 3, "MEDIUM").otherwise("LOW")
