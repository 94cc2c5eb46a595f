"""Copy number, allele dropout and contamination of samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..constants import CNV_LOCI, REFERENCE_LOCUS

LOCUS = ["sample_id", "locus"]


def read_counts(alignments: DataFrame) -> DataFrame:
    """(locus keys, allele, n, total): reads of each allele, and of its locus; reads are dealt once for both."""
    own = alignments.select(*LOCUS, "read_id", "allele").repartition("sample_id", "read_id").distinct()
    first = F.row_number().over(Window.partitionBy(*LOCUS, "read_id").orderBy("allele")) == 1
    n = own.withColumn("_f", first).groupBy(*LOCUS, "allele").agg(F.count("read_id").alias("n"), F.count_if(F.col("_f") & F.col("read_id").isNotNull()).alias("_t"))
    return n.withColumn("total", F.sum("_t").over(Window.partitionBy(*LOCUS))).drop("_t")


def depths(alignments: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """Reads of each locus, with those of the sample's reference locus; counts: read_counts of the alignments, if they are at hand."""
    n = alignments.groupBy(*LOCUS).agg(F.countDistinct("read_id").alias("reads")) if counts is None else counts.groupBy(*LOCUS).agg(F.max("total").alias("reads"))
    ref = n.where(F.col("locus") == REFERENCE_LOCUS).select("sample_id", F.col("reads").alias("_r"))
    return n.join(ref, "sample_id", "left").select(*LOCUS, "reads", F.coalesce("_r", F.lit(0)).alias("ref_reads"))


def copy_number(depth: DataFrame, kmer_coverage: Column | None = None) -> DataFrame:
    """copies, ratio, confidence and method of each locus; loci of fixed copy number are diploid."""
    fixed, few = ~F.col("locus").isin(*CNV_LOCI), F.col("ref_reads") < 10
    ratio = F.col("reads").cast("double") / F.col("ref_reads")
    by_depth = F.when(ratio < 0.10, 0).when(ratio < 0.65, 1).otherwise(2)
    over = (kmer_coverage < 0.10) if kmer_coverage is not None else F.lit(False)
    copies = F.when(fixed | few, 2).when(F.coalesce(over, F.lit(False)), 0).otherwise(by_depth)
    sure = (
        F.when(fixed, "HIGH").when(few, "LOW").when((F.col("copies") == 0) & (ratio < 0.05), "HIGH").when((F.col("copies") == 2) & (ratio > 0.80), "HIGH")
        .when(F.col("copies") == 1, F.when(F.abs(ratio - 0.375) < 0.10, "MEDIUM").otherwise("LOW")).otherwise("MEDIUM")
    )
    method = F.when(fixed, "fixed").when(few, "fallback").when(F.coalesce(over, F.lit(False)), "kmer_override").otherwise("depth_ratio")
    shown = F.when(fixed, F.lit(1.0)).when(few, F.lit(0.0)).otherwise(F.round(ratio, 4))
    return depth.withColumn("copies", copies).select(*LOCUS, "reads", "ref_reads", shown.alias("ratio"), "copies", sure.alias("confidence"), method.alias("method"))


def apply_copy_number(calls: DataFrame, copies: DataFrame) -> DataFrame:
    """calls with absent loci emptied and hemizygous ones reduced to their first allele."""
    c = calls.join(copies.select(*LOCUS, "copies"), LOCUS, "left")
    return (
        c.withColumn("allele2", F.when(F.col("copies") <= 1, "").otherwise(F.col("allele2")))
        .withColumn("allele1", F.when(F.col("copies") == 0, "").otherwise(F.col("allele1")))
        .withColumn("status", F.when(F.col("copies") == 0, "cnv_absent").when(F.col("copies") == 1, "cnv_hemizygous").otherwise(F.col("status")))
    )


def dropout_risk(evidence: DataFrame) -> DataFrame:
    """evidence(is_homozygous, reads, ref_reads, n_het_sites, posterior) with signals and risk."""
    depth = F.when((F.col("ref_reads") > 0) & (F.col("reads").cast("double") / F.col("ref_reads") < 0.6), 1).otherwise(0)
    het = F.when(F.col("n_het_sites") >= 2, 2).when(F.col("n_het_sites") == 1, 1).otherwise(0)
    unsure = F.when(F.col("posterior") < 0.90, 1).otherwise(0)
    n = F.when(F.col("is_homozygous"), depth + het + unsure).otherwise(0)
    return evidence.withColumn("signals", n).withColumn("risk", F.when(F.col("signals") >= 3, "HIGH").when(F.col("signals") == 2, "MEDIUM").when(F.col("signals") == 1, "LOW").otherwise("NONE"))


def third_allele(counts: DataFrame) -> DataFrame:
    """The third most frequent allele of each locus of read_counts and its share of the locus's reads."""
    order = Window.partitionBy(*LOCUS).orderBy(F.col("n").desc(), "allele")
    third = counts.withColumn("_r", F.row_number().over(order)).where("_r = 3 and sample_id is not null and locus is not null")
    return third.select(*LOCUS, "allele", "n", "total", (F.col("n").cast("double") / F.col("total")).alias("fraction"))


def contamination(alignments: DataFrame, least: int = 20, fraction: float = 0.10, loci: int = 2, counts: DataFrame | None = None) -> DataFrame:
    """Samples with the loci whose third allele is too frequent, their share, and whether there are enough."""
    counts = read_counts(alignments) if counts is None else counts
    flagged = third_allele(counts).where((F.col("total") >= least) & (F.col("fraction") >= fraction)).select(*LOCUS)
    all_loci = counts.groupBy("sample_id").agg(F.countDistinct("locus").alias("n_loci"))
    hits = flagged.groupBy("sample_id").agg(F.count("*").alias("_n"), F.array_join(F.array_sort(F.collect_set("locus")), ",").alias("_l"))
    out = all_loci.join(hits, "sample_id", "left").withColumn("n_flagged", F.coalesce("_n", F.lit(0)))
    return out.select("sample_id", "n_loci", "n_flagged", F.coalesce("_l", F.lit("")).alias("flagged_loci"), F.round(F.col("n_flagged") / F.col("n_loci"), 4).alias("score"), (F.col("n_flagged") >= loci).alias("is_contaminated"))
