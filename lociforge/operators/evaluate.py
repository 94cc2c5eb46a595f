"""Calls against truth, callers against each other, and downsampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names


def matches(c1: Column, c2: Column, t1: Column, t2: Column, fields: int = 2) -> Column:
    """Alleles of the call that are in the truth, whatever their order: 0 to 2, -1 if nothing was called."""
    cut = lambda x: F.when(x == "", F.lit("")).otherwise(names.truncate(x, fields))

    def count(z: Column) -> Column:
        both = ((z.a == z.c) & (z.b == z.d)) | ((z.a == z.d) & (z.b == z.c))
        one = (z.a == z.c) | (z.a == z.d) | ((z.b != "") & ((z.b == z.c) | (z.b == z.d)))
        return F.when((z.a == "") & (z.b == ""), -1).when(both, 2).when(one, 1).otherwise(0)

    return names.let(F.struct(cut(c1).alias("a"), cut(c2).alias("b"), cut(t1).alias("c"), cut(t2).alias("d")), count)


def against_truth(truth: DataFrame, calls: DataFrame, fields: int = 2) -> DataFrame:
    """truth(sample_id, locus, t1, t2, ...) with the call's alleles and matches; loci without truth are left out, without call are no calls."""
    c = calls.select("sample_id", "locus", F.col("allele1").alias("c1"), F.col("allele2").alias("c2"))
    j = truth.join(c, ["sample_id", "locus"], "left").na.fill("", ["c1", "c2"])
    return j.withColumn("matches", matches(F.col("c1"), F.col("c2"), F.col("t1"), F.col("t2"), fields))


def counters() -> list[Column]:
    kinds = (("n_correct_both", 2), ("n_correct_one", 1), ("n_incorrect", 0), ("n_no_call", -1))
    return [F.count("*").alias("n_samples"), *[F.count_if(F.col("matches") == v).alias(c) for c, v in kinds]]


def with_rates(df: DataFrame) -> DataFrame:
    n = F.col("n_samples")
    return df.withColumn("accuracy", F.when(n > 0, (2 * F.col("n_correct_both") + F.col("n_correct_one")) / (2 * n)).otherwise(0.0)).withColumn("call_rate", F.when(n > 0, 1 - F.col("n_no_call") / n).otherwise(0.0))


def accuracy(compared: DataFrame, *by: str) -> DataFrame:
    """Counters and rates of compared rows by columns (over all rows without any)."""
    return with_rates(compared.groupBy(*by).agg(*counters()))


def discordant(compared: DataFrame) -> DataFrame:
    return compared.where(F.col("matches").isin(0, 1))


def validate(results: DataFrame, truth: DataFrame, fields: int = 2) -> DataFrame:
    """Full join of results(key, c1, c2) and truth(key, t1, t2) with status; a side that is missing counts as wrong."""
    j = results.join(truth, "key", "full").na.fill("", ["c1", "c2", "t1", "t2"])
    m = matches(F.col("c1"), F.col("c2"), F.col("t1"), F.col("t2"), fields)
    return j.withColumn("matches", m).withColumn("status", F.when(F.col("matches") == 2, "OK").when(F.col("matches") == 1, "PARTIAL").when(F.col("matches") == -1, "NO_CALL").otherwise("MISMATCH"))


def consensus(callers: DataFrame, fields: int = 2, least: int = 2, share: float = 0.5) -> DataFrame:
    """Majority pair of each locus over callers(caller, sample_id, locus, a1, a2): n, rate and whether it is concordant; ties go to the first caller."""
    p, q = names.truncate(F.col("a1"), fields), names.truncate(F.col("a2"), fields)
    v = callers.select("caller", "sample_id", "locus", F.least(p, q).alias("a1"), F.greatest(p, q).alias("a2"))
    votes = v.groupBy("sample_id", "locus", "a1", "a2").agg(F.count("*").alias("n"), F.min("caller").alias("_first"))
    locus = Window.partitionBy("sample_id", "locus")
    out = votes.withColumn("rate", F.col("n") / F.sum("n").over(locus)).withColumn("_k", F.row_number().over(locus.orderBy(F.col("n").desc(), "_first")))
    return out.where("_k = 1").withColumn("ok", (F.col("n") >= least) & (F.col("rate") >= share)).drop("_first", "_k")


def _draw(key: str, seed: int) -> Column:
    """A number from 0 to 99 by the MD5 of seed and key: the same on any layout."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string")).cast("binary")), 1, 8), 16, 10).cast("long"), F.lit(100))


def downsample(reads: DataFrame, fraction: float, key: str = "read_id", seed: int = 42) -> DataFrame:
    """The reads whose hash falls below the fraction, in whole hundredths: all rows of a read stay or go together."""
    return reads.where(_draw(key, seed) < int(fraction * 100))


def depth_curve(reads: DataFrame, depth: float | Column, targets=(5, 10, 20, 30, 50, 100), key: str = "read_id", seed: int = 42) -> DataFrame:
    """reads once for each target depth, at that depth's fraction (column target): all of them for a target at or above the present depth.

    depth: a number, or a column where samples differ.
    """
    present = depth if isinstance(depth, Column) else F.lit(float(depth))
    share = lambda t: F.when(present > t, F.floor(F.lit(100.0 * t) / present)).otherwise(100)
    held = F.array(*[F.when(F.col("_h") < share(t), F.lit(t)) for t in targets]).cast("array<int>")
    return reads.withColumn("_h", _draw(key, seed)).select(*reads.columns, F.explode(held).alias("target")).where("target is not null")


def estimate_depth(contigs: DataFrame, read_length: int = 150, default: float = 30.0) -> DataFrame:
    """Mean depth of contigs(name, length, reads) but '*', 30 if there is nothing to go by."""
    c = contigs.where(F.col("name") != "*")
    return c.agg(F.coalesce(F.try_divide(F.sum("reads") * F.lit(float(read_length)), F.sum("length")), F.lit(default)).alias("depth"))


def build_signs(name: Column, length: Column) -> dict[str, Column]:
    """Whether a reference is chromosome 6, and by which build's name."""
    six = (length > 170_000_000) & (length < 172_000_000)
    return {"grch38": six & (name == "chr6"), "grch37": six & (name == "6")}


def detect_build(contigs: DataFrame) -> DataFrame:
    """The genome build by the length and name of chromosome 6: chr6 is looked at first."""
    found = contigs.agg(*[F.max(x).alias(n) for n, x in build_signs(F.col("name"), F.col("length")).items()])
    return found.select(F.when(F.col("grch38"), "GRCh38").when(F.col("grch37"), "GRCh37").alias("build"))


def region_reads(alignments: DataFrame, chrom: str, start: int, end: int, unmapped: bool = True) -> DataFrame:
    """Alignments that overlap the region, and unmapped ones if asked for; alignments(chrom, pos, end, flag)."""
    hit = (F.col("chrom") == chrom) & (F.col("pos") < end) & (F.col("end") > start)
    return alignments.where(hit | (F.col("flag").bitwiseAND(4) != 0)) if unmapped else alignments.where(hit & (F.col("flag").bitwiseAND(4) == 0))
