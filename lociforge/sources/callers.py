"""Results of other callers, truth tables and sample sheets as relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names


def wide(rows: DataFrame, key: str, loci: tuple[str, ...] = ("A", "B", "C")) -> DataFrame:
    """(key, locus, a1, a2) of columns A1, A2, B1, ...; loci without both alleles are left out."""
    pairs = ", ".join(f"'{x}', {x}1, {x}2" for x in loci)
    return rows.selectExpr(key, f"stack({len(loci)}, {pairs}) as (locus, a1, a2)").where("a1 <> '' and a2 <> ''")


def json_map(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, locus, a1, a2) of {"A": ["A*01:01", ...], ...}: one allele counts twice, of more the first two; bad JSON gives nothing."""
    m = rows.select(key, F.explode(F.from_json(json, "map<string,array<string>>")).alias("k", "v")).where(F.size("v") > 0)
    locus = F.upper(F.regexp_replace("k", "^HLA[-_]?", ""))
    return m.select(key, locus.alias("locus"), F.col("v")[0].alias("a1"), F.coalesce(F.get("v", F.lit(1)), F.col("v")[0]).alias("a2"))


def json_list(rows: DataFrame, key: str, json: str) -> DataFrame:
    """(key, locus, a1, a2) of {"hla": {"alleles": [...]}}: the first two alleles of each locus; bad JSON gives nothing."""
    doc = F.from_json(json, "hla struct<alleles: array<string>>")
    a = rows.select(key, F.posexplode(doc.hla.alleles).alias("i", "allele")).withColumn("locus", names.parse(F.col("allele")).locus)
    got = a.groupBy(key, "locus").agg(F.array_sort(F.collect_list(F.struct("i", "allele"))).alias("v"))
    return got.select(key, "locus", F.col("v")[0].allele.alias("a1"), F.coalesce(F.get("v", F.lit(1)).allele, F.lit("")).alias("a2"))


def result_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(locus, a1, a2) of a file with Locus, Chromosome (1 or 2) and Allele; '#' lines are skipped, the last row of a chromosome wins."""
    t = spark.read.csv(path, sep="\t", header=True, comment="#").withColumn("_i", F.monotonically_increasing_id())
    pick = lambda c: F.coalesce(F.max_by(F.when(F.col("Chromosome") == c, F.col("Allele")), F.when(F.col("Chromosome") == c, F.col("_i"))), F.lit(""))
    return t.groupBy(F.col("Locus").alias("locus")).agg(pick("1").alias("a1"), pick("2").alias("a2"))


def optitype_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(locus, a1, a2); the last row of the file wins."""
    t = spark.read.csv(path, sep="\t", header=True).withColumn("_i", F.monotonically_increasing_id())
    last = t.groupBy().agg(*[F.max_by(c, "_i").alias(c) for c in ("A1", "A2", "B1", "B2", "C1", "C2")])
    return wide(last.withColumn("_k", F.lit(1)), "_k").drop("_k")


def json_file(spark: SparkSession, path: str, kind: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True).withColumn("_k", F.lit(1))
    return (json_map if kind == "map" else json_list)(doc, "_k", "value").drop("_k")


#: Readers by caller; callers without one of their own have the plain table.
READERS = {"hla_la": result_tsv, "optitype": optitype_tsv, "xhla": lambda s, p: json_file(s, p, "list"), "arcas": lambda s, p: json_file(s, p, "map")}


def read_results(spark: SparkSession, caller: str, path: str) -> DataFrame:
    return READERS.get(caller, result_tsv)(spark, path)


def truth_tsv(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, locus, t1, t2, ancestry, depth, bam) of SampleID, Locus, Allele1, Allele2 [, Ancestry, Depth].

    Prefixes are dropped, the last row of a (sample, locus) wins, ancestry and
    depth are those of the sample's first row.
    """
    t = spark.read.csv(path, sep="\t", header=True).withColumn("_i", F.monotonically_increasing_id())
    for c, default in (("Ancestry", "unknown"), ("Depth", "0")):
        t = t.withColumn(c, F.coalesce(F.col(c), F.lit(default))) if c in t.columns else t.withColumn(c, F.lit(default))
    per = t.groupBy("SampleID").agg(F.min_by("Ancestry", "_i").alias("ancestry"), F.min_by("Depth", "_i").cast("double").alias("depth"))
    last = t.groupBy("SampleID", "Locus").agg(F.max_by(F.struct("Allele1", "Allele2"), "_i").alias("p"))
    out = last.join(per, "SampleID")
    return out.select(F.col("SampleID").alias("sample_id"), F.regexp_replace("Locus", "^HLA-", "").alias("locus"), names.strip_prefix(F.col("p.Allele1")).alias("t1"), names.strip_prefix(F.col("p.Allele2")).alias("t2"), "ancestry", "depth", F.concat("SampleID", F.lit(".bam")).alias("bam"))


def sample_sheet(spark: SparkSession, path: str, data_type: str = "short") -> DataFrame:
    t = spark.read.csv(path, header=True)
    kind = F.coalesce(F.col("data_type"), F.lit(data_type)) if "data_type" in t.columns else F.lit(data_type)
    return t.select("sample_id", "bam_path", kind.alias("data_type"))
