"""Sequence files and reference tables as relations."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..functions import sequences as S


def fasta(spark: SparkSession, path: str, token: int = 0) -> DataFrame:
    """(name, seq): upper-cased sequences; token: which word of the header is the name; records without one are left out.

    A record begins with '>' at the start of a line, and a file with a record;
    '>' inside a header is part of it.  Records are split by the reader, so a
    file of any size is read in parallel.
    """
    r = spark.read.option("lineSep", "\n>").text(path).select(F.regexp_replace(F.regexp_replace("value", "\r", ""), "^>", "").alias("v"))
    head, body = F.substring_index("v", "\n", 1), F.regexp_replace("v", "^[^\n]*\n?", "")
    name = F.get(F.split(F.trim(head), r"\s+"), F.lit(token))
    return r.select(name.alias("name"), F.upper(F.regexp_replace(body, r"\s", "")).alias("seq")).where(F.coalesce(F.col("name"), F.lit("")) != "")


def fastq_reads(spark: SparkSession, path: str) -> DataFrame:
    """One row: reads, a quarter of the lines."""
    return spark.read.text(path).agg(F.floor(F.count("*") / 4).alias("reads"))


def sam(spark: SparkSession, path: str) -> DataFrame:
    """Mapped alignments of SAM text: name, flag, ref, pos0, mapq, cigar, seq, qual, nm, as_score, md."""
    f = spark.read.text(path).where(~F.col("value").startswith("@")).select(F.split("value", "\t").alias("f")).where((F.size("f") >= 11) & (F.get("f", F.lit(2)) != "*"))
    tag = lambda t: F.regexp_replace(F.get(F.filter("f", lambda x: x.startswith(t)), F.lit(0)), f"^{t}", "")
    at = lambda i: F.get("f", F.lit(i))
    return f.select(
        at(0).alias("name"), at(1).try_cast("int").alias("flag"), at(2).alias("ref"), (at(3).try_cast("long") - 1).alias("pos0"), at(4).try_cast("int").alias("mapq"), at(5).alias("cigar"), at(9).alias("seq"), at(10).alias("qual"),
        tag("NM:i:").try_cast("int").alias("nm"), tag("AS:i:").try_cast("int").alias("as_score"), tag("MD:Z:").alias("md"),
    )


def _sample(sample: str | Column) -> Column:
    return (sample if isinstance(sample, Column) else F.lit(sample)).alias("sample_id")


def alignments_of(sam_rows: DataFrame, sample: str | Column) -> DataFrame:
    """SAM rows as alignments of one sample, or of those that a column names: the reference is the allele."""
    a = F.when(F.col("ref").startswith("HLA-"), F.substring("ref", F.lit(5), F.length("ref"))).otherwise(F.col("ref"))
    s = sam_rows.where(F.col("flag").bitwiseAND(4) == 0)
    return s.select(_sample(sample), F.col("name").alias("read_id"), names.parse(a).locus.alias("locus"), a.alias("allele"), F.greatest(F.lit(0), F.coalesce("as_score", "mapq")).alias("as_score"), "mapq", (F.col("flag").bitwiseAND(256) != 0).alias("is_secondary"), F.col("pos0").alias("pos"), F.substring("seq", 1, 1).alias("base"))


def aligned_bases(sam_rows: DataFrame, sample: str | Column, secondary: bool = False) -> DataFrame:
    """(sample_id, read_id, locus, allele, pos, base, quality), a row for each base that an alignment sets against its reference.

    Insertions, clips, deletions and skips give no rows; positions count from
    0; quality is null where the file has none.  secondary: also secondary
    alignments that hold their sequence, such as those of the other allele's
    reads to the allele that bases are counted on.
    """
    a = F.when(F.col("ref").startswith("HLA-"), F.substring("ref", F.lit(5), F.length("ref"))).otherwise(F.col("ref"))
    step = lambda acc, t: F.struct(
        (acc.q + F.when(F.instr(F.lit("M=XIS"), t.op) > 0, t.len).otherwise(0)).alias("q"),
        (acc.r + F.when(F.instr(F.lit("M=XDN"), t.op) > 0, t.len).otherwise(0)).alias("r"),
        F.when(t.op.isin("M", "=", "X") & (t.len > 0), F.concat(acc.at, F.transform(F.sequence(F.lit(0), t.len - 1), lambda i: F.struct((acc.q + i).alias("q"), (acc.r + i).alias("r"))))).otherwise(acc.at).alias("at"),
    )
    start = F.struct(F.lit(0).alias("q"), F.col("pos0").cast("int").alias("r"), F.array().cast("array<struct<q:int,r:int>>").alias("at"))
    mapped = sam_rows.where((F.col("flag").bitwiseAND(4 if secondary else 260) == 0) & (F.col("seq") != "*")).withColumn("allele", a)
    walked = mapped.select(_sample(sample), "name", "allele", F.split("seq", "").alias("s"), F.split("qual", "").alias("k"), (F.col("qual") != "*").alias("has"), F.explode(F.aggregate(S.cigar(F.col("cigar")), start, step, lambda acc: acc.at)).alias("x"))
    quality = F.when(F.col("has"), F.ascii(F.get("k", F.col("x.q"))) - 33)
    return walked.select("sample_id", F.col("name").alias("read_id"), names.parse(F.col("allele")).locus.alias("locus"), "allele", F.col("x.r").alias("pos"), F.upper(F.get("s", F.col("x.q"))).alias("base"), quality.alias("quality"))


def split_mates(alignments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(first, second) mates of alignments(name, flag, seq, qual) whose both mates are there, each read once, in order of name on both sides; single reads are left out."""
    own = alignments.where(F.col("flag").bitwiseAND(0x900) == 0).withColumn("_m", F.when(F.col("flag").bitwiseAND(0x40) != 0, 1).when(F.col("flag").bitwiseAND(0x80) != 0, 2))
    pair = own.groupBy("name").agg(*[F.min(F.when(F.col("_m") == m, F.struct("seq", "qual"))).alias(f"r{m}") for m in (1, 2)]).where("r1 is not null and r2 is not null")
    return tuple(pair.select("name", f"r{m}.seq", f"r{m}.qual").orderBy("name") for m in (1, 2))


def allele_sequences(genomic: DataFrame, coding: DataFrame) -> DataFrame:
    """(locus, allele, seq): coding sequences where a locus has them, else the genomic ones."""
    have = coding.select("locus").distinct()
    return coding.unionByName(genomic.join(have, "locus", "left_anti"))


def non_redundant(sequences: DataFrame) -> DataFrame:
    """(locus, seq, allele, n): the first allele (by name) of each distinct whole sequence, and how many have it."""
    return sequences.groupBy("locus", "seq").agg(F.min("allele").alias("allele"), F.count("*").alias("n"))


def g_groups(spark: SparkSession, path: str) -> DataFrame:
    """(allele, g_group) of lines locus*;a/b/c;G; comments, short lines and lines without a group are skipped."""
    t = spark.read.text(path).where(~F.col("value").startswith("#")).select(F.split("value", ";").alias("p")).where((F.size("p") >= 3) & (F.trim(F.get("p", F.lit(2))) != ""))
    return t.select(F.explode(F.split(F.get("p", F.lit(1)), "/")).alias("a"), F.get("p", F.lit(0)).alias("l"), F.trim(F.get("p", F.lit(2))).alias("g")).select(F.concat("l", "a").alias("allele"), F.concat("l", "g").alias("g_group"))


def frequencies(spark: SparkSession, path: str, population: str | None = None) -> DataFrame:
    """(allele, freq) of Locus, Allele, Frequency [, Population]: names normalised, the last row wins."""
    t = spark.read.csv(path, sep="\t", header=True).withColumn("_i", F.monotonically_increasing_id())
    if population is not None and "Population" in t.columns:
        t = t.where(F.col("Population") == population)
    name = F.when(F.col("Allele").contains("*"), names.strip_prefix(F.col("Allele"))).otherwise(F.concat("Locus", F.lit("*"), "Allele"))
    return t.groupBy(name.alias("allele")).agg(F.max_by(F.col("Frequency").cast("double"), "_i").alias("freq"))


def release(texts: dict[str, str], wanted: str) -> str:
    """The reference's release from the first source that tells: provenance JSON, version file, list header, the repository's tag, the one asked for."""
    if texts.get("provenance"):
        try:
            return json.loads(texts["provenance"])["release"]
        except (ValueError, KeyError):
            pass
    if texts.get("version", "").strip():
        return texts["version"].strip().splitlines()[0].split()[-1]
    for line in texts.get("list", "").splitlines():
        if line.startswith("#") and "version" in line:
            return line.rsplit(" ", 1)[-1]
    return texts.get("tag", "").strip() or wanted
