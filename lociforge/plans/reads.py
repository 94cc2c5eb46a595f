"""From a user's first file to alignments with the alleles: SAM, BAM or FASTQ, of a genome, of an allele panel, or not aligned at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import REGIONS
from ..functions import names
from ..operators import assembly, evaluate, mapping
from ..sources import bam, fastq, sequences
from ..storage import kept

#: Reads that are neither secondary nor supplementary.
PRIMARY = 0x900


def region_of(contigs: DataFrame, build: str | None = None) -> str:
    """The region of the loci by the build that header and lengths tell (GRCh38 where they tell none), or by the one that is given."""
    build = build or evaluate.detect_build(contigs).first()[0] or "GRCh38"  # one row
    chrom, start, end = REGIONS[build]
    return f"{chrom}:{start}-{end}"


def on_alleles(contigs: DataFrame) -> bool:
    """Whether the references of a header are alleles."""
    return contigs.where(F.instr("name", "*") > 0).limit(1).count() > 0


def unaligned(rows: DataFrame, sample: str | Column) -> DataFrame:
    """(sample_id, read_id, seq, qual) of alignment rows, each read once; read_id is name/mate."""
    mate = F.when(F.col("flag").bitwiseAND(0x40) != 0, "/1").when(F.col("flag").bitwiseAND(0x80) != 0, "/2").otherwise("/0")
    own = rows.where((F.col("flag").bitwiseAND(PRIMARY) == 0) & (F.col("seq") != "*"))
    named = own.select((sample if isinstance(sample, Column) else F.lit(sample)).alias("sample_id"), F.concat("name", mate).alias("read_id"), "seq", "qual")
    return named.dropDuplicates(["sample_id", "read_id"])  # a placed unmapped read may come from two pieces of a file


def fastq_reads(spark: SparkSession, path: str, mates: str | None, sample: str) -> DataFrame:
    """(sample_id, read_id, seq, qual) of one file or of two with a read's mates."""
    one = lambda p, m: fastq.fastq(spark, p).select(F.lit(sample).alias("sample_id"), F.concat(F.regexp_replace("name", "/[12]$", ""), F.lit(f"/{m}")).alias("read_id"), "seq", "qual")
    return one(path, 1).unionByName(one(mates, 2)) if mates else one(path, 0)


def mapped(reads: DataFrame, alleles: DataFrame) -> DataFrame:
    """Reads of unaligned or fastq_reads mapped to the alleles, in the columns of sequences.sam: a read and its mate have one name again."""
    rows = mapping.map_reads(reads, alleles)
    mate = F.substring("name", -1, 1)
    flag = F.col("flag") + F.when(mate == "1", 0x41).when(mate == "2", 0x81).otherwise(0)
    return rows.withColumn("flag", flag).withColumn("name", F.expr("substring(name, 1, length(name) - 2)")).drop("locus")


def alignment_rows(spark: SparkSession, path: str, sample: str, alleles: DataFrame | None = None, mates: str | None = None, build: str | None = None, unmapped: bool = True) -> DataFrame:
    """Alignments with alleles in the columns of sequences.sam.

    SAM text is taken as it stands, and so is a BAM file whose references are
    alleles.  Of a BAM file of a genome, which needs its index, the reads of the
    loci's region and, if asked for, the unmapped ones are taken and mapped to
    `alleles`, and so are all reads of FASTQ files.
    """
    if path.endswith(".sam"):
        return sequences.sam(spark, path)
    if path.endswith(".bam"):
        contigs = bam.contigs(spark, path)
        if on_alleles(contigs):
            return bam.bam(spark, path).where("ref <> '*'").drop("path")
    if alleles is None:
        raise SystemExit("reads that are not aligned with alleles need --sequences")
    if path.endswith(".bam"):
        reads = unaligned(bam.bam(spark, path, region_of(contigs, build), unmapped), sample)
    else:
        reads = fastq_reads(spark, path, mates, sample)
    return kept(mapped(reads, alleles)).drop("sample_id")


def sheet_rows(spark: SparkSession, sheet: DataFrame, alleles: DataFrame | None, build: str | None = None, unmapped: bool = True) -> tuple[DataFrame, DataFrame]:
    """(alignments, errors) of a sheet(sample_id, bam_path) of BAM files, all in one pass.

    alignments have the columns of sequences.sam and sample_id; errors are
    (sample_id, message), of every sample with a file that is not there, not
    whole or of a genome without index or `alleles`.  Headers are read first,
    so that files of a genome are read by region; a row of the sheet is one
    small file name on the driver.
    """
    paths = [r[0] for r in sheet.select("bam_path").distinct().collect()]
    schema = f"{bam.SCHEMA}, sample_id string"
    if not paths:
        return spark.createDataFrame([], schema).drop("path"), spark.createDataFrame([], "sample_id string, message string")
    contigs = kept(bam.contigs(spark, paths, errors="rows"))
    known = contigs.groupBy("path").agg(F.max(F.instr("name", "*") > 0).alias("alleles"), *[F.max(x).alias(n) for n, x in evaluate.build_signs(F.col("name"), F.col("length")).items()])
    by = {}
    for r in known.collect():  # a row a file
        by.setdefault(None if r["alleles"] else build or ("GRCh38" if r["grch38"] or not r["grch37"] else "GRCh37"), []).append(r["path"])
    unread = set(paths) - {p for group in by.values() for p in group}
    parts = [bam.bam(spark, [*by.pop(None, []), *sorted(unread)], errors="rows")]
    if alleles is not None:
        for k, group in by.items():
            chrom, start, end = REGIONS[k]
            parts.append(bam.bam(spark, group, f"{chrom}:{start}-{end}", unmapped, errors="rows").withColumn("ref", F.when(F.col("flag") == bam.ERROR, F.col("ref"))))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    named = kept(rows.join(F.broadcast(sheet.select("sample_id", F.col("bam_path").alias("path"))), "path"))  # as many rows as the paths above
    errors = named.where(F.col("flag") == bam.ERROR).groupBy("sample_id").agg(F.min("qual").alias("message"))
    if alleles is None and by:
        lost = [p for group in by.values() for p in group]
        errors = errors.unionByName(sheet.where(F.col("bam_path").isin(lost)).select("sample_id", F.lit("reads of a genome need --sequences").alias("message")))
    errors = kept(errors)
    good = named.where(F.col("flag") != bam.ERROR).join(F.broadcast(errors.select("sample_id")), "sample_id", "left_anti")
    direct = good.where(F.col("ref").isNotNull() & (F.col("ref") != "*")).drop("path")
    if alleles is None:
        return direct, errors
    turned = mapped(unaligned(good.where(F.col("ref").isNull()), F.col("sample_id")), alleles)
    return kept(direct.unionByName(turned)), errors


def contig_rows(contigs: DataFrame, alleles: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(contigs(sample_id, locus, seq), their alignments) of contigs(sample_id, read_id, seq), whose loci are found by mapping.

    The alignments, (sample_id, locus, allele, pos0, cigar, nm, query, ref), are
    those with the alleles of the locus that holds a contig; so are the contigs,
    turned to run with the alleles.
    """
    rows = kept(mapping.map_reads(contigs, alleles, least=80))
    own = rows.where(F.col("flag").bitwiseAND(256) == 0).select("sample_id", "locus", "seq")
    hits = rows.join(alleles.select("locus", F.col("allele").alias("ref"), F.col("seq").alias("_ref")), ["locus", "ref"])
    return own, hits.select("sample_id", "locus", F.col("ref").alias("allele"), "pos0", "cigar", "nm", F.col("seq").alias("query"), F.col("_ref").alias("ref"))


def fasta_contigs(spark: SparkSession, path: str, sample: str) -> DataFrame:
    """Contigs of a FASTA file for contig_rows."""
    return sequences.fasta(spark, path).select(F.lit(sample).alias("sample_id"), F.col("name").alias("read_id"), "seq")


def assembled(rows: DataFrame, sample: str | Column, k: int = 31) -> DataFrame:
    """Contigs for contig_rows of alignments in the columns of sequences.sam: each locus's primary reads, which run with the alleles, made to unitigs."""
    a = F.when(F.col("ref").startswith("HLA-"), F.substring("ref", F.lit(5), F.length("ref"))).otherwise(F.col("ref"))
    own = rows.where((F.col("flag").bitwiseAND(PRIMARY | 4) == 0) & (F.col("seq") != "*"))
    reads = own.select((sample if isinstance(sample, Column) else F.lit(sample)).alias("sample_id"), names.parse(a).locus.alias("locus"), "seq")
    found = assembly.unitigs(reads, k=k)
    return found.select("sample_id", F.concat("locus", F.lit("/"), F.sha2("seq", 256)).alias("read_id"), "seq")
