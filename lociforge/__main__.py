"""Command line: type, batch, validate, build-panel, benchmark and setup-db."""

from __future__ import annotations

import argparse
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .config import PRESETS, PROFILES, Config, check_release
from .constants import REGIONS
from .functions import sequences as S
from .operators import evaluate
from .plans import outputs, reads, typing_run
from .sources import callers, fastq, sequences, sinks
from .storage import kept


#: Files of one sample's reads; anything else is Parquet.
ONE_SAMPLE = (".sam", ".bam", *fastq.ENDINGS)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="lociforge")
    sub = p.add_subparsers(dest="command", required=True)
    t = sub.add_parser("type", help="alignments (Parquet) of samples, or one sample's SAM, BAM or FASTQ file, to calls and reports")
    t.add_argument("alignments")
    t.add_argument("out")
    t.add_argument("--assay", choices=PRESETS, default="short")
    t.add_argument("--profile", choices=PROFILES)
    t.add_argument("--candidates", type=int)
    t.add_argument("--pairs", type=int, help="pairs of the largest weights that enter the posteriors; all by default")
    t.add_argument("--resolution", default=None, help="G, max or a number of fields")
    t.add_argument("--sample", default="sample")
    t.add_argument("--sequences", help="allele FASTA")
    t.add_argument("--mates", help="FASTQ file of the reads' mates")
    t.add_argument("--build", choices=REGIONS, help="genome build of a BAM file, by default what its header tells")
    t.add_argument("--contigs", help="FASTA of assembled contigs: loci that need assembly are compared with them, novel alleles described")
    t.add_argument("--assemble", action="store_true", help="make the contigs from the reads")
    t.add_argument("--frequencies")
    t.add_argument("--population")
    t.add_argument("--g-groups")
    t.add_argument("--release", help="the reference release that is required")
    t.add_argument("--reference", help="folder of the reference, for its release")
    t.add_argument("--clinical", action="store_true")
    t.add_argument("--strict", action="store_true")
    v = sub.add_parser("validate", help="a result table against a truth table")
    v.add_argument("results")
    v.add_argument("truth")
    b = sub.add_parser("build-panel", help="FASTA without repeated sequences")
    b.add_argument("fasta")
    b.add_argument("out")
    m = sub.add_parser("benchmark", help="result tables, or alignments that are typed first, against a truth table")
    m.add_argument("truth")
    m.add_argument("out")
    m.add_argument("--results", help="folder with a types table a sample")
    m.add_argument("--alignments", help="Parquet of all samples")
    m.add_argument("--assay", choices=PRESETS, default="short")
    m.add_argument("--resolution", type=int, default=2)
    m.add_argument("--depths", help="target depths, such as 5,10,20: accuracy of the alignments' samples at each, from the truth's depths")
    h = sub.add_parser("batch", help="BAM files of a sample sheet (sample_id, bam_path [, data_type]), those that are not done yet")
    h.add_argument("sheet")
    h.add_argument("out")
    h.add_argument("--assay", choices=PRESETS, default="short", help="of rows without a data_type")
    h.add_argument("--sequences", help="allele FASTA")
    h.add_argument("--build", choices=REGIONS)
    s = sub.add_parser("setup-db", help="register a reference folder that is already there: check its release, write its lock")
    s.add_argument("folder")
    s.add_argument("--release", default="unknown")
    return p


def found_release(folder: str, wanted: str) -> str:
    """The release that a reference folder tells."""
    texts = {}
    for k, name in (("provenance", "provenance.json"), ("version", "release_version.txt"), ("list", "Allelelist.txt")):
        path = os.path.join(folder, name)
        if os.path.exists(path):
            with open(path) as f:
                texts[k] = f.read(1 << 16)
    tags = os.path.join(folder, ".git", "refs", "tags")
    if os.path.isdir(tags) and os.listdir(tags):
        texts["tag"] = sorted(os.listdir(tags))[-1]
    return sequences.release(texts, wanted)


def alleles_of(spark: SparkSession, path: str) -> DataFrame:
    """(locus, allele, seq) of a FASTA; the allele is the first word of a header that holds '*', else its first word."""
    from .functions import names

    f = sequences.fasta(spark, path)
    second = sequences.fasta(spark, path, 1)
    rows = f.where(F.instr("name", "*") > 0).unionByName(second.where(F.instr("name", "*") > 0))
    a = rows.select(names.strip_prefix(F.col("name")).alias("allele"), "seq")
    return a.select(names.parse(F.col("allele")).locus.alias("locus"), "allele", "seq").dropDuplicates(["locus", "allele"])


def closest(aligned: DataFrame | None, result: typing_run.Result) -> DataFrame | None:
    """Alignments of contigs with the allele that the assembly step found closest, one a locus (the one of most aligned bases)."""
    if aligned is None:
        return None
    own = aligned.join(result.assembly.select("sample_id", "locus", F.col("closest").alias("allele")), ["sample_id", "locus", "allele"])
    length = F.aggregate(F.filter(S.cigar(F.col("cigar")), lambda t: t.op == "M"), F.lit(0), lambda acc, t: acc + t.len)
    first = Window.partitionBy("sample_id", "locus").orderBy(length.desc(), "pos0", "query")
    return own.withColumn("_r", F.row_number().over(first)).where("_r = 1").drop("_r", "nm")


def type_command(spark: SparkSession, a: argparse.Namespace) -> None:
    given = {"clinical": a.clinical, "strict": a.strict, "pairs": a.pairs}
    if a.resolution is not None:
        given["resolution"] = a.resolution if a.resolution in ("G", "max") else int(a.resolution)
    release = found_release(a.reference, "unknown") if a.reference else "unknown"
    if a.release:
        check_release(a.release, release)
    config = Config.create(a.assay, a.profile, a.candidates, release=release, **given)
    more, aligned = {}, None
    if a.sequences:
        more["sequences"] = alleles_of(spark, a.sequences)
    if a.alignments.endswith(ONE_SAMPLE):
        rows = reads.alignment_rows(spark, a.alignments, a.sample, more.get("sequences"), a.mates, a.build, config.preset.unmapped)
        alignments = sequences.alignments_of(rows, a.sample)
        more["bases"] = sequences.aligned_bases(rows, a.sample, secondary=True)
        own = rows.where((F.col("flag").bitwiseAND(reads.PRIMARY) == 0) & (F.col("seq") != "*"))
        more["reads"] = own.select(F.lit(a.sample).alias("sample_id"), F.col("name").alias("read_id"), "seq")
    else:
        alignments, rows = spark.read.parquet(a.alignments), None
    if a.contigs or a.assemble:
        if "sequences" not in more or (a.assemble and rows is None):
            raise SystemExit("contigs need --sequences, and their assembly a file of reads")
        made = reads.assembled(rows, a.sample, config.preset.k) if a.assemble else reads.fasta_contigs(spark, a.contigs, a.sample)
        more["contigs"], aligned = reads.contig_rows(made, more["sequences"])
        more["contig_hits"] = aligned.select("sample_id", "locus", "allele", "cigar", "nm")
    if a.frequencies:
        more["frequencies"] = sequences.frequencies(spark, a.frequencies, a.population)
    groups = sequences.g_groups(spark, a.g_groups) if a.g_groups else None
    result = typing_run.run(alignments, config, groups=groups, **more)
    files = outputs.write_run(result, a.out, config, groups, release, contig_alignments=closest(aligned, result), alleles=more.get("sequences"))
    for r in sinks.summary_text(result.calls, result.novel, files).orderBy("sample_id").limit(20).collect():  # shown, not written
        print(f"{r['sample_id']}\n{r['value']}\n")


_DONE = "sample_id string, bam_path string, status string, message string"


def batch_command(spark: SparkSession, a: argparse.Namespace) -> None:
    """Types what the sheet holds and OUT/samples does not list as done; a file that cannot be read is a row of status error, and is tried again next time.

    All samples of an assay are one run.  A run that is cut off lists none of
    its samples, so the next call writes their files again, in place.
    """
    log = f"{a.out}/samples"
    spark.createDataFrame([], _DONE).write.mode("append").parquet(log)
    done = kept(spark.read.schema(_DONE).parquet(log).where("status = 'done'").select("sample_id").distinct())
    sheet = kept(callers.sample_sheet(spark, a.sheet, a.assay).join(done, "sample_id", "left_anti"))
    alleles = alleles_of(spark, a.sequences) if a.sequences else None
    more = {"sequences": alleles} if alleles is not None else {}
    for kind in sorted(r[0] for r in sheet.select("data_type").distinct().collect()):  # assays
        own = sheet.where(F.col("data_type") == kind)
        config = Config.create(kind)
        rows, errors = reads.sheet_rows(spark, own, alleles, a.build, config.preset.unmapped)
        sample = F.col("sample_id")
        first = rows.where((F.col("flag").bitwiseAND(reads.PRIMARY) == 0) & (F.col("seq") != "*"))
        if alleles is not None:
            more["reads"] = first.select("sample_id", F.col("name").alias("read_id"), "seq")
        result = typing_run.run(sequences.alignments_of(rows, sample), config, bases=sequences.aligned_bases(rows, sample, secondary=True), **more)
        outputs.write_run(result, a.out, config)
        told = own.join(errors, "sample_id", "left").withColumn("status", F.when(F.col("message").isNull(), "done").otherwise("error"))
        told.select("sample_id", "bam_path", "status", "message").coalesce(1).write.mode("append").parquet(log)
        for r in told.where("status = 'error'").orderBy("sample_id").limit(20).collect():  # shown, not written
            print(f"{r['sample_id']}: {r['message']}")


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("lociforge").getOrCreate()
    if a.command == "type":
        type_command(spark, a)
    elif a.command == "batch":
        batch_command(spark, a)
    elif a.command == "validate":
        key = lambda df, c, d: df.select(F.col("locus").alias("key"), F.col("a1").alias(c), F.col("a2").alias(d))
        found = evaluate.validate(key(callers.result_tsv(spark, a.results), "c1", "c2"), key(callers.result_tsv(spark, a.truth), "t1", "t2"))
        found.orderBy("key").show(100, False)
        right = found.agg(F.sum(F.greatest("matches", F.lit(0))), F.count("*")).first()
        print(f"{right[0] or 0} of {2 * right[1]} alleles")
    elif a.command == "benchmark":
        truth = callers.truth_tsv(spark, a.truth)
        calls = outputs.results_of(spark, a.results) if a.results else typing_run.run(spark.read.parquet(a.alignments), Config.create(a.assay)).calls
        name = os.path.splitext(os.path.basename(a.truth))[0]
        overall = outputs.write_benchmark(outputs.benchmark(truth, calls, a.resolution), a.out, name)
        print(f"accuracy {overall['accuracy']:.4f}, call rate {overall['call_rate']:.4f}")
        if a.depths:
            if not a.alignments:
                raise SystemExit("accuracy by depth needs --alignments")
            own = spark.read.parquet(a.alignments)
            present = truth.where("depth > 0").select("sample_id", F.col("depth").alias("_depth")).distinct()
            own = own.join(present, "sample_id")  # samples whose depth is known
            known = truth.join(present, "sample_id", "left_semi")
            curve = outputs.depth_accuracy(own, known, F.col("_depth"), Config.create(a.assay), [int(x) for x in a.depths.split(",")], a.resolution)
            for r in outputs.write_depths(curve, a.out, name):
                print(f"at {r['target']}: accuracy {r['accuracy']:.4f}, call rate {r['call_rate']:.4f}")
    elif a.command == "setup-db":
        if not os.path.isdir(a.folder):
            raise SystemExit(f"{a.folder} is not there: the engine fetches nothing, copy the reference first")
        release = found_release(a.folder, a.release)
        if a.release != "unknown":
            check_release(a.release, release)
        listed = os.path.join(a.folder, "Allelelist.txt")
        content = open(listed, "rb").read() if os.path.exists(listed) else b""
        files = [x for x in sorted(os.listdir(os.path.join(a.folder, "fasta"))) if x.endswith("_gen.fasta")] if os.path.isdir(os.path.join(a.folder, "fasta")) else []
        rows = [(x.removesuffix("_gen.fasta"), sequences.fasta(spark, os.path.join(a.folder, "fasta", x)).count()) for x in files]  # one small file a locus
        counts = spark.createDataFrame(rows, "locus string, n long")
        outputs.write_text(spark, os.path.join(a.folder, "imgt_lock.json"), sinks.lockfile(counts, release, "unknown", content))
        print(f"{a.folder}: release {release}")
    else:
        s = sequences.fasta(spark, a.fasta).select(F.lit("").alias("locus"), F.col("name").alias("allele"), "seq")
        sinks.write_fasta(sequences.non_redundant(s), a.out)


if __name__ == "__main__":
    main()
