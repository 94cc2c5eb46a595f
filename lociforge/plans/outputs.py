"""Every file of a typing run, and the evaluation of calls against truth.

Texts of samples are built by the cluster and written one file a sample; only
the manifest and the lock, which hold no rows, are made on the driver.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..operators import evaluate, novel
from ..sources import sinks
from ..storage import kept, tabled
from . import typing_run

VERSION = "1"


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small document as one file, on whatever file system the path names."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(text.encode()))
    out.close()


def write_run(result: typing_run.Result, out: str, config: Config, groups: DataFrame | None = None, release: str = "unknown", commit: str = "unknown", contig_alignments: DataFrame | None = None, alleles: DataFrame | None = None) -> list[str]:
    """Writes a run's files below `out` and returns their names.

    hla_types.tsv, hla_types.json, ambiguity.tsv, qc_report.json and
    qc_dashboard.html always; novel_alleles.json for contig_alignments(
    sample_id, locus, allele, pos0, cigar, query, ref) of screened loci;
    clinical_summary.txt and .json if the run is clinical; manifest.json and
    imgt_lock.json (counts of alleles(locus, allele)) if it is strict.
    """
    spark = result.calls.sparkSession
    head = sinks.provenance(release, commit, VERSION, config.assay, config.resolution)
    one = lambda df: df.withColumnRenamed("json", "value")
    sinks.write_types(result.calls, f"{out}/hla_types.tsv", head, groups)
    sinks.write_samples(one(sinks.call_json(result.calls, result.alternatives)), f"{out}/hla_types.json")
    ranked = sinks.ambiguity_rows(result.calls, result.alternatives).withColumn("posterior", F.format_string("%.6f", "posterior"))
    sinks.write_samples(sinks.lines(ranked, ("locus", "rank", "a1", "a2", "posterior"), ["locus", "rank"]), f"{out}/ambiguity.tsv")
    sinks.write_samples(one(sinks.qc_json(result.qc_loci, result.qc_summary)), f"{out}/qc_report.json")
    shown = result.qc_loci.select("sample_id", "locus", "allele1", "allele2", "confidence", "posterior", "gap", "evidence", "kmer_ok", "reads_explained", "total_reads", "n_het_sites", "phased", "balance", "issues", "passed", "flags")
    sinks.write_samples(sinks.dashboard(shown), f"{out}/qc_dashboard.html")
    files = ["hla_types.tsv", "hla_types.json", "ambiguity.tsv", "qc_report.json", "qc_dashboard.html"]
    if contig_alignments is not None:
        wanted = contig_alignments.join(result.novel.select("sample_id", "locus"), ["sample_id", "locus"], "left_semi")
        sinks.write_samples(sinks.novel_json(novel.annotate_alignments(wanted)), f"{out}/novel_alleles.json")
        files.append("novel_alleles.json")
    if config.clinical:
        sinks.write_samples(sinks.clinical_text(result.clinical_loci, result.clinical_summary, config.assay, release, VERSION), f"{out}/clinical_summary.txt")
        sinks.write_samples(sinks.clinical_json(result.clinical_loci, result.clinical_summary), f"{out}/clinical_summary.json")
        files += ["clinical_summary.txt", "clinical_summary.json"]
    if config.strict:
        write_text(spark, f"{out}/manifest.json", sinks.manifest(config, release))
        counts = (alleles if alleles is not None else result.candidates.select("locus", "allele").distinct()).groupBy("locus").agg(F.count("*").alias("n"))
        listed = alleles if alleles is not None else result.candidates
        digest = listed.select(F.bit_xor(F.xxhash64("locus", "allele"))).first()[0]
        write_text(spark, f"{out}/imgt_lock.json", sinks.lockfile(counts, release, commit, str(digest).encode()))
        files += ["manifest.json", "imgt_lock.json"]
    return files


def benchmark(truth: DataFrame, calls: DataFrame, fields: int = 2) -> dict[str, DataFrame]:
    """Accuracy overall, by locus and by ancestry, and discordant calls, of truth(sample_id, locus, t1, t2, ancestry, ...).

    All samples are one job.  Samples without any call are left out, loci
    without one are no calls.
    """
    typed = truth.join(calls.select("sample_id").distinct(), "sample_id", "left_semi")
    compared = kept(evaluate.against_truth(typed, calls, fields))
    return {
        "overall": evaluate.accuracy(compared), "locus": evaluate.accuracy(compared, "locus"),
        "ancestry": evaluate.accuracy(compared, "ancestry", "locus"), "discordant": evaluate.discordant(compared),
    }


def depth_accuracy(alignments: DataFrame, truth: DataFrame, depth: float | Column, config: Config | None = None, targets=(5, 10, 20, 30, 50, 100), fields: int = 2) -> DataFrame:
    """(target, counters, accuracy, call_rate): runs on the reads of each target depth against truth(sample_id, locus, t1, t2).

    One run types all samples at all depths, as samples of their own.  depth:
    the present one, a number or a column of the alignments.  A locus of the
    truth that a depth leaves without a call is a no call there.
    """
    name = F.concat(F.col("target").cast("string"), F.lit("|"), F.col("sample_id").cast("string"))
    sampled = evaluate.depth_curve(alignments, depth, targets)
    # Most stages of a run start from the alignments: hashes of reads are made once, not in each.
    calls = typing_run.run(tabled(sampled.withColumn("sample_id", name).drop("target")), config).calls
    wanted = truth.withColumn("target", F.explode(F.array(*[F.lit(t) for t in targets]))).withColumn("sample_id", name)
    return evaluate.accuracy(evaluate.against_truth(wanted, calls, fields), "target")


def results_of(spark: SparkSession, folder: str) -> DataFrame:
    """(sample_id, locus, allele1, allele2) of the types tables of many samples below a folder."""
    t = spark.read.text(f"{folder}/*/", pathGlobFilter="*.t*").select(F.regexp_extract(F.input_file_name(), r"(?:sample_id=)?([^/=]+)/[^/]+$", 1).alias("sample_id"), F.split("value", "\t").alias("f"))
    rows = t.where((F.size("f") >= 3) & F.get("f", F.lit(1)).isin("1", "2"))
    pick = lambda c: F.coalesce(F.max(F.when(F.get("f", F.lit(1)) == c, F.get("f", F.lit(2)))), F.lit(""))
    return rows.groupBy("sample_id", F.regexp_replace(F.get("f", F.lit(0)), "^HLA-", "").alias("locus")).agg(pick("1").alias("allele1"), pick("2").alias("allele2"))


def write_depths(curve: DataFrame, path: str, name: str) -> list[dict]:
    """The curve as one JSON file, a few targets; returns its rows."""
    rows = [r.asDict() for r in curve.orderBy("target").collect()]
    write_text(curve.sparkSession, f"{path}/depth_curve_{name}.json", json.dumps({"depths": rows}, indent=2))
    return rows


def write_benchmark(report: dict[str, DataFrame], path: str, name: str) -> dict:
    """The report as one JSON file; returns its overall figures."""
    overall = report["overall"].first().asDict()
    loci = [r.asDict() for r in report["locus"].orderBy("locus").collect()]
    by = [r.asDict() for r in report["ancestry"].orderBy("ancestry", "locus").collect()]  # loci x ancestries
    write_text(report["overall"].sparkSession, f"{path}/benchmark_{name}.json", sinks.benchmark_json(overall | {"by_ancestry": by}, loci, report["discordant"]))
    return overall
