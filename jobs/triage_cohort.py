"""Triage of a cohort: first calls of every sample and locus, and which of them need a whole run.

    python -m jobs.triage_cohort ALIGNMENTS OUT [--config FILE]

Reads alignments (Parquet) of any number of samples and writes one row a
sample and locus, partitioned by locus, as Parquet: candidates are cut as in a
whole run, the two alleles of most evidence and the likeliest pair found, copy
numbers applied, contaminated samples marked.  What it leaves out are phasing,
k-mers and assembly; `needs_run` marks loci whose evidence asks for those.
The output is replaced as a whole, so a rerun gives the same.
"""

from __future__ import annotations

import argparse
import logging
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.config import Config
from lociforge.operators import candidates, genotype, matrix, posterior, reports, samples
from lociforge.storage import kept

LOG = logging.getLogger("jobs.triage_cohort")
LOCUS = ["sample_id", "locus"]
SCHEMA = (
    "sample_id {sample}, allele1 string, allele2 string, confidence string, posterior double, gap double, copies int, status string, "
    "reads_explained long, total_reads long, is_contaminated boolean, needs_run boolean, locus string"
)


def config_of(path: str | None = None) -> dict:
    """The settings of the file beside this module, with those of another file in their place."""
    out = tomllib.loads(Path(__file__).with_suffix(".toml").read_text())
    return out | (tomllib.loads(Path(path).read_text()) if path else {})


def triage(alignments: DataFrame, c: Config) -> DataFrame:
    """alignments to SCHEMA's columns; a sample without a call for a locus has no row, an empty cohort no rows."""
    a = alignments.where(F.col("locus").isin(*c.loci))
    found = candidates.prefilter(a, c.preset.candidates).select(*LOCUS, "allele")
    # What several stages start from is kept: a plan of all of them would count the alignments once for each use.
    refined = kept(candidates.refine(a, four=c.preset.refined, found=found).select("sample_id", "allele").distinct())
    # Both weights are made where a read's evidence already is; reads dealt again would be as many rows.
    weights = kept(matrix.normalise(matrix.normalise(matrix.evidence(a, refined)).withColumnRenamed("weight", "_whole"), within_locus=True))
    counts = kept(samples.read_counts(a))
    copies = kept(samples.copy_number(samples.depths(a, counts)))
    genotypes = kept(samples.apply_copy_number(genotype.calls(weights.withColumn("weight", F.col("_whole")).drop("_whole")), copies))
    best = kept(posterior.best_with_gap(posterior.pair_posteriors(weights.drop("_whole"))))
    calls = reports.at_resolution(reports.compile_calls(genotypes, best), c.resolution, c.assay)
    needs = reports.assembly_trigger(F.col("posterior"), F.lit(None).cast("boolean"), F.col("evidence"), F.col("reads_explained"), c.preset.assembly_trigger)
    mixed = samples.contamination(a, counts=counts).select("sample_id", "is_contaminated")
    out = calls.join(copies.select(*LOCUS, "copies"), LOCUS, "left").join(mixed, "sample_id", "left").withColumn("needs_run", needs)
    return out.select(
        "sample_id", "allele1", "allele2", "confidence", "posterior", "gap", F.col("copies").cast("int").alias("copies"), "status",
        "reads_explained", "total_reads", "is_contaminated", "needs_run", "locus",
    )


def run(spark: SparkSession, alignments: str, out: str, config: dict | None = None) -> DataFrame:
    """Reads `alignments`, replaces `out` and returns it as read back."""
    given = config_of() | (config or {})
    rows = spark.read.parquet(alignments)
    LOG.info("read %d rows from %s", rows.count(), alignments)
    a = spark.sql(given["view"], rows=rows) if given["view"] else rows
    c = Config.create(given["assay"], resolution=given["resolution"], **({"loci": tuple(given["loci"])} if given["loci"] else {}))
    # A locus's rows are few for each sample; AQE joins or splits the write's partitions by their size.
    triage(a, c).repartition("locus").write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("locus").parquet(out)
    back = spark.read.schema(SCHEMA.format(sample=a.schema["sample_id"].dataType.simpleString())).parquet(out)
    n = back.agg(F.count("*"), F.count_if("needs_run"), F.countDistinct("sample_id")).first()
    LOG.info("wrote %d calls of %d samples to %s, %d need a whole run", n[0], n[2], out, n[1])
    return back


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="triage_cohort", description="first calls of a cohort, and the loci that need a whole run")
    p.add_argument("alignments", help="Parquet of alignments")
    p.add_argument("out", help="folder of the calls, replaced as a whole")
    p.add_argument("--config", help="TOML file with settings in place of triage_cohort.toml's")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("triage_cohort").getOrCreate()
    try:
        run(spark, a.alignments, a.out, config_of(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
