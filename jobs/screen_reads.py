"""Screening of arriving reads against a panel of alleles, incrementally.

    python -m jobs.screen_reads READS PANEL OUT [--config FILE]

READS is a folder (or a glob) of Parquet files to which files are added as
runs of a sequencer end.  Each call takes the files that no call before has
taken, finds the alleles that share seeds with each read, and adds them to OUT
as alignments (Parquet, partitioned by batch and sample), which the command
`type` and the job triage_cohort read; then it ends.  The checkpoint of the
stream is kept in OUT/_checkpoint: it belongs to the output, and both are
deleted together if all is to be done anew.  A batch that was cut off is
written again under its number, in place of what is there of it, so reruns and
retries leave each file's reads once.
"""

from __future__ import annotations

import argparse
import logging
import tomllib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lociforge.operators import kmers
from lociforge.plans.adapter import bases
from lociforge.sources import sequences

LOG = logging.getLogger("jobs.screen_reads")
SCHEMA = "read_id {read}, locus string, allele string, as_score int, mapq int, is_secondary boolean, batch long, sample_id {sample}"


def config_of(path: str | None = None) -> dict:
    """The settings of the file beside this module, with those of another file in their place."""
    out = tomllib.loads(Path(__file__).with_suffix(".toml").read_text())
    more = tomllib.loads(Path(path).read_text()) if path else {}
    return {part: values | more.get(part, {}) for part, values in out.items()}


def _sequence(expression: str, texts: bool):
    return bases(F.expr(expression)) if texts else F.upper(F.expr(expression))


def panel_of(spark: SparkSession, path: str, c: dict) -> DataFrame:
    """(locus, allele, seq) of the panel."""
    p = c["panel"]
    rows = sequences.fasta(spark, path) if p["format"] == "fasta" else spark.read.parquet(path)
    return rows.select(F.expr(p["locus"]).alias("locus"), F.expr(p["allele"]).alias("allele"), _sequence(p["seq"], c["seeds"]["texts"]).alias("seq"))


def screened(reads: DataFrame, panel: DataFrame, c: dict) -> DataFrame:
    """Rows of `reads` as alignments to the panel; a read without enough seeds of any allele has none."""
    r = c["reads"]
    own = reads.select(F.expr(r["sample_id"]).alias("sample_id"), F.expr(r["read_id"]).alias("read_id"), _sequence(r["seq"], c["seeds"]["texts"]).alias("seq"))
    return kmers.seed_hits(own, panel, c["seeds"]["k"], c["seeds"]["least"])


def run(spark: SparkSession, reads: str, panel: str, out: str, config: dict | None = None) -> DataFrame:
    """Takes the new files of `reads`, waits until they are written, and returns the whole of `out` as read back."""
    c = {part: values | (config or {}).get(part, {}) for part, values in config_of().items()}
    alleles = panel_of(spark, panel, c)
    files = spark.readStream.schema(c["reads"]["schema"]).option("maxFilesPerTrigger", c["reads"]["max_files"]).parquet(reads)
    hits = f"{out}/hits"

    def take(batch: DataFrame, number: int) -> None:
        rows = screened(batch, alleles, c).withColumn("batch", F.lit(number))
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "sample_id").parquet(hits)
        LOG.info("batch %d: read %d rows from %s", number, batch.count(), reads)

    query = files.writeStream.foreachBatch(take).option("checkpointLocation", f"{out}/_checkpoint").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()
    kinds = spark.createDataFrame([], c["reads"]["schema"]).select(F.expr(c["reads"]["read_id"]).alias("r"), F.expr(c["reads"]["sample_id"]).alias("s")).dtypes
    schema = SCHEMA.format(read=kinds[0][1], sample=kinds[1][1])
    # Without any hit so far there is no folder yet; an empty append makes it, without a file that readers see.
    spark.createDataFrame([], schema).write.mode("append").partitionBy("batch", "sample_id").parquet(hits)
    back = spark.read.schema(schema).parquet(hits)
    n = back.agg(F.count("*"), F.countDistinct("sample_id", "read_id"), F.max("batch")).first()
    LOG.info("%s holds %d alignments of %d reads, up to batch %s", hits, n[0], n[1], n[2])
    return back


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="screen_reads", description="arriving reads against a panel of alleles, incrementally")
    p.add_argument("reads", help="folder or glob of Parquet files of reads")
    p.add_argument("panel", help="alleles: Parquet, or FASTA by the settings")
    p.add_argument("out", help="folder of the alignments and of the stream's checkpoint")
    p.add_argument("--config", help="TOML file with settings in place of screen_reads.toml's")
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName("screen_reads").getOrCreate()
    try:
        run(spark, a.reads, a.panel, a.out, config_of(a.config))
    finally:
        spark.stop()


if __name__ == "__main__":
    main()
