"""Reads of alleles and of loci are counted in one pass."""

import re

from lociforge.operators import samples

from .test_depths_size import SCHEMA, plan, rows


def test_reads_are_dealt_once(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/a")
    text = plan(samples.third_allele(samples.read_counts(spark.read.parquet(f"{tmp_path}/a"))))
    assert text.count("FileScan") == 1 and len(re.findall(r"Exchange hashpartitioning\([^)]*read_id", text)) == 1 and "Join" not in text


def test_counts_are_of_different_reads(spark):
    data = rows()
    a = spark.createDataFrame(data, SCHEMA)
    counts = samples.read_counts(a)
    reads = lambda *at: {x[1] for x in data if x[1] is not None and (x[0], x[2], x[3])[: len(at)] == at}
    got = {(r["sample_id"], r["locus"], r["allele"]): (r["n"], r["total"]) for r in counts.collect()}
    assert got == {k: (len(reads(*k)), len(reads(*k[:2]))) for k in {(x[0], x[2], x[3]) for x in data}}
    key = lambda df: sorted(map(str, df.collect()))
    assert key(samples.depths(a)) == key(samples.depths(a, counts)) and key(samples.contamination(a)) == key(samples.contamination(a, counts=counts))
