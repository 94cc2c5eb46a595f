"""Reports of alignments deal no more than the keys of the lines they come from."""

import pytest

from lociforge.operators import novel
from lociforge.plans import catalogue


@pytest.mark.parametrize("name", ["cigar_variants", "novel_report", "variant_summary"])
def test_only_keys_are_dealt(spark, name):
    plan = catalogue.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == plan.count("Exchange ") == 1 and "Join" not in plan


def test_alignments_without_differences(spark):
    df = spark.createDataFrame([(1, 0, "4M", "ACGT", "ACGT"), (2, 1, "2M1I1M", "CGAT", "ACGTT"), (3, 0, "2M3D2M", "ACGT", "AC")], "id long, pos0 int, cigar string, query string, ref string")
    rows = novel.listed_report(df, novel.F.length("query")).collect()
    assert {r["id"]: (r["n_snps"], r["n_ins"], r["n_del"], r["identity"]) for r in rows} == {1: (0, 0, 0, 1.0), 2: (0, 1, 0, 0.75), 3: (0, 0, 1, 0.75)}
    assert {r["id"]: r["text"].split(". ")[-1] for r in novel.summary(novel.listed_report(df, novel.F.length("query"))).collect() if r["id"] > 1} == {2: "3:->A", 3: "2:?>-"}
