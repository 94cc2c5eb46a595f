"""Names are parsed once."""

from pyspark.sql import functions as F

from lociforge.functions import names
from lociforge.plans import catalogue


def test_truncation_parses_a_name_once(spark):
    plan = catalogue.QUERIES["truncate_resolution"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^HLA-") == 1
    df = spark.createDataFrame([("HLA-A*01:02:03N",), ("B*07",), ("",), ("N",)], "name string")
    one = df.select("name", *[names.truncate(F.col("name"), n).alias(f"r{n}") for n in (1, 2)])._jdf.queryExecution().optimizedPlan().toString()
    assert one.count("^HLA-") == 2
    assert [tuple(r) for r in df.select(*[names.truncate(F.col("name"), n) for n in (1, 2)]).collect()][:2] == [("A*01N", "A*01:02N"), ("B*07", "B*07")]
