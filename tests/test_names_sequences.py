from pyspark.sql import functions as F

from lociforge.functions import names
from lociforge.functions import sequences as S


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first()[0]


def test_parse(spark):
    p = one(spark, "A*02:01:01:01", names.parse)
    assert (p.locus, p.field1, p.field2, p.field3, p.field4, p.suffix) == ("A", "02", "01", "01", "01", "")
    p = one(spark, "HLA-B*07:02", names.parse)
    assert (p.locus, p.field1, p.field2, p.field3) == ("B", "07", "02", "")
    assert one(spark, "A*02:01:01N", names.parse).suffix == "N"
    assert one(spark, "DRB1", names.parse).locus == "DRB"
    p = one(spark, "A", names.parse)  # a bare letter is a suffix
    assert (p.locus, p.suffix) == ("", "A")
    assert one(spark, None, names.parse) is None or one(spark, None, names.parse).locus is None


def test_forms(spark):
    assert one(spark, "A*02:01:01N", lambda x: names.four_digit(names.parse(x))) == "A*02:01"
    assert one(spark, "A*02", lambda x: names.four_digit(names.parse(x))) == "A*02"
    assert one(spark, "HLA-A*02:01:01N", lambda x: names.truncate(x, 2)) == "A*02:01N"
    assert one(spark, "A*02:01:01N", lambda x: names.full_name(names.parse(x))) == "A*02:01:01N"
    assert one(spark, "xyz", lambda x: names.truncate(x, 2)) == "xyz"


def test_frequency_and_groups(spark):
    df = spark.createDataFrame([("A*02:01",), ("HLA-A*02:01",), ("A*02:01:09",), ("Z*99",)], "name string")
    got = {r["name"]: r["frequency"] for r in names.frequency(df).collect()}
    assert got == {"A*02:01": 0.17, "HLA-A*02:01": 0.17, "A*02:01:09": 0.17, "Z*99": 1e-5}
    groups = spark.createDataFrame([("A*02:01", "A*02:01:01G")], "allele string, g_group string")
    got = {r["name"]: (r["g_group"], r["perfect"]) for r in names.g_group(df, groups).collect()}
    assert got["A*02:01"] == ("A*02:01:01G", True) and got["A*02:01:09"] == ("A*02:01:01G", False) and got["Z*99"] == ("Z*99", False)


def test_sequences(spark):
    assert len(one(spark, "ACGTACGT", lambda x: S.kmers(x, 4))) == 5
    assert one(spark, "ACNGTACGT", lambda x: S.kmers(x, 6)) == ["GTACGT"]
    assert one(spark, "ACG", lambda x: S.kmers(x, 4)) == []
    assert one(spark, "ATCG", S.reverse_complement) == "CGAT"
    assert one(spark, "!", S.phred_correct) == 0.0
    assert abs(one(spark, "I", S.phred_correct) - 0.9999) < 1e-9
    assert [(t.len, t.op) for t in one(spark, "10M2I5D", S.cigar)] == [(10, "M"), (2, "I"), (5, "D")]
    assert [one(spark, c, S.amino_acid) for c in ("TTT", "ATG", "TAA", "GGG", "NNN", "AT")] == ["F", "M", "*", "G", "?", "?"]
    df = spark.createDataFrame([("ACGT", "ACCTA")], "a string, b string")
    assert df.select(S.snp_distance(F.col("a"), F.col("b"))).first()[0] == 1
