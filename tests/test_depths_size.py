"""A run's evidence is made from one reading of the alignments, and depths are drawn by plain expressions."""

import random

from lociforge.operators import candidates, evaluate, matrix

SCHEMA = "sample_id int, read_id int, locus string, allele string, as_score int, mapq int, is_secondary boolean"


def rows(n=400):
    r = random.Random(4)
    some = lambda *x: r.choice(x)
    return [(some(1, 2, None), some(*range(30), None), some("A", "B"), some("A*01:01", "A*01:02", "A*02:01"), some(None, -3, 5, 9), some(0, 1, 60), some(True, False, None)) for _ in range(n)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_evidence_is_what_both_kinds_of_alignments_give(spark):
    data, kept = rows(), {(1, "A*01:01"), (1, "A*02:01"), (2, "A*01:02")}
    df = spark.createDataFrame(data, SCHEMA)
    for few in (None, kept):
        own = [x for x in data if few is None or (x[0], x[3]) in few]
        score = lambda x: x[4] if x[4] is not None else x[5]
        first = [x for x in own if x[6] is False and x[5] >= 1 and score(x) >= 2]
        seen = {(x[0], x[1]) for x in first if None not in x[:2]}
        want = {}
        for x, s in [(x, score(x)) for x in first] + [(x, x[4]) for x in own if x[6] and x[4] is not None and (x[0], x[1]) in seen]:
            key = (x[0], x[2], x[1], x[3])
            want[key] = max(want.get(key, s), s)
        found = matrix.evidence(df, few and spark.createDataFrame(sorted(few), "sample_id int, allele string"), 1, 2)
        assert {tuple(x)[:4]: x["score"] for x in found.collect()} == want and found.count() == len(want)


def test_evidence_deals_reads_once(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/a")
    text = plan(matrix.normalise(matrix.evidence(spark.read.parquet(f"{tmp_path}/a")), within_locus=True))
    assert text.count("Exchange ") == 1 and text.count("FileScan") == 1 and "Join" not in text


def test_candidates_are_found_among_sums(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/a")
    a = spark.read.parquet(f"{tmp_path}/a")
    found = spark.createDataFrame([(1, "A", "A*01:01"), (2, "B", "A*02:01")], "sample_id int, locus string, allele string")
    keys = ["sample_id", "locus", "allele"]
    some = candidates.refine(a, found=found)
    assert sorted(some.collect()) == sorted(candidates.refine(a.join(found, keys, "left_semi")).collect()) != []
    assert "Aggregate" in plan(some).split("Join")[-1]


def test_depths_are_drawn_without_lambdas(spark):
    reads = spark.createDataFrame([(i,) for i in range(300)], "read_id int")
    df = evaluate.depth_curve(reads, 60.0, (5, 20, 60))
    got = {t: {r["read_id"] for r in df.where(f"target = {t}").collect()} for t in (5, 20, 60)}
    assert got[5] < got[20] < got[60] == set(range(300)) and "lambda" not in plan(df)
    assert got[20] == {r["read_id"] for r in evaluate.downsample(reads, 0.33).collect()}
