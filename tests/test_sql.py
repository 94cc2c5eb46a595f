"""The SQL functions against the column functions and operators."""

import random

from pyspark.sql import functions as F

from lociforge.functions import names, sql
from lociforge.functions import sequences as S
from lociforge.operators import evaluate, novel

NAMES = ["A*02:01:01:01", "HLA-B*07:02", "A*02:01:01N", "DRB1*15", "C0401", "", "N", "HLA-A*", "A*24:02:01:02L", None, "DQB1*03:01:01:01:09"]


def test_names(spark):
    assert set(sql.register(spark)) == set(sql.register(spark)) == {*sql.SCALARS, *sql.TABLES, "alignment_variants"}
    df = spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id int, name string")
    df.createOrReplaceTempView("sql_names")
    for fields in (1, 2, 4):
        got = spark.sql(f"select id, parse_allele(name) p, truncate_allele(name, {fields}) t from sql_names order by id").collect()
        want = df.select("id", names.parse(F.col("name")).alias("p"), names.truncate(F.col("name"), fields).alias("t")).orderBy("id").collect()
        assert got == want
    assert spark.sql("select parse_allele('HLA-A*02:01N').suffix").first()[0] == "N"


def test_matches(spark):
    sql.register(spark)
    rnd = random.Random(1)
    some = ["A*01:01", "A*01:02:01", "HLA-A*01:01:02", "A*02:01", ""]
    df = spark.createDataFrame([(i, *rnd.choices(some, k=4)) for i in range(200)], "id int, c1 string, c2 string, t1 string, t2 string")
    df.createOrReplaceTempView("sql_pairs")
    got = spark.sql("select id, matching_alleles(c1, c2, t1, t2, 2) m from sql_pairs").collect()
    assert {tuple(r) for r in got} == {tuple(r) for r in df.select("id", evaluate.matches(*map(F.col, ("c1", "c2", "t1", "t2")))).collect()}


def test_sequences(spark):
    sql.register(spark)
    seqs = ["ACGTACGTAC", "ACNGTACGTA", "ACG", "", None, "acgtRACGTT"]
    df = spark.createDataFrame(list(enumerate(seqs)), "id int, seq string")
    df.createOrReplaceTempView("sql_seqs")
    got = spark.sql("select s.id, k.position, k.kmer, k.canonical from sql_seqs s, lateral kmers(s.seq, 4) k").collect()
    comp = str.maketrans("ACGTacgt", "TGCAtgca")
    want = {(i, j, w, min(w, w[::-1].translate(comp))) for i, s in enumerate(seqs) if s for j in range(len(s) - 3) for w in [s[j : j + 4]] if set(w) <= set("ACGTacgt")}
    assert {tuple(r) for r in got} == want and len(got) == len(want)
    row = spark.sql("select reverse_complement('AACG'), canonical_kmer('TTT'), phred_error('I'), alignment_identity('10M2I3D5S', 5), alignment_identity('*', 1)").first()
    assert row[0] == "CGTT" and row[1] == "AAA" and abs(row[2] - 1e-4) < 1e-12 and abs(row[3] - 10 / 15) < 1e-12 and row[4] == 0.0
    assert abs(spark.range(1).select(S.identity(F.lit("10M2I3D5S"), F.lit(5))).first()[0] - row[3]) < 1e-12
    plan = spark.sql("select truncate_allele(seq, 2) from sql_seqs")._jdf.queryExecution().optimizedPlan().toString()
    assert "PythonUDF" not in plan


def test_variants(spark):
    sql.register(spark)
    rnd = random.Random(2)
    rows = []
    for i in range(60):
        ref = "".join(rnd.choices("ACGTN", k=80))
        cigar, q, r = "", 0, 5
        for op in rnd.choices("MMMIDSN=X", k=4):
            n = rnd.randrange(1, 9)
            cigar += f"{n}{op}"
        rows.append((i, 5, cigar, "".join(rnd.choices("ACGT", k=40)), ref))
    rows.append((99, 0, None, "ACGT", "ACGT"))
    df = spark.createDataFrame(rows, "id int, pos0 int, cigar string, query string, ref string")
    df.createOrReplaceTempView("sql_alignments")
    got = spark.sql("select a.id, v.* from sql_alignments a, lateral alignment_variants(a.pos0, a.cigar, a.query, a.ref) v").collect()
    assert sorted(tuple(r) for r in got) == sorted(tuple(r) for r in novel.cigar_variants(df).select("id", "position", "ref_base", "alt_base", "kind").collect()) and got
