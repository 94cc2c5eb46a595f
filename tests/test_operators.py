import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.config import Config, check_release
from lociforge.operators import candidates, evaluate, genotype, kernels, kmers, matrix, novel, posterior, reports, samples

SCORES = "sample_id long, locus string, read_id long, allele string, score int"


@pytest.fixture(scope="module")
def scores(spark):
    best = {1: ("A*02:01", "A*02:02"), 2: ("A*02:01",), 3: ("A*02:01",), 4: ("A*03:01", "A*03:02"), 5: ("A*03:01",)}
    rows = [(0, "A", r, a, 60 - 20 * i) for r, al in best.items() for i, a in enumerate(al)]
    return spark.createDataFrame(rows, SCORES)


def test_best_pair(scores):
    c = genotype.calls(matrix.normalise(scores)).first()
    assert {c["allele1"], c["allele2"]} == {"A*02:01", "A*03:01"} and (c["reads_explained"], c["total_reads"]) == (5, 5)
    m = genotype.max_coverage_pair(scores).first()
    assert (m["a1"], m["a2"], m["covered"]) == ("A*02:01", "A*03:01", 5)


def test_single_allele_is_trivial(spark):
    df = spark.createDataFrame([(0, "A", 1, "A*01:01", 5), (0, "A", 2, "A*01:01", 5)], SCORES)
    c = genotype.calls(matrix.normalise(df)).first()
    assert c["is_homozygous"] and c["status"] == "trivial" and c["allele1"] == c["allele2"]
    assert genotype.calls(matrix.normalise(df.where("false"))).count() == 0


def test_posteriors(scores):
    w = matrix.normalise(scores, within_locus=True)
    p = posterior.pair_posteriors(w)
    assert p.count() == 10 and abs(p.agg(F.sum("p")).first()[0] - 1) < 1e-9
    best = posterior.best_with_gap(p).first()
    assert (best["a1"], best["a2"]) == ("A*02:01", "A*03:01") and best["p"] > 0.9


def test_variational_weights(scores):
    rows = kernels.vb_em(matrix.normalise(scores)).collect()
    assert abs(sum(r["dosage"] for r in rows) - 1) < 1e-9 and abs(sum(r["weight"] for r in rows) - 1) < 1e-9
    assert all(np.isfinite(r["elbo"]) for r in rows)
    assert {r["allele"] for r in sorted(rows, key=lambda r: -r["dosage"])[:2]} == {"A*02:01", "A*03:01"}


def test_special_functions():
    assert abs(kernels.digamma(np.array([1.0]))[0] + 0.5772156649015329) < 1e-12
    assert abs(kernels.chi2_sf(3.841458820694124, 1) - 0.05) < 1e-9
    assert abs(kernels.chi2_sf(18.307038053275146, 10) - 0.05) < 1e-9


def test_bins():
    m = np.array([[0, 0, 0]] * 3 + [[1, 1, 1]] * 3)
    for f in (kernels.greedy_bins, kernels.signature_bins, kernels.spectral_bins):
        b = f(m)
        assert len(set(b[:3])) == 1 and len(set(b[3:])) == 1 and b[0] != b[3], f.__name__
    assert (kernels.signature_bins(np.zeros((4, 2), dtype=int)) == 0).all()


def test_copy_number(spark):
    rows = [(0, "DRB3", 2, 200), (0, "DRB4", 60, 200), (0, "DRB5", 180, 200), (1, "DRB3", 9, 3), (0, "A", 50, 200)]
    d = spark.createDataFrame(rows, "sample_id long, locus string, reads long, ref_reads long")
    got = {(r["sample_id"], r["locus"]): r for r in samples.copy_number(d).collect()}
    assert [got[0, x]["copies"] for x in ("DRB3", "DRB4", "DRB5")] == [0, 1, 2]
    assert (got[1, "DRB3"]["copies"], got[1, "DRB3"]["confidence"]) == (2, "LOW") and got[0, "A"]["method"] == "fixed"
    low = samples.copy_number(d.where("locus = 'DRB5'"), F.lit(0.05)).first()
    assert (low["copies"], low["method"]) == (0, "kmer_override")


def test_dropout(spark):
    rows = [(True, 100, 100, 0, 0.99), (True, 30, 100, 0, 0.99), (True, 40, 100, 3, 0.99), (False, 30, 100, 3, 0.5)]
    e = spark.createDataFrame(rows, "is_homozygous boolean, reads long, ref_reads long, n_het_sites long, posterior double")
    assert [r["risk"] for r in samples.dropout_risk(e).collect()] == ["NONE", "LOW", "HIGH", "NONE"]


def test_contamination(spark):
    def reads(shares, n=100, s=0):
        out, i = [], 0
        for a, share in shares.items():
            for _ in range(int(share * n)):
                out.append((s, "A", i, a))
                i += 1
        return out

    rows = reads({"A*01": 0.5, "A*02": 0.5}) + reads({"A*01": 0.4, "A*02": 0.35, "A*03": 0.25}, s=1) + reads({"A*01": 0.4, "A*02": 0.4, "A*03": 0.2}, 5, s=2)
    df = spark.createDataFrame(rows, "sample_id long, locus string, read_id long, allele string")
    got = {r["sample_id"]: r["is_contaminated"] for r in samples.contamination(df, loci=1).collect()}
    assert got == {0: False, 1: True, 2: False}


def test_compare(spark):
    cases = [("A*01:01", "A*02:01", "A*01:01", "A*02:01", 2), ("A*02:01", "A*01:01", "A*01:01", "A*02:01", 2), ("A*01:01", "A*09:01", "A*01:01", "A*02:01", 1), ("A*08:01", "A*09:01", "A*01:01", "A*02:01", 0), ("", "", "A*01:01", "A*02:01", -1), ("A*01:01:01:02", "A*02:01:07", "A*01:01", "A*02:01", 2), ("A*01:01", "", "A*01:01", "", 2)]
    df = spark.createDataFrame(cases, "c1 string, c2 string, t1 string, t2 string, want int")
    for r in df.select("want", evaluate.matches(*[F.col(c) for c in ("c1", "c2", "t1", "t2")]).alias("got")).collect():
        assert r["want"] == r["got"]
    a = evaluate.accuracy(spark.createDataFrame([(2,), (1,)], "matches int")).first()
    assert a["accuracy"] == 0.75 and a["call_rate"] == 1.0


def test_kmer_validation(spark):
    s = "ACGTTGCAGGCATTCAGGAC"
    al, rd = spark.createDataFrame([("x", s), ("y", s)], "k string, seq string"), spark.createDataFrame([("x", s)], "k string, seq string")
    got = {r["k"]: r for r in kmers.validate(kmers.depth_of_alleles(al, rd, ["k"], 5)).collect()}
    assert got["x"]["covered"] == 1.0 and got["x"]["concordant"] and got["y"]["covered"] == 0.0 and not got["y"]["concordant"]


def test_cigar_variants(spark):
    df = spark.createDataFrame([(1, 0, "4M1I3M2D2M", "ACGTGACCTT", "ACTTACCGGTT")], "id long, pos0 int, cigar string, query string, ref string")
    got = {(r["position"], r["kind"], r["ref_base"], r["alt_base"]) for r in novel.cigar_variants(df).collect()}
    assert got == {(2, "SNP", "T", "G"), (4, "INS", "-", "G"), (7, "DEL", "GG", "-")}


def test_novel_screen(spark):
    rows = [(95, 100, 0.0, 1.0, False), (60, 100, 0.0, 1.0, False), (60, 100, 0.5, 0.5, True), (1, 5, None, None, None)]
    e = spark.createDataFrame(rows, "explained long, total long, unexpected double, covered double, assembly_novel boolean")
    assert sorted((r["n_signals"], r["confidence"]) for r in novel.screen(e).collect()) == [(1, "LOW"), (4, "HIGH")]


def test_ambiguity(spark):
    rows = [(0.995, 0.5, 100, None, False, "short"), (0.8, 0.05, 5, None, False, "short"), (0.8, 0.05, 50, 2, False, "short"), (0.8, 0.05, 50, None, True, "exome")]
    e = spark.createDataFrame(rows, "posterior double, gap double, total_reads long, snp_diff int, same_protein boolean, data_type string")
    e = e.withColumn("phased", F.lit(True)).withColumn("n_het_sites", F.lit(2)).withColumn("kmer_coverage", F.lit(None).cast("double")).withColumn("is_homozygous", F.lit(False))
    assert [r["reason"] for r in reports.ambiguity(e).collect()] == ["unambiguous", "low_depth", "close_alleles", "exon_only"]


def test_prefilter_ties(spark):
    df = spark.createDataFrame([(0, "A", a, 5) for a in ["A*01:01"] * 3 + ["A*02:01"] * 3 + ["A*03:01"]], "sample_id long, locus string, allele string, mapq int")
    assert [r["allele"] for r in candidates.prefilter(df, 1).collect()] == ["A*01:01"]


def test_config():
    c = Config.create("hifi", "transplant")
    assert c.resolution == 2 and c.clinical and c.strict and len(c.loci) == 6 and c.preset.k == 31
    with pytest.raises(ValueError):
        Config.create("nothing")
    check_release("3.50", "unknown")
    with pytest.raises(ValueError):
        check_release("3.50", "3.49")
