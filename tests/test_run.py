"""A whole run from SAM text, its files, and the commands."""

import glob
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge import __main__ as cli
from lociforge import storage
from lociforge.config import Config
from lociforge.operators import candidates, evaluate, kmers, matrix, novel, phasing, posterior
from lociforge.plans import outputs, typing_run
from lociforge.sources import sequences

RND = random.Random(3)
BASE = "".join(RND.choice("ACGT") for _ in range(240))


def changed(s, *at):
    return "".join("ACGT"[("ACGT".index(c) + 1) % 4] if i in at else c for i, c in enumerate(s))


SEQS = {"A*01:01": BASE, "A*02:01": changed(BASE, 20, 60, 110, 150, 200), "A*03:01": changed(BASE, 30, 70, 130, 170, 210), "B*07:02": BASE[::-1]}


@pytest.fixture(scope="module")
def sam_file(tmp_path_factory):
    """Reads of A*01:01 and A*02:01, each aligned to all three alleles of A, and a few of B*07:02."""
    d = tmp_path_factory.mktemp("sam")
    out, n = ["@HD\tVN:1.6"], 0
    for own, reads in (("A*01:01", 30), ("A*02:01", 30), ("B*07:02", 3)):
        for _ in range(reads):
            at, n = RND.randrange(0, 120), n + 1
            seq = SEQS[own][at : at + 120]
            order = sorted((a for a in SEQS if a[0] == own[0]), key=lambda a: a != own)
            for i, a in enumerate(order):
                wrong = sum(x != y for x, y in zip(seq, SEQS[a][at : at + 120]))
                out.append(f"read{n}\t{256 if i else 0}\tHLA-{a}\t{at + 1}\t{60 if not i else 0}\t120M\t*\t0\t0\t{seq}\t{'I' * 120}\tNM:i:{wrong}\tAS:i:{max(0, 240 - 110 * wrong)}")
    (d / "x.sam").write_text("\n".join(out) + "\n")
    (d / "alleles.fa").write_text("".join(f">HLA:{i} {a} 240 bp\n{s}\n" for i, (a, s) in enumerate(SEQS.items())))
    return d


def test_run_from_sam(spark, sam_file):
    rows = sequences.sam(spark, f"{sam_file}/x.sam")
    seqs = cli.alleles_of(spark, f"{sam_file}/alleles.fa")
    assert {r["allele"]: r["seq"] for r in seqs.collect()} == SEQS
    reads = rows.where("flag = 0").select(F.lit("s").alias("sample_id"), F.col("name").alias("read_id"), "seq")
    r = typing_run.run(sequences.alignments_of(rows, "s"), Config.create(clinical=True), bases=sequences.aligned_bases(rows, "s", secondary=True), sequences=seqs, reads=reads)
    calls = {x["locus"]: x for x in r.calls.collect()}
    assert {calls["A"]["allele1"], calls["A"]["allele2"]} == {"A*01:01", "A*02:01"} and calls["A"]["confidence"] == "HIGH" and calls["A"]["phased"]
    # Three reads of one candidate are no sure call.
    assert calls["B"]["allele1"] == "B*07:02" and abs(calls["B"]["posterior"] - 0.15) < 1e-12 and calls["B"]["confidence"] == "VERY_LOW"
    bins = {x["read_id"]: x["bin"] for x in r.bins.where("locus = 'A'").collect()}
    own = {k: b for k, b in bins.items() if b >= 0}
    first = {own[k] for k in own if int(k[4:]) <= 30}
    assert len(own) > 40 and len(first) == 1 and {own[k] for k in own if int(k[4:]) > 30} == {1 - first.pop()}
    assert {x["allele"] for x in r.phased.collect()} == {"A*01:01", "A*02:01"}
    assert abs(sum(x["weight"] for x in r.weights.where("locus = 'A'").collect()) - 1) < 1e-9
    k = {x["locus"]: x for x in r.kmers.collect()}
    assert k["A"]["covered"] > 0.9 and k["A"]["concordant"]
    reason = {x["locus"]: x for x in r.ambiguity.collect()}
    assert reason["A"]["reason"] == "unambiguous" and reason["B"]["reason"] == "low_depth"
    clinic = r.clinical_summary.first()
    assert clinic["n_reported"] == 1 and clinic["withheld"] == "B"
    assert r.assembly_needed.collect()[0]["locus"] == "B"


@pytest.mark.parametrize("reads,posterior_,tier", [(1, 0.05, "VERY_LOW"), (3, 0.15, "VERY_LOW"), (11, 0.55, "LOW"), (19, 0.95, "MEDIUM"), (20, 1.0, "HIGH"), (40, 1.0, "HIGH")])
def test_confidence_of_one_candidate(spark, reads, posterior_, tier):
    df = spark.createDataFrame([("s", "A", f"r{i}", "A*01:01", 5) for i in range(reads)], "sample_id string, locus string, read_id string, allele string, score int")
    best = posterior.best_with_gap(posterior.pair_posteriors(matrix.normalise(df, within_locus=True))).withColumn("tier", posterior.tier(F.col("p"), F.col("gap"))).collect()
    assert [(round(r["p"], 9), r["tier"]) for r in best] == [(posterior_, tier)]
    assert posterior.pair_posteriors(matrix.normalise(df.where("false"), within_locus=True)).count() == 0


def test_pairs_by_weight(spark):
    rnd = np.random.default_rng(1)
    rows = [(0, "A", r, f"A*{a:02d}:01", int(rnd.integers(1, 60))) for r in range(40) for a in rnd.choice(12, 4, replace=False)]
    w = matrix.normalise(spark.createDataFrame(rows, "sample_id long, locus string, read_id long, allele string, score int"), within_locus=True)
    weights = w.groupBy("sample_id", "locus", "allele").agg(F.sum("weight").alias("weight"))
    every = {(r["a1"], r["a2"]): r for r in posterior.pair_posteriors(w).collect()}
    some = {(r["a1"], r["a2"]): r for r in posterior.pair_posteriors(w, weights, 10).collect()}
    by = {r["allele"]: r["weight"] for r in weights.collect()}
    want = sorted(every, key=lambda p: (-round(by[p[0]] + by[p[1]], 9), p))[:10]
    assert set(some) == set(want) and abs(sum(r["p"] for r in some.values()) - 1) < 1e-9 and len(every) == 78
    # Brute force over reads x pairs.
    held = {}
    for r in w.collect():
        held.setdefault(r["read_id"], {})[r["allele"]] = r["weight"]
    for (a, b), r in every.items():
        ll = sum(np.log((x.get(a, 0) + x.get(b, 0)) / 2) if x.get(a, 0) + x.get(b, 0) > 0 else np.log(1e-10) for x in held.values())
        assert abs(ll - r["ll"]) < 1e-6
        if (a, b) in some:
            assert abs(some[a, b]["ll"] - ll) < 1e-6


def test_files_of_a_run(spark, sam_file, tmp_path, capsys):
    out = str(tmp_path / "out")
    cli.main(["type", f"{sam_file}/x.sam", out, "--sequences", f"{sam_file}/alleles.fa", "--clinical", "--strict", "--sample", "s1"])
    text = lambda name: open(glob.glob(f"{out}/{name}/sample_id=s1/part-*")[0]).read()
    types = text("hla_types.tsv").splitlines()
    assert sum(x.startswith("##") for x in types) == 5 and types[5].split("\t")[:3] == ["Locus", "Chromosome", "Allele"] and len(types) == 10
    assert [x.split("\t")[2] for x in types[6:8]] == ["A*01:01", "A*02:01"]
    doc = json.loads(text("hla_types.json"))
    assert set(doc) == {"A", "B"} and doc["A"]["alternatives"][0]["rank"] == 2
    assert text("ambiguity.tsv").splitlines()[1].split("\t")[:4] == ["A", "1", "A*01:01", "A*02:01"]
    assert json.loads(text("qc_report.json"))["summary"]["n_loci"] == 2 and "<td>A*01:01</td>" in text("qc_dashboard.html")
    assert "Withheld: B" in text("clinical_summary.txt") and len(json.loads(text("clinical_summary.json"))["loci"]) == 1
    assert json.load(open(f"{out}/imgt_lock.json"))["total"] == 4 and "pyspark" in json.load(open(f"{out}/manifest.json"))["packages"]
    said = capsys.readouterr().out
    assert "HLA-A" in said and "A*02:01" in said and "clinical_summary.txt" in said
    # The same tables, evaluated.
    truth = tmp_path / "t.tsv"
    truth.write_text("SampleID\tLocus\tAllele1\tAllele2\tAncestry\ns1\tA\tA*02:01\tA*01:01\tEUR\ns1\tB\tB*07:02\tB*08:01\tEUR\ns9\tA\tA*01:01\tA*01:01\tEUR\n")
    cli.main(["benchmark", str(truth), out, "--results", f"{out}/hla_types.tsv"])
    report = json.load(open(f"{out}/benchmark_t.json"))
    assert report["overall"]["n_samples"] == 2 and report["overall"]["accuracy"] == 0.75 and [r["locus"] for r in report["discordant"]] == ["B"]


def test_commands(spark, tmp_path, capsys):
    db = tmp_path / "db"
    (db / "fasta").mkdir(parents=True)
    (db / "release_version.txt").write_text("IMGT 3.55.0\n")
    (db / "Allelelist.txt").write_text("# x\n")
    (db / "fasta" / "A_gen.fasta").write_text(">a 1\nAC\n>b 2\nGT\n")
    cli.main(["setup-db", str(db), "--release", "3.55.0"])
    assert json.load(open(db / "imgt_lock.json"))["counts"] == {"A": 2} and "3.55.0" in capsys.readouterr().out
    with pytest.raises(ValueError):
        cli.main(["setup-db", str(db), "--release", "3.1"])
    with pytest.raises(SystemExit):
        cli.main(["setup-db", str(tmp_path / "none")])
    (tmp_path / "p.fa").write_text(">a\nACGT\n>b\nACGT\n>c\nAC\n")
    cli.main(["build-panel", str(tmp_path / "p.fa"), str(tmp_path / "panel")])
    assert sorted(r[0] for r in sequences.fasta(spark, str(tmp_path / "panel")).collect()) == [("a"), ("c")]
    (tmp_path / "r.tsv").write_text("Locus\tChromosome\tAllele\nA\t1\tA*01:01\nA\t2\tA*02:01\n")
    cli.main(["validate", str(tmp_path / "r.tsv"), str(tmp_path / "r.tsv")])
    assert "2 of 2 alleles" in capsys.readouterr().out


def test_headers_with_angle_brackets(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">A*01 c.1A>G note\r\nac\r\ngt\r\n>A*02 x>y\nGG\n")
    assert {r["name"]: r["seq"] for r in sequences.fasta(spark, str(tmp_path / "x.fa")).collect()} == {"A*01": "ACGT", "A*02": "GG"}


def test_base_quality_and_deletions(spark, tmp_path):
    rows = "".join(f"r{i}\t0\tA*01:01\t1\t60\t2M1D2M\t*\t0\t0\tAC{'G' if i % 2 else 'T'}T\tII{q}I\n" for i, q in enumerate("I" * 6))
    (tmp_path / "a.sam").write_text(rows)
    b = sequences.aligned_bases(sequences.sam(spark, str(tmp_path / "a.sam")), "s")
    assert sorted({(r["pos"], r["base"]) for r in b.collect()}) == [(0, "A"), (1, "C"), (3, "G"), (3, "T"), (4, "T")]
    assert [r["pos"] for r in phasing.het_sites(b).collect()] == [3]
    assert phasing.het_sites(b.withColumn("quality", F.when(F.col("base") == "G", 10).otherwise(40))).count() == 0


def test_mates(spark):
    rows = [("a", 0x40, "AC", "II"), ("a", 0x80, "GT", "II"), ("a", 0x140, "AC", "II"), ("b", 0x40, "AA", "II"), ("c", 0x80, "CC", "II"), ("c", 0x40, "TT", "II")]
    one, two = sequences.split_mates(spark.createDataFrame(rows, "name string, flag int, seq string, qual string"))
    assert [(r["name"], r["seq"]) for r in one.collect()] == [("a", "AC"), ("c", "TT")] and [r["seq"] for r in two.collect()] == ["GT", "CC"]


def test_seed_hits(spark):
    reads = spark.createDataFrame([("s", f"r{i}", SEQS[a][i * 10 : i * 10 + 100]) for a in ("A*01:01",) for i in range(10)] + [("s", "none", "ACGT")], "sample_id string, read_id string, seq string")
    alleles = spark.createDataFrame([(a[0], a, s) for a, s in SEQS.items()], "locus string, allele string, seq string")
    hits = kmers.seed_hits(reads, alleles).collect()
    best = {r["read_id"]: r["allele"] for r in hits if not r["is_secondary"]}
    assert set(best.values()) == {"A*01:01"} and len(best) == 10 and all(r["mapq"] == 60 for r in hits if not r["is_secondary"])
    found = candidates.prefilter(spark.createDataFrame(hits))
    assert found.orderBy("rank").first()["allele"] == "A*01:01"


def test_closest_alleles(spark):
    needed = spark.createDataFrame([("s", "A"), ("s", "B"), ("t", "A")], "sample_id string, locus string")
    contigs = spark.createDataFrame([("s", "A", SEQS["A*02:01"][:130]), ("s", "A", SEQS["A*02:01"][110:]), ("t", "A", changed(SEQS["A*03:01"], 100))], "sample_id string, locus string, seq string")
    alleles = spark.createDataFrame([(a[0], a, s) for a, s in SEQS.items()], "locus string, allele string, seq string")
    got = {(r["sample_id"], r["locus"]): r for r in kmers.closest_alleles(needed, contigs, alleles).collect()}
    assert (got["s", "A"]["closest"], got["s", "A"]["is_novel"], got["s", "A"]["n_contigs"]) == ("A*02:01", False, 2)
    assert got["s", "B"]["is_novel"] and got["s", "B"]["closest"] == "" and got["t", "A"]["is_novel"]
    hits = spark.createDataFrame([("t", "A", "A*01:01", "240M", 6), ("t", "A", "A*03:01", "240M", 1)], "sample_id string, locus string, allele string, cigar string, nm int")
    t = kmers.closest_alleles(needed, contigs, alleles, hits).where("sample_id = 't'").first()
    assert t["closest"] == "A*03:01" and abs(t["identity"] - 239 / 240) < 1e-12 and not t["is_novel"]


def test_annotated_alignments(spark):
    ref = "ATG" + "GCT" * 80
    query = ref[:24] + "A" + ref[25:60] + "AC" + ref[60:]
    df = spark.createDataFrame([("s", "B", "B*07:02", 0, "60M2I183M", query, ref), ("s", "C", "C*01:02", 0, "243M", ref, ref)], "sample_id string, locus string, allele string, pos0 int, cigar string, query string, ref string")
    rows = novel.annotate_alignments(df).collect()
    assert [(r["locus"], r["temporary_name"]) for r in rows] == [("B", "B*07:new")]
    assert [(v["position"], v["kind"]) for v in rows[0]["variants"]] == [(24, "SNP"), (60, "INS")] and rows[0]["variants"][1]["effect"] == "frameshift"
    assert rows[0]["variants"][0]["hgvs"] == "B*07:02:g.25G>A"


def test_no_shared_folder_is_an_error():
    class Conf:
        def get(self, *_):
            return None

    class Far:
        conf = Conf()

        class sparkContext:
            master = "spark://host:7077"

            class _jsc:
                @staticmethod
                def sc():
                    return type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()

    with pytest.raises(RuntimeError):
        storage.shared_dir(Far)


def test_results_of_no_reads(spark):
    a = spark.createDataFrame([], "sample_id string, read_id string, locus string, allele string, as_score int, mapq int, is_secondary boolean, pos int, base string")
    r = typing_run.run(a)
    assert r.calls.count() == 0 and r.bins.count() == 0 and r.weights.count() == 0 and outputs.benchmark(spark.createDataFrame([], "sample_id string, locus string, t1 string, t2 string, ancestry string"), r.calls)["overall"].first()["n_samples"] == 0


def test_accuracy_by_depth(spark, tmp_path, capsys):
    rnd = random.Random(12)
    rows = []
    for sample, pair in (("s1", ("A*01:01", "A*02:01")), ("s2", ("A*03:01", "A*03:01"))):
        for i in range(200):
            own = pair[i % 2]
            rows += [(sample, f"{sample}-{i}", "A", a, 100 if a == own else 60 + rnd.randrange(5), 60 if a == own else 0, a != own, i % 50, "A") for a in ("A*01:01", "A*02:01", "A*03:01")]
    path = str(tmp_path / "a.parquet")
    spark.createDataFrame(rows, "sample_id string, read_id string, locus string, allele string, as_score int, mapq int, is_secondary boolean, pos int, base string").write.parquet(path)
    truth = tmp_path / "t.tsv"
    truth.write_text("SampleID\tLocus\tAllele1\tAllele2\tAncestry\tDepth\ns1\tA\tA*01:01\tA*02:01\tEUR\t30\ns2\tA\tA*03:01\tA*03:01\tEUR\t60\ns2\tB\tB*07:02\tB*08:01\tEUR\t60\ns9\tA\tA*01:01\tA*01:01\tEUR\t0\n")
    cli.main(["benchmark", str(truth), str(tmp_path / "out"), "--alignments", path, "--depths", "20,30,100"])
    curve = json.load(open(tmp_path / "out" / "depth_curve_t.json"))["depths"]
    assert [r["target"] for r in curve] == [20, 30, 100] and all(r["n_samples"] == 3 and r["n_no_call"] == 1 and r["n_correct_both"] == 2 for r in curve)
    assert "at 30: accuracy 0.6667" in capsys.readouterr().out
    # All reads at or above the present depth, a share below it.
    own = spark.read.parquet(path).withColumn("d", F.when(F.col("sample_id") == "s1", 30.0).otherwise(60.0))
    n = {(r["sample_id"], r["target"]): r["n"] for r in evaluate.depth_curve(own, F.col("d"), (20, 30, 100)).groupBy("sample_id", "target").agg(F.countDistinct("read_id").alias("n")).collect()}
    assert n["s1", 30] == n["s1", 100] == n["s2", 100] == 200 and 100 < n["s1", 20] < 160 and 70 < n["s2", 30] < 130
