import json

from lociforge.sources import callers, sequences, sinks


def test_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a1 first\nacgt\nAC\n>\nTT\n>a2\n\nGG\r\n")
    got = {r["name"]: r["seq"] for r in sequences.fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"a1": "ACGTAC", "a2": "GG"}
    df = spark.createDataFrame([("A*01", "ACGT" * 30)], "allele string, seq string")
    text = sinks.fasta_lines(df, prefix="HLA-").first()[0].split("\n")
    assert text[0] == ">HLA-A*01" and [len(x) for x in text[1:]] == [80, 40]


def test_tables(spark, tmp_path):
    (tmp_path / "r.tsv").write_text("# note\nLocus\tChromosome\tAllele\nA\t1\tA*01:01\nA\t2\tA*02:01\nB\t1\tB*07:02\nA\t1\tA*03:01\n")
    got = {r["locus"]: (r["a1"], r["a2"]) for r in callers.read_results(spark, "hla_hd", str(tmp_path / "r.tsv")).collect()}
    assert got == {"A": ("A*03:01", "A*02:01"), "B": ("B*07:02", "")}
    (tmp_path / "t.tsv").write_text("SampleID\tLocus\tAllele1\tAllele2\tAncestry\ns1\tA\tHLA-A*01:01\tA*02:01\tEUR\ns1\tA\tA*03:01\tA*02:01\tAFR\n")
    t = callers.truth_tsv(spark, str(tmp_path / "t.tsv")).collect()
    assert [(r["t1"], r["ancestry"], r["depth"], r["bam"]) for r in t] == [("A*03:01", "EUR", 0.0, "s1.bam")]
    (tmp_path / "o.tsv").write_text("A1\tA2\tB1\tB2\tC1\tC2\nA*01:01\tA*02:01\tB*07:02\tB*08:01\tC*07:01\tC*07:02\n")
    assert callers.read_results(spark, "optitype", str(tmp_path / "o.tsv")).count() == 3
    (tmp_path / "x.json").write_text(json.dumps({"hla": {"alleles": ["A*01:01", "A*02:01", "B*07:02"]}}))
    got = {r["locus"]: (r["a1"], r["a2"]) for r in callers.read_results(spark, "xhla", str(tmp_path / "x.json")).collect()}
    assert got == {"A": ("A*01:01", "A*02:01"), "B": ("B*07:02", "")}
    (tmp_path / "bad.json").write_text("{nothing")
    assert callers.read_results(spark, "xhla", str(tmp_path / "bad.json")).count() == 0


def test_reference_files(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# c\nA*;01:01:01/01:01:02;01:01:01G\nA*;02:01;\nB*;x\n")
    assert {r["allele"]: r["g_group"] for r in sequences.g_groups(spark, str(tmp_path / "g.txt")).collect()} == {"A*01:01:01": "A*01:01:01G", "A*01:01:02": "A*01:01:01G"}
    (tmp_path / "f.tsv").write_text("Locus\tAllele\tFrequency\tPopulation\nA\t01:01\t0.1\tEUR\nA\tA*01:01\t0.2\tEUR\nA\t01:01\t0.9\tAFR\n")
    assert [(r["allele"], r["freq"]) for r in sequences.frequencies(spark, str(tmp_path / "f.tsv"), "EUR").collect()] == [("A*01:01", 0.2)]
    (tmp_path / "a.sam").write_text("@HD\tx\nr1\t0\tHLA-A*01:01\t11\t60\t10M\t*\t0\t0\tACGTACGTAC\tIIII\tNM:i:1\tAS:i:18\tMD:Z:10\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    r = sequences.sam(spark, str(tmp_path / "a.sam")).collect()
    assert [(x["pos0"], x["nm"], x["as_score"], x["md"]) for x in r] == [(10, 1, 18, "10")]
    (tmp_path / "r.fq").write_text("@a\nAC\n+\nII\n" * 3)
    assert sequences.fastq_reads(spark, str(tmp_path / "r.fq")).first()[0] == 3
    assert sequences.release({"version": "", "list": "# version: IPD 3.50\n"}, "x") == "3.50" and sequences.release({}, "x") == "x"


def test_documents_of_a_run(spark):
    counts = spark.createDataFrame([("A", 100), ("B", 200)], "locus string, n long")
    lock = sinks.lockfile(counts, "3.50", "abc", b"x")
    assert json.loads(lock)["total"] == 300 and sinks.verify_lock(lock, "3.50") and not sinks.verify_lock(lock, "3.49") and not sinks.verify_lock(lock, "3.50", "def")
    page = sinks.dashboard(spark.createDataFrame([("s", "A", "<")], "sample_id string, locus string, x string")).first()["value"]
    assert "<th>locus</th>" in page and "&lt;" in page and "<td>A</td>" in page
