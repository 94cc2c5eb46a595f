"""From FASTQ and BAM files, and with contigs, through the command line."""

import glob
import json
import random

import pytest
from pyspark.sql import functions as F

from lociforge import __main__ as cli
from lociforge.plans import reads
from lociforge.sources import bam

from . import test_bam as files

RND = random.Random(8)
BASE = "".join(RND.choice("ACGT") for _ in range(700))


def changed(s, *at):
    return "".join("ACGT"[("ACGT".index(c) + 1) % 4] if i in at else c for i, c in enumerate(s))


SEQS = {
    "A*01:01": BASE, "A*02:01": changed(BASE, *range(20, 700, 45)), "A*03:01": changed(BASE, *range(30, 700, 41)),
    "B*07:02": BASE[::-1], "B*08:01": changed(BASE[::-1], *range(10, 700, 37)),
}


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    """Pairs of mates of A*01:01, A*02:01 and B*07:02 (one allele), and the panel."""
    d = tmp_path_factory.mktemp("reads")
    rnd, pairs = random.Random(9), []
    for own, n in (("A*01:01", 40), ("A*02:01", 40), ("B*07:02", 30)):
        for _ in range(n):
            at = rnd.randrange(0, 700 - 300)
            one, two = SEQS[own][at : at + 120], SEQS[own][at + 180 : at + 300]
            pairs.append((f"p{len(pairs)}", one, revcomp(two)))
    for m in (1, 2):
        (d / f"x_{m}.fastq").write_text("".join(f"@{p[0]}/{m}\n{p[m]}\n+\n{'I' * 120}\n" for p in pairs))
    (d / "alleles.fa").write_text("".join(f">HLA:{i} {a} 700 bp\n{s}\n" for i, (a, s) in enumerate(SEQS.items())))
    return d, pairs


def calls(out, sample_id="s1"):
    doc = json.loads(open(glob.glob(f"{out}/hla_types.json/sample_id={sample_id}/part-*")[0]).read())
    return {k: sorted((v["allele1"], v["allele2"])) for k, v in doc.items()}


WANT = {"A": ["A*01:01", "A*02:01"], "B": ["B*07:02", "B*07:02"]}


def test_type_fastq(spark, sample, tmp_path):
    d, pairs = sample
    out = str(tmp_path / "out")
    cli.main(["type", f"{d}/x_1.fastq", out, "--mates", f"{d}/x_2.fastq", "--sequences", f"{d}/alleles.fa", "--sample", "s1"])
    assert calls(out) == WANT
    with pytest.raises(SystemExit):
        cli.main(["type", f"{d}/x_1.fastq", out])


def genome_file(path, pairs):
    """The pairs in a genome's BAM: first mates in the region, second ones unmapped, some beside their mates and some at the end; others elsewhere."""
    rnd, rows, last = random.Random(10), [], []
    for i, (name, one, two) in enumerate(pairs):
        pos = rnd.randrange(29_900_000, 31_400_000)
        rows.append((name, 73, "chr6", pos, 60, "120M", one, "I" * 120, 0, 120, "120"))
        if i % 2:
            rows.append((name, 133, "chr6", pos, 0, "*", two, "I" * 120, None, None, None))
        else:
            last.append((name, 141, "*", -1, 0, "*", two, "I" * 120, None, None, None))
    rows += [(f"far{i}", 0, "chr5", rnd.randrange(1, 2_000_000), 60, "100M", "".join(rnd.choices("ACGT", k=100)), "I" * 100, 0, 100, "100") for i in range(300)]
    files.write(path, sorted(rows, key=lambda r: (r[2], r[3])) + last, 3000)


def test_reads_of_a_genome_bam(spark, sample, tmp_path):
    d, pairs = sample
    genome_file(tmp_path / "g.bam", pairs)
    own = reads.unaligned(bam.bam(spark, str(tmp_path / "g.bam"), reads.region_of(bam.contigs(spark, str(tmp_path / "g.bam"))), unmapped=True), "s1")
    assert sorted((r["read_id"], r["seq"]) for r in own.collect()) == sorted((f"{n}/{m}", s) for n, *both in pairs for m, s in enumerate(both, 1))
    few = bam.bam(spark, str(tmp_path / "g.bam"), reads.region_of(bam.contigs(spark, str(tmp_path / "g.bam"))))  # as of captured loci
    assert sorted(r["read_id"] for r in reads.unaligned(few, "s1").collect()) == sorted(f"{n}/1" for n, *_ in pairs)
    assert reads.region_of(bam.contigs(spark, str(tmp_path / "g.bam")), "GRCh37") == "6:28477797-33448354"
    with pytest.raises(SystemExit):
        reads.alignment_rows(spark, str(tmp_path / "g.bam"), "s1")


def test_panel_bam_equals_sam(spark, sample, tmp_path, monkeypatch):
    d, pairs = sample
    monkeypatch.setattr(files, "REFS", [(f"HLA-{a}", len(s)) for a, s in SEQS.items()])
    rows = []
    for i, (name, one, two) in enumerate(pairs):
        own = ("A*01:01", "A*02:01", "B*07:02")[min(i // 40, 2)]
        for flag, seq in ((65, one), (145, revcomp(two))):
            at = SEQS[own].index(seq)
            for k, a in enumerate(sorted((a for a in SEQS if a[0] == own[0]), key=lambda a: a != own)):
                wrong = sum(x != y for x, y in zip(seq, SEQS[a][at : at + 120]))
                rows.append((name, flag + 256 * (k > 0), f"HLA-{a}", at, 0 if k else 60, "120M", seq, "I" * 120, wrong, max(0, 240 - 10 * wrong), "120"))
    rows.sort(key=lambda r: (list(SEQS).index(r[2][4:]), r[3]))
    files.write(tmp_path / "p.bam", rows, 5000)
    lines = ["\t".join(map(str, (*r[:3], r[3] + 1, *r[4:6], "*", 0, 0, *r[6:8]))) + f"\tNM:i:{r[8]}\tAS:i:{r[9]}\tMD:Z:120" for r in rows]
    (tmp_path / "p.sam").write_text("@HD\tVN:1.6\n" + "\n".join(lines) + "\n")
    a, b = (reads.alignment_rows(spark, str(tmp_path / f"p.{kind}"), "s1") for kind in ("bam", "sam"))
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.select(*a.columns).collect())) and a.count() == len(rows)


def _variants(doc):
    """All variants of a document, wherever they stand."""
    if isinstance(doc, dict):
        return doc.get("variants", []) if isinstance(doc.get("variants"), list) else [v for x in doc.values() for v in _variants(x)]
    return [v for x in doc for v in _variants(x)] if isinstance(doc, list) else []


def test_contigs_give_novel_alleles(spark, sample, tmp_path):
    d, pairs = sample
    own = changed(SEQS["B*07:02"], 300, 301, 302, 350, 420, 500)  # reads of an allele that the panel lacks
    rnd = random.Random(11)
    seqs = [own[at : at + 120] for at in (rnd.randrange(0, 580) for _ in range(120))] + [own[:120], own[-120:]] * 3
    (tmp_path / "n.fq").write_text("".join(f"@n{i}\n{s}\n+\n{'I' * 120}\n" for i, s in enumerate(seqs)))
    (tmp_path / "c.fa").write_text(f">k1\n{own[:420]}R{own[421:]}\n>k2\n{revcomp(own[100:600])}\n")
    out = str(tmp_path / "out")
    cli.main(["type", str(tmp_path / "n.fq"), out, "--sequences", f"{d}/alleles.fa", "--sample", "s1", "--assemble"])
    made = open(glob.glob(f"{out}/novel_alleles.json/sample_id=s1/part-*")[0]).read()
    assert "B*07:new" in made and [v["position"] for v in _variants(json.loads(made))] == [300, 301, 302, 350, 420, 500]
    # Contigs of a file are found and turned like those of the reads.
    contigs, hits = reads.contig_rows(reads.fasta_contigs(spark, str(tmp_path / "c.fa"), "s1"), cli.alleles_of(spark, f"{d}/alleles.fa"))
    assert {r["locus"] for r in contigs.collect()} == {"B"} and all(r["seq"] in (own[:420] + "R" + own[421:], own[100:600]) for r in contigs.collect())
    best = hits.where("allele = 'B*07:02'").orderBy(F.length("query").desc()).first()
    assert best["pos0"] == 0 and best["cigar"] == "700M" and best["nm"] == 6


def test_batch_of_a_sheet(spark, sample, tmp_path, monkeypatch, capsys):
    """Three files of which one is broken: two results and an error row; the next call takes what is left."""
    d, pairs = sample
    genome_file(tmp_path / "g.bam", pairs)
    whole = (tmp_path / "g.bam").read_bytes()
    (tmp_path / "b.bam").write_bytes(whole[: len(whole) // 2])
    (tmp_path / "b.bam.bai").write_bytes((tmp_path / "g.bam.bai").read_bytes())
    with monkeypatch.context() as m:
        m.setattr(files, "REFS", [(f"HLA-{a}", len(s)) for a, s in SEQS.items()])
        rows = [(n, 0, f"HLA-{own}", SEQS[own].index(one), 60, "120M", one, "I" * 120, 0, 240, "120") for i, (n, one, _) in enumerate(pairs) for own in [("A*01:01", "A*02:01", "B*07:02")[min(i // 40, 2)]]]
        files.write(tmp_path / "p.bam", sorted(rows, key=lambda r: (list(SEQS).index(r[2][4:]), r[3])), 5000)
    sheet = tmp_path / "sheet.csv"
    sheet.write_text(f"sample_id,bam_path\ns1,{tmp_path}/g.bam\ns2,{tmp_path}/p.bam\ns3,{tmp_path}/b.bam\ns4,{tmp_path}/none.bam\n")
    out = str(tmp_path / "out")
    cli.main(["batch", str(sheet), out, "--sequences", f"{d}/alleles.fa"])
    told = {r["sample_id"]: (r["status"], r["message"]) for r in spark.read.parquet(f"{out}/samples").collect()}
    assert {k: v[0] for k, v in told.items()} == {"s1": "done", "s2": "done", "s3": "error", "s4": "error"} and all(told[k][1] for k in ("s3", "s4"))
    assert calls(out) == WANT and calls(out, "s2") == WANT and not glob.glob(f"{out}/*/sample_id=s3") and "s3:" in capsys.readouterr().out
    old = {p: open(p).read() for p in glob.glob(f"{out}/hla_types.tsv/*/part-*")}
    (tmp_path / "b.bam").write_bytes(whole)
    cli.main(["batch", str(sheet), out, "--sequences", f"{d}/alleles.fa"])
    assert calls(out, "s3") == WANT and {p: open(p).read() for p in old} == old
    done = [r["sample_id"] for r in spark.read.parquet(f"{out}/samples").where("status = 'done'").collect()]
    assert sorted(done) == ["s1", "s2", "s3"]
