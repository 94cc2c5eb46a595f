"""The jobs: against their SQL, over growing input, cut off in the middle, and from the command line."""

import os
import random
from pathlib import Path

import duckdb
import pytest

from jobs import registered, screen_reads, triage_cohort
from lociforge.operators import kmers

SF = "/root/testdata/sf0.001"
PANEL = ["".join(random.Random(i).choices("ACGT", k=300)) for i in range(4)]


def norm(x):
    return repr(round(x, 6)) if isinstance(x, float) else str(x)


def rows(df):
    return sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in df.collect())


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", sorted(registered.QUERIES))
def test_query(spark, name):
    settings = lambda: [spark.conf.get(f"spark.sql.{x}") for x in ("sources.partitionOverwriteMode", "shuffle.partitions", "adaptive.enabled")]
    before = settings()
    con = duckdb.connect()
    for t in ("lineitem", "documents", "benchmark"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registered.QUERIES[name](spark, SF)
    rel = con.execute(registered.ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    want = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall())
    assert sorted(cols) == sorted(df.columns) and rows(df) == want and want
    assert settings() == before


def reads_of(sample, numbers):
    return [(sample, f"{sample}-{i}", PANEL[i % 4][i % 7 * 20 : i % 7 * 20 + 120] if i % 5 else "T" * 50) for i in numbers]


def add_file(spark, folder, part):
    spark.createDataFrame(part, "sample_id string, read_id string, seq string").coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture
def panel(spark, tmp_path):
    path = str(tmp_path / "panel")
    spark.createDataFrame([("A", f"A*0{i}:01", s) for i, s in enumerate(PANEL)], "locus string, allele string, seq string").write.parquet(path)
    return path


def files(out):
    return {str(p): p.stat().st_mtime_ns for p in Path(out, "hits").rglob("*.parquet")}


def test_screen_takes_only_what_is_new(spark, tmp_path, panel):
    reads, out = str(tmp_path / "reads"), str(tmp_path / "out")
    add_file(spark, reads, reads_of("s1", range(40)) + reads_of(None, range(5)))
    first = screen_reads.run(spark, reads, panel, out)
    had, old = rows(first), files(out)
    assert had and {r["batch"] for r in first.collect()} == {0}
    assert rows(screen_reads.run(spark, reads, panel, out)) == had and files(out) == old  # nothing new
    add_file(spark, reads, reads_of("s1", range(40, 60)))
    add_file(spark, reads, reads_of("s2", range(30)) + [("s2", "empty", ""), ("s2", "null", None), ("s2", "none", "T" * 80)])
    second = screen_reads.run(spark, reads, panel, out)
    now = files(out)
    assert {p: now[p] for p in old} == old and len(now) > len(old)  # what was there is untouched
    assert {r["batch"] for r in second.collect()} == {0, 1}
    whole = screen_reads.screened(spark.read.parquet(reads), screen_reads.panel_of(spark, panel, screen_reads.config_of()), screen_reads.config_of())
    assert rows(second.drop("batch")) == rows(whole)
    assert {r["sample_id"] for r in second.collect()} == {"s1", "s2", None}


def test_screen_writes_a_cut_off_batch_again(spark, tmp_path, panel, monkeypatch):
    reads, out = str(tmp_path / "reads"), str(tmp_path / "out")
    add_file(spark, reads, reads_of("s1", range(20)))
    hits = kmers.seed_hits

    def broken(*a):
        hits(*a).withColumn("batch", screen_reads.F.lit(0)).limit(3).write.mode("append").partitionBy("batch", "sample_id").parquet(f"{out}/hits")
        raise RuntimeError("cut off")

    monkeypatch.setattr(kmers, "seed_hits", broken)
    with pytest.raises(Exception, match="cut off"):
        screen_reads.run(spark, reads, panel, out)
    monkeypatch.setattr(kmers, "seed_hits", hits)
    add_file(spark, reads, reads_of("s1", range(20, 30)))
    got = screen_reads.run(spark, reads, panel, out)
    whole = screen_reads.screened(spark.read.parquet(reads), screen_reads.panel_of(spark, panel, screen_reads.config_of()), screen_reads.config_of())
    assert rows(got.drop("batch")) == rows(whole)


def test_screen_without_hits_and_fasta_panel(spark, tmp_path):
    reads, out, fa = str(tmp_path / "reads"), str(tmp_path / "out"), tmp_path / "panel.fa"
    fa.write_text("".join(f">A*0{i}:01 x\n{s[:150]}\n{s[150:]}\n" for i, s in enumerate(PANEL)))
    config = {"panel": {"format": "fasta", "locus": "split_part(name, '*', 1)", "allele": "name"}, "reads": {"max_files": 1}}
    add_file(spark, reads, [("s1", "a", "ACGT" * 10)])
    assert screen_reads.run(spark, reads, str(fa), out, config).count() == 0
    add_file(spark, reads, reads_of("s1", range(3)))
    add_file(spark, reads, reads_of("s1", range(6, 9)))
    got = screen_reads.run(spark, reads, str(fa), out, config).collect()
    assert {r["read_id"] for r in got} == {f"s1-{i}" for i in (1, 2, 6, 7, 8)} and len({r["batch"] for r in got}) == 2
    assert all(r["allele"] == f"A*0{int(r['read_id'][3:]) % 4}:01" and not r["is_secondary"] and r["mapq"] == 60 for r in got)


def alignments(spark, path, samples):
    own = [(s, f"{s}-{i}", "A", f"A*0{1 + i % 2}:01", 100 - i % 2, 30, False) for s in samples for i in range(60)]
    spark.createDataFrame(own, "sample_id string, read_id string, locus string, allele string, as_score int, mapq int, is_secondary boolean").write.mode("overwrite").parquet(path)


def test_triage_replaces_its_output(spark, tmp_path):
    path, out = str(tmp_path / "in"), str(tmp_path / "out")
    alignments(spark, path, ["s1", "s2"])
    first = rows(triage_cohort.run(spark, path, out))
    assert len(first) == 2 and rows(triage_cohort.run(spark, path, out)) == first
    alignments(spark, path, ["s2", "s3"])
    got = triage_cohort.run(spark, path, out).collect()
    assert {r["sample_id"] for r in got} == {"s2", "s3"}
    assert all((r["allele1"], r["allele2"], r["copies"], r["locus"], r["is_contaminated"]) == ("A*01:01", "A*02:01", 2, "A", False) for r in got)
    assert [p.name for p in Path(out).glob("locus=*")] == ["locus=A"]
    alignments(spark, path, [])
    assert triage_cohort.run(spark, path, out).count() == 0


def test_commands(spark, tmp_path, panel, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)  # the session belongs to the tests
    reads, out, calls = (str(tmp_path / x) for x in ("reads", "out", "calls"))
    add_file(spark, reads, reads_of("s1", range(100)))
    settings = tmp_path / "own.toml"
    settings.write_text("[seeds]\nleast = 30\n")
    screen_reads.main([reads, panel, out, "--config", str(settings)])
    own = tmp_path / "triage.toml"
    own.write_text('resolution = 1\nview = "select * from {rows}"\n')
    triage_cohort.main([f"{out}/hits", calls, "--config", str(own)])
    got = spark.read.parquet(calls).collect()
    assert len(got) == 1 and got[0]["allele1"].startswith("A*0") and ":" not in got[0]["allele1"]
