"""Queries that once read a part of their tables, against brute force over whole small ones."""

import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from lociforge.operators import kmers
from lociforge.plans import catalogue


def bases(text):
    return "".join("ACGT"[(ord(c) - 97) % 4] for c in text.lower() if "a" <= c <= "z")


def canonical(s, k):
    for i in range(len(s) - k + 1):
        w = s[i : i + k]
        if "N" not in w:
            yield min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA")))


def want_depths(alleles, reads, k):
    out = {}
    for key in {x for x, _ in alleles + reads}:
        a = {w for x, s in alleles if x == key for w in canonical(s, k)}
        n = Counter(w for x, s in reads if x == key for w in canonical(s, k))
        d = [n[w] for w in a if w in n]
        if a or n:
            chi2 = round(sum(x * x for x in d) / (sum(d) / len(d)) - sum(d), 4) if len(d) > 5 else None
            out[key] = (len(a), round(len(d) / len(a), 6) if a else 0.0, round(sum(d) / len(a), 6) if a else 0.0, chi2, len(d) - 1, round(sum(w not in a for w in n) / max(len(n), 1), 6))
    return out


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Documents with ids on both sides of 600, some of over 1,500 letters, and passages that only their ends hold."""
    d = str(tmp_path_factory.mktemp("corpus"))
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rnd.randint(3, 9)))
    text = lambda n: " ".join(word() for _ in range(n))
    passages = [text(30) for _ in range(4)]
    docs = [(i, text(rnd.choice([1, 40, 300])) + " " + passages[i % 4] if i % 3 else text(20), ("en", "de")[i % 2], f"src{i % 3}") for i in [*range(0, 30), *range(590, 640), 5001]]
    docs += [(6000, docs[7][1], "en", "src1"), (6001, docs[7][1] + "x", "en", "src1"), (6002, docs[7][1], "en", "src1")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(list(enumerate(passages)), "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, passages


def test_kmer_queries_read_whole_documents(spark, corpus):
    d, docs, passages = corpus
    keys = {(r[2], r[3]) for r in docs}
    want = want_depths([(x, bases(p)) for x in keys for p in passages], [((r[2], r[3]), bases(r[1])) for r in docs], 21)
    rows = {n: {(r["lang"], r["source"]): r for r in catalogue.QUERIES[n](spark, d).collect()} for n in ("kmer_validation", "kmer_unexpected", "kmer_chi2", "kmer_chi2_pvalue")}
    got = {x: (v["n_kmers"], v["covered"], v["mean_depth"], rows["kmer_chi2"][x]["chi2"], rows["kmer_chi2"][x]["df"], rows["kmer_unexpected"][x]["unexpected"]) for x, v in rows["kmer_validation"].items()}
    assert got == want and any(v[1] > 0.5 for v in want.values()) and any(v[3] for v in want.values())
    assert {x: (r["chi2"], r["df"]) for x, r in rows["kmer_chi2_pvalue"].items()} == {x: (v[3], v[4]) for x, v in want.items()}


@pytest.mark.parametrize("k", [1, 5, 16, 31])
def test_depth_of_dna(spark, k):
    rnd = random.Random(k)
    seq = lambda: "".join(rnd.choice("ACGTACGTACGTN") for _ in range(rnd.choice([0, k - 1, k, 60])))
    sets = [[(x, seq()) for _ in range(12) for x in "xyz"[a:b]] for a, b in ((0, 2), (1, 3))]
    sets[1] += sets[0][:5]
    al, rd = (spark.createDataFrame(s, "key string, seq string") for s in sets)
    columns = [F.round(c, 6).alias(c) if c in ("covered", "mean_depth", "unexpected") else F.round(c, 4).alias(c) if c == "chi2" else F.col(c) for c in ("n_kmers", "covered", "mean_depth", "chi2", "df", "unexpected")]
    for f in (kmers.depth_of_dna, kmers.depth_of_alleles):
        assert {r[0]: tuple(r)[1:] for r in f(al, rd, ["key"], k).select("key", *columns).collect()} == want_depths(*sets, k), f.__name__


def test_other_bases_break_kmers(spark):
    where, codes = kmers.kmer_codes(b"ACGRTTGNACxGGA", 3)
    assert where.tolist() == [0, 4, 11] and codes.tolist() == kmers.kmer_codes(b"ACGNTTGNACNGGA", 3)[1].tolist()
    left = spark.createDataFrame([("c", "ACGTTGCARGGATTACAGATC")], "id string, seq string")
    right = spark.createDataFrame([("a", "ACGTTGCAAGGATTACAGATC")], "other string, seq string")
    assert kmers.jaccard(left, right, 8).first()["common"] == 1 + 5
    assert sorted(r["km"] for r in kmers.explode_kmers(left, ["id"], "seq", 8).collect()) == sorted({min(w, w[::-1].translate(str.maketrans("ACGT", "TGCA"))) for w in ("ACGTTGCA", *("GGATTACAGATC"[i : i + 8] for i in range(5)))})


CIGAR = ("cigar_tokens", "cigar_variants", "alignment_identity", "novel_report", "snp_distance", "variant_summary")


@pytest.mark.parametrize("name", CIGAR)
def test_cigar_queries_read_all_of_lineitem(spark, tmp_path, name):
    rows = [(o, n, 100 + 7 * o + 3 * n, 10 + (o * n) % 11) for o in range(1, 61) for n in range(1, 4)]
    columns = "l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long"
    spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    df = catalogue.QUERIES[name](spark, str(tmp_path))
    found = df.collect()
    if name != "cigar_variants":
        assert len(found) == len(rows)
    if name not in catalogue.ORACLE_SQL:
        return
    con = duckdb.connect()
    con.execute("create table lineitem (l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint)")
    con.executemany("insert into lineitem values (?, ?, ?, ?)", rows)
    rel = con.execute(catalogue.ORACLE_SQL[name])
    cols = [d[0] for d in rel.description]
    norm = lambda x: repr(round(x, 6)) if isinstance(x, float) else str(x)
    want = sorted(tuple(norm(r[cols.index(c)]) for c in sorted(cols)) for r in rel.fetchall())
    assert sorted(tuple(norm(r[c]) for c in sorted(df.columns)) for r in found) == want


def test_reduced_panel_compares_whole_sequences(spark, corpus):
    d, docs, _ = corpus
    want = {}
    for i, text, lang, _ in docs:
        first, n = want.get((lang, bases(text)), (i, 0))
        want[lang, bases(text)] = (min(first, i), n + 1)
    got = {(r["lang"], r["seq"]): (r["first_id"], r["n"]) for r in catalogue.QUERIES["reduced_panel"](spark, d).collect()}
    assert got == want and (6000, 2) in got.values() and (6001, 1) in got.values()
