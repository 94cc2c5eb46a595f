"""Contigs against a plain walk of the graph."""

import random
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from lociforge.operators import assembly

RND = random.Random(4)


def plain(reads, k, least):
    n = Counter(s[i : i + k] for s in reads for i in range(len(s or "") - k + 1) if set(s[i : i + k]) <= set("ACGT"))
    nodes = {m for m, c in n.items() if c >= least}
    ends, begins = defaultdict(list), defaultdict(list)
    for m in nodes:
        ends[m[1:]].append(m)
        begins[m[:-1]].append(m)
    after = {ends[x][0]: begins[x][0] for x in ends if len(ends[x]) == 1 and len(begins.get(x, ())) == 1 and ends[x][0] != begins[x][0]}
    heads = nodes - set(after.values())
    out = []
    for m in heads:
        s, own = m, [m]
        while own[-1] in after:
            own.append(after[own[-1]])
            s += own[-1][-1]
        out.append((s, len(own), round(sum(n[x] for x in own) / len(own), 6)))
    return sorted(out)


def changed(s, *at):
    return "".join("ACGT"[("ACGT".index(c) + 1) % 4] if i in at else c for i, c in enumerate(s))


def cut(s, n, size=60):
    return [s[a : a + size] for a in (RND.randrange(0, len(s) - size + 1) for _ in range(n))] + [s[:size], s[-size:]] * 3


def test_unitigs(spark):
    one = "".join(RND.choices("ACGT", k=400))
    two = changed(one, 150, 260)
    ring = one[:80] + one[:20]
    sets = {
        ("s1", "A"): cut(one, 150), ("s1", "B"): cut(one, 100) + cut(two, 100), ("s2", None): [ring, ring], ("s3", "A"): ["A" * 50] * 3 + ["ACGT" * 20] * 2 + [None, "", "ACG", "N" * 60],
        ("s4", "A"): [s if i % 9 else changed(s, 30) for i, s in enumerate(cut(two, 200))],
    }
    df = spark.createDataFrame([(*key, s) for key, reads in sets.items() for s in reads], "sample_id string, locus string, seq string")
    got = defaultdict(list)
    for r in assembly.unitigs(df, k=15, least=2, shortest=0).collect():
        got[r["sample_id"], r["locus"]].append((r["seq"], r["n_kmers"], round(r["depth"], 6)))
    for key, reads in sets.items():
        assert sorted(got[key]) == plain([s for s in reads if s], 15, 2), key
    assert [x[0] for x in got["s1", "A"]] == [one]  # one haplotype is one contig
    # Two haplotypes: what they share, and both sides of each difference.
    assert len(got["s1", "B"]) == 7 and all(x[0] in one or x[0] in two for x in got["s1", "B"])
    assert not got["s2", None]  # a ring has no first node
    long = assembly.unitigs(df.where("sample_id = 's1'"), k=15)
    assert long.where(F.length("seq") < 30).count() == 0 and long.where("locus = 'A'").first()["seq"] == one
    assert assembly.unitigs(df.where("false"), k=15).count() == 0
