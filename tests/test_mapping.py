"""Seeds, chains and alignments against plain programmes."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lociforge.operators import mapping as M


def revcomp(s):
    return s[::-1].translate(str.maketrans("ACGT", "TGCA"))


def plain_minimizers(s, k, w):
    """Positions by the definition; s may be shorter than a window."""
    kmers = []
    for i in range(len(s) - k + 1):
        x = s[i : i + k]
        if set(x) <= set("ACGT"):
            code = lambda y: sum("ACGT".index(c) << 2 * (len(y) - 1 - j) for j, c in enumerate(y))
            kmers.append((int(M._mixed(np.array([min(code(x), code(revcomp(x)))], dtype=np.uint64))[0]), i))
        else:
            kmers.append((1 << 64, i))
    out = set()
    for i in range(-w + 1, len(kmers)):
        window = [x for x in kmers[max(i, 0) : i + w] if x[0] < 1 << 64]
        if window:
            out.add(min(window)[1])
    return sorted(out)


def test_minimizers():
    rnd = random.Random(1)
    seqs = ["".join(rnd.choices("ACGTN" if i % 3 == 0 else "ACGT", k=rnd.randrange(0, 60))) for i in range(40)] + ["", "ACG", "ACGTA"]
    of, at, h, forward = M.minimizers([s.encode() for s in seqs], 5, 4)
    for i, s in enumerate(seqs):
        assert at[of == i].tolist() == plain_minimizers(s, 5, 4), s
    # The same sequence has the same minimizers whatever stands beside it, and its reverse complement has their mirror images.
    alone = M.minimizers([seqs[5].encode()], 5, 4)
    assert alone[1].tolist() == at[of == 5].tolist() and alone[2].tolist() == h[of == 5].tolist()
    turned = M.minimizers([revcomp(seqs[5]).encode()], 5, 4)
    assert set(turned[2].tolist()) == set(alone[2].tolist())


def test_longest_chain():
    rnd = random.Random(2)
    for _ in range(300):
        n = rnd.randrange(1, 9)
        r, t = np.array([rnd.randrange(8) for _ in range(n)]), np.array([rnd.randrange(8) for _ in range(n)])
        got = M.longest_chain(r, t)
        assert all(r[a] < r[b] and t[a] < t[b] for a, b in zip(got, got[1:]))
        best = max(bin(m).count("1") for m in range(1, 1 << n) if (lambda own: all(r[a] < r[b] and t[a] < t[b] for a, b in zip(own, own[1:])))(sorted((i for i in range(n) if m >> i & 1), key=lambda i: (r[i], t[i]))))
        assert len(got) == best


def plain_local(read, target, band=None):
    """Best local score with affine gaps; band: only cells with target - read inside it."""
    low = -(10**9)
    ok = lambda i, j: band is None or band[0] <= j - i <= band[1]
    h = {}
    e, f, best = {}, {}, 0
    for i in range(len(read)):
        for j in range(len(target)):
            if not ok(i, j):
                continue
            e[i, j] = max(h.get((i - 1, j), low) - M.OPEN - M.EXTEND, e.get((i - 1, j), low) - M.EXTEND)
            f[i, j] = max(h.get((i, j - 1), low) - M.OPEN - M.EXTEND, f.get((i, j - 1), low) - M.EXTEND)
            same = read[i] == target[j] and read[i] in "ACGT"
            h[i, j] = max(0, h.get((i - 1, j - 1), 0) + (M.MATCH if same else -M.MISMATCH), e[i, j], f[i, j])
            best = max(best, h[i, j])
    return best


def told(read, target, start, cigar):
    """(score, nm) of a CIGAR, by walking it."""
    i, j, score, nm, n = 0, start, 0, 0, ""
    for c in cigar:
        if c.isdigit():
            n += c
            continue
        k, n = int(n), ""
        if c == "S":
            i += k
        elif c == "M":
            for _ in range(k):
                same = read[i] == target[j] and read[i] in "ACGT"
                score, nm, i, j = score + (M.MATCH if same else -M.MISMATCH), nm + (not same), i + 1, j + 1
        else:
            score, nm = score - M.OPEN - M.EXTEND * k, nm + k
            i, j = (i + k, j) if c == "I" else (i, j + k)
    assert i == len(read) and 0 <= start and j <= len(target)
    return score, nm


def changed(s, rnd, wrong=0.03, gaps=0.02):
    out = ""
    for c in s:
        if rnd.random() < gaps:
            out += rnd.choice(["", c + "".join(rnd.choices("ACGT", k=rnd.randrange(1, 5)))])
        else:
            out += rnd.choice("ACGT") if rnd.random() < wrong else c
    return out


def rows_of(seqs, n, absent):
    codes, starts = M._codes([s.encode() for s in seqs])
    return M._rows(codes, starts, np.arange(len(seqs)), np.zeros(len(seqs), np.int64), n, absent)


def test_banded_equals_plain_programme():
    rnd = random.Random(3)
    reads, targets = [], []
    for i in range(120):
        base = "".join(rnd.choices("ACGT", k=rnd.randrange(5, 60)))
        reads.append(changed(base, rnd, 0.1, 0.08) or "A")
        targets.append(base if i % 4 else changed(base, rnd, 0, 0.2) + "N")
    band, n = 6, max(map(len, reads))
    codes, starts = M._codes([t.encode() for t in targets])
    window = M._rows(codes, starts, np.arange(len(targets)), np.full(len(targets), -band), n + 2 * band, M._NO_TARGET)
    for r, t, (score, i, j, ops) in zip(reads, targets, M.banded(rows_of(reads, n, M._NO_READ), window, band)):
        assert score == plain_local(r, t, (-band, band)), (r, t)
        if score:
            cigar = f"{i}S" + "".join(f"{c}{o}" for c, o in ops)
            cigar += f"{len(r) - i - sum(c for c, o in ops if o != 'D')}S"
            assert told(r, t, j - band, cigar)[0] == score


def test_align_pairs_scores():
    rnd = random.Random(4)
    base = "".join(rnd.choices("ACGT", k=400))
    alleles = [base, changed(base, rnd, 0.02, 0), changed(base, rnd, 0.01, 0.01), "".join(rnd.choices("ACGT", k=300))]
    reads = []
    for i in range(150):
        a = alleles[i % 3]
        at = rnd.randrange(-40, len(a) - 60)
        s = a[max(at, 0) : at + 100]
        s = ("".join(rnd.choices("ACGT", k=-at)) if at < 0 else "") + s
        reads.append(changed(s, rnd, 0.01, 0.01 if i % 2 else 0))
    got = M.align_pairs([r.encode() for r in reads], [a.encode() for a in alleles], least=30, most=3)
    assert len({g[0] for g in got}) >= 145
    exact = 0
    for r, t, score, start, cigar, nm in got:
        assert told(reads[r], alleles[t], start, cigar) == (score, nm)
        exact += score == plain_local(reads[r], alleles[t])
    assert exact >= 0.99 * len(got)
    assert max(np.bincount([g[0] for g in got])) <= 3


@pytest.fixture(scope="module")
def panel():
    rnd = random.Random(5)
    out = {}
    for locus in ("A", "B"):
        base = "".join(rnd.choices("ACGT", k=900))
        for i in range(12):
            s = list(base)
            for j in random.Random(f"{locus}{i}").sample(range(900), 25 if i else 0):
                s[j] = "ACGT"[("ACGT".index(s[j]) + 1) % 4]
            out[locus, f"{locus}*{i + 1:02d}:01"] = "".join(s)
    return out


def test_map_reads(spark, panel):
    rnd = random.Random(6)
    own = {"s1": [("A", "A*03:01"), ("A", "A*07:01"), ("B", "B*02:01"), ("B", "B*02:01")], "s2": [("A", "A*01:01"), ("A", "A*12:01"), ("B", "B*05:01"), ("B", "B*09:01")]}
    rows, truth = [], {}
    for sample, alleles in own.items():
        for h, key in enumerate(alleles):
            for i in range(60):
                at = rnd.randrange(0, 750)
                seq = panel[key][at : at + 150]
                name = f"{h}-{i}"
                truth[sample, name] = key, at, i % 2
                rows.append((sample, name, revcomp(seq) if i % 2 else seq, "I" * 75 + "#" * 75))
    rows += [("s1", "null", None, None), ("s1", "short", "ACGT", "IIII"), ("s1", "other", "".join(rnd.choices("ACGT", k=150)), "I" * 150), ("s1", "n", "N" * 150, "I" * 150)]
    reads = spark.createDataFrame(rows, "sample_id string, read_id string, seq string, qual string")
    alleles = spark.createDataFrame([(*k, s) for k, s in panel.items()], "locus string, allele string, seq string")
    got = M.map_reads(reads, alleles, top=4, most=3).collect()
    assert {(r["sample_id"], r["name"]) for r in got} == set(truth)
    by = {}
    for r in got:
        by.setdefault((r["sample_id"], r["name"]), []).append(r)
        s = panel[r["locus"], r["ref"]]
        assert told(r["seq"], s, r["pos0"], r["cigar"]) == (r["as_score"], r["nm"])
    for key, hits in by.items():
        (locus, allele), at, turned = truth[key]
        assert len(hits) <= 3 and sum(not r["flag"] & 256 for r in hits) == 1
        best = [r for r in hits if r["as_score"] == max(x["as_score"] for x in hits)]
        mine = [r for r in best if r["ref"] == allele]
        assert mine and mine[0]["pos0"] == at and mine[0]["cigar"] == "150M" and mine[0]["nm"] == 0 and bool(mine[0]["flag"] & 16) == bool(turned)
        assert all(r["mapq"] == (0 if r not in best else 60 if len(best) == 1 else 1) for r in hits)
        assert mine[0]["qual"] == ("#" * 75 + "I" * 75 if turned else "I" * 75 + "#" * 75)
    assert M.map_reads(reads.where("false"), alleles).count() == 0


def test_candidates_hold_the_true_alleles_and_slices_agree(spark, panel):
    rnd = random.Random(7)
    rows = [("s", f"{a}{i}", panel["A", a][at : at + 120]) for a in ("A*04:01", "A*09:01") for i in range(80) for at in [rnd.randrange(0, 780)]]
    reads = spark.createDataFrame(rows, "sample_id string, read_id string, seq string")
    alleles = spark.createDataFrame([(*k, s) for k, s in panel.items()], "locus string, allele string, seq string")
    rs, als = M.seeds(reads, M.READ), M.seeds(alleles, ["locus", "allele"])
    located = M.locate(rs, als)
    assert {(r["locus"], r["flip"]) for r in located.collect()} == {("A", False)} and located.count() == len(rows)
    assert {r["allele"] for r in M.candidates(located, rs, als, top=2).collect()} == {"A*04:01", "A*09:01"}
    turned = reads.withColumn("locus", F.lit("A")).withColumn("flip", F.lit(False))
    chosen = alleles.where("locus = 'A'").withColumn("sample_id", F.lit("s"))
    whole = sorted(tuple(r) for r in M.align(turned, chosen).collect())
    assert sorted(tuple(r) for r in M.align(turned, chosen, slice_rows=7).collect()) == whole and len(whole) > len(rows)
