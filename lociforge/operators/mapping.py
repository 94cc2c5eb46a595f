"""Reads to alignments: seeds, chains and banded local alignment.

A panel's alleles of a locus share nearly all of their sequence, so joining
the seeds of reads with those of alleles gives reads x alleles.  Instead

    locate      joins a read's minimizers with those of whole loci: a few rows a seed
    candidates  counts reads a minimizer and ranks each locus's alleles by the share of theirs that reads hold
    align       brings slices of a locus's reads together with the few candidates, chains seeds and aligns

Reads of one locus are cut into slices of a bounded size, so neither a deep
sample nor a frequent locus meets in one task, and a read gets `most` rows at
most, those of the best scores, as an aligner reports its best hits.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..storage import kept

LOCUS = ["sample_id", "locus"]
READ = ["sample_id", "read_id"]

# Scores of an aligner's short-read setting, and the half width of the band around the chain.
MATCH, MISMATCH, OPEN, EXTEND = 2, 8, 12, 2
BAND = 16
#: Letters of a seed and k-mers of a window.
K, W = 15, 8
#: Seeds of loci that are broadcast at most (their number is checked), and reads of a slice.
BROADCAST_SEEDS, SLICE = 4_000_000, 4096
#: Cells that are aligned at once.
CELLS = 1 << 22

_CODE = np.full(256, 4, dtype=np.uint8)
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
_COMPLEMENT = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")


# ---- seeds ---------------------------------------------------------------------------------------------------------------------


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def minimizers(seqs: list[bytes], k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(sequence, position, hash, forward) of the k-mers of least hash among each w in a row; a shorter sequence has its least one.

    The hash is that of the lesser of a k-mer and its reverse complement,
    `forward` tells which it was; k-mers that hold other letters than A, C, G
    and T are none.
    """
    gap = b"N" * (w + k)
    text = gap + gap.join(seqs) + gap
    begin = len(gap) + np.concatenate([[0], np.cumsum([len(s) + len(gap) for s in seqs])]).astype(np.int64)
    c = _CODE[np.frombuffer(text, dtype=np.uint8)]
    n = len(c) - k + 1
    forward, back = np.zeros(n, dtype=np.uint64), np.zeros(n, dtype=np.uint64)
    for j in range(k):
        letter = (c[j : j + n] & 3).astype(np.uint64)
        forward = forward << np.uint64(2) | letter
        back |= (np.uint64(3) - letter) << np.uint64(2 * j)
    bad = np.concatenate([[0], np.cumsum(c == 4)])
    good = bad[k:] == bad[:-k]
    h = np.where(good, _mixed(np.minimum(forward, back)), np.uint64(0xFFFFFFFFFFFFFFFF))
    at = np.unique(np.arange(n - w + 1) + np.lib.stride_tricks.sliding_window_view(h, w).argmin(axis=1))
    at = at[good[at]]
    of = np.searchsorted(begin, at, side="right") - 1
    return of, at - begin[of], h[at].view(np.int64), forward[at] <= back[at]


def _seed_rows(batches, keys: int, k: int, w: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        for a in range(0, batch.num_rows, 1024):
            part = batch.slice(a, 1024)
            of, at, h, forward = minimizers([(s or "").encode() for s in part.column(keys).to_pylist()], k, w)
            taken = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(i).take(taken) for i in range(keys)), pa.array(h), pa.array(at.astype(np.int32)), pa.array(forward)],
                names=[*part.schema.names[:keys], "h", "at", "forward"],
            )


def seeds(df: DataFrame, keys: list[str], seq: str = "seq", k: int = K, w: int = W) -> DataFrame:
    """(keys, h, at, forward): the minimizers of each sequence."""
    rows = df.select(*keys, seq)
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    return rows.mapInArrow(lambda b: _seed_rows(b, len(keys), k, w), f"{kinds}, h long, at int, forward boolean")


def locate(read_seeds: DataFrame, allele_seeds: DataFrame, least: int = 3, near: float = 0.8) -> DataFrame:
    """(sample_id, read_id, locus, flip, n): the loci that share `least` minimizers with a read and `near` of the most that one shares; flip: as reverse complement."""
    of_loci = allele_seeds.select("locus", "h", F.col("forward").alias("_f")).distinct()
    if of_loci.count() <= BROADCAST_SEEDS:
        of_loci = F.broadcast(of_loci)
    n = read_seeds.join(of_loci, "h").groupBy(*READ, "locus", (F.col("forward") != F.col("_f")).alias("flip")).agg(F.countDistinct("h").alias("n"))
    read = Window.partitionBy(*READ)
    n = n.withColumn("_best", F.max("n").over(read)).where((F.col("n") >= least) & (F.col("n") >= near * F.col("_best")))
    order = Window.partitionBy(*READ, "locus").orderBy(F.col("n").desc(), "flip")
    return n.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r", "_best")


def candidates(located: DataFrame, read_seeds: DataFrame, allele_seeds: DataFrame, top: int = 80, depth: int = 2) -> DataFrame:
    """(sample_id, locus, allele, share, rank): alleles by the share of their minimizers that `depth` of the locus's reads hold (ties: more of them, name).

    Minimizers that all of a locus's alleles have tell none from another and
    are left out; where there are no others all alleles are alike.
    """
    own = allele_seeds.select("locus", "allele", "h").distinct()
    alleles = own.groupBy("locus").agg(F.countDistinct("allele").alias("_all"))
    telling = own.join(own.groupBy("locus", "h").agg(F.count("*").alias("_n")), ["locus", "h"]).join(F.broadcast(alleles), "locus").where("_n < _all").select("locus", "h", "allele")
    size = own.select("locus", "allele").distinct().join(telling.groupBy("locus", "allele").agg(F.count("*").alias("size")), ["locus", "allele"], "left")
    seen = read_seeds.select(*READ, "h").distinct().join(located.select(*READ, "locus"), READ).groupBy(*LOCUS, "h").agg(F.count("*").alias("d")).where(F.col("d") >= depth)
    covered = seen.join(telling, ["locus", "h"]).groupBy(*LOCUS, "allele").agg(F.count("*").alias("covered"))
    every = located.select(*LOCUS).distinct().join(size, "locus").join(covered, [*LOCUS, "allele"], "left").na.fill(0, ["covered"])
    ranked = every.withColumn("share", F.coalesce(F.col("covered") / F.col("size"), F.lit(1.0)))
    order = Window.partitionBy(*LOCUS).orderBy(F.col("share").desc(), F.col("covered").desc(), "allele")
    return ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top).select(*LOCUS, "allele", "share", "rank")


# ---- chains --------------------------------------------------------------------------------------------------------------------


def longest_chain(reads: np.ndarray, targets: np.ndarray) -> np.ndarray:
    """Indices of the most seeds that rise in both places (strictly; the first found of equals)."""
    order = np.lexsort((-targets, reads))
    tails, last, before = [], [], np.full(len(order), -1)
    for i in order:
        j = bisect_left(tails, targets[i])
        before[i] = last[j - 1] if j else -1
        if j == len(tails):
            tails.append(targets[i])
            last.append(i)
        else:
            tails[j], last[j] = targets[i], i
    out, i = [], last[-1] if last else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return np.array(out[::-1], dtype=np.int64)


# ---- alignment -----------------------------------------------------------------------------------------------------------------

# Codes beside those of the four letters: any other letter, nothing of the target, nothing of the read.
_OTHER, _NO_TARGET, _NO_READ = 4, 5, 6


def _steps(read: np.ndarray, target: np.ndarray) -> np.ndarray:
    inside = (target != _NO_TARGET) & (read != _NO_READ)
    return np.where(inside, np.where((read == target) & (read < _OTHER), MATCH, -MISMATCH), -(1 << 20))


def ungapped(read: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score, start, end) of the best local alignment without gaps of each row of codes with the other's: of equal scores the longest that ends first."""
    total = np.concatenate([np.zeros((len(read), 1), np.int64), np.cumsum(_steps(read, target), axis=1)], axis=1)
    low = np.minimum.accumulate(total, axis=1)
    end = (total - low).argmax(axis=1)[:, None]
    floor = np.take_along_axis(low, end, axis=1)
    return (np.take_along_axis(total, end, axis=1) - floor)[:, 0], (total == floor).argmax(axis=1), end[:, 0]


def banded(read: np.ndarray, target: np.ndarray, band: int = BAND) -> list[tuple[int, int, int, list]]:
    """(score, start in read, start in target, operations) of the best local alignment with affine gaps of each pair of rows of codes.

    Letter i of a read meets letters i to i + 2 * band of its target row.  All
    pairs advance together, one letter of the reads at a time; the gap along a
    row is a running maximum.  Operations are (count, letter) of M, I and D.
    """
    p, n, width = len(read), read.shape[1], 2 * band + 1
    low = np.int64(-(1 << 30))
    none = np.full((p, 1), low)
    h, e = np.zeros((p, width), np.int64), np.full((p, width), low)
    kinds, origins = np.zeros((n, p, width), np.uint8), np.zeros((n, p, width), np.int16)
    best, row, column = np.zeros(p, np.int64), np.zeros(p, np.int64), np.zeros(p, np.int64)
    ramp, number = EXTEND * np.arange(width), np.arange(width)
    for i in range(n):
        step = _steps(read[:, i : i + 1], target[:, i : i + width])
        diagonal = h + step
        # A letter of the read against none of the target comes from the row before, one place to the right.
        opened, longer = np.concatenate([h[:, 1:], none], axis=1) - OPEN - EXTEND, np.concatenate([e[:, 1:], none], axis=1) - EXTEND
        e = np.maximum(opened, longer)
        g = np.maximum(np.maximum(diagonal, e), 0)
        # Letters of the target against none of the read come from a place to the left: the running maximum keeps value and place.
        run = np.maximum.accumulate((g + ramp) * width + number, axis=1)
        run = np.concatenate([np.full((p, 1), low * width), run[:, :-1]], axis=1)
        f = run // width - ramp - OPEN
        inside = step > -(1 << 19)
        h, e = np.where(inside, np.maximum(g, f), 0), np.where(inside, e, low)
        kinds[i] = np.where(h <= 0, 0, np.where(h == diagonal, 1, np.where(h == e, 2, 3))) | np.where(longer > opened, 4, 0)
        origins[i] = run % width
        top = h.argmax(axis=1)
        value = h[np.arange(p), top]
        more = value > best
        best, row, column = np.where(more, value, best), np.where(more, i, row), np.where(more, top, column)
    out = []
    for x in range(p):
        i, j, ops = int(row[x]), int(column[x]), []
        while best[x] and i >= 0 and (kind := kinds[i, x, j] & 3):
            if kind == 1:
                ops.append((1, "M"))
                i -= 1
            elif kind == 2:
                on = True
                while on:
                    on = bool(kinds[i, x, j] & 4)
                    ops.append((1, "I"))
                    i, j = i - 1, j + 1
            else:
                ops.append((j - int(origins[i, x, j]), "D"))
                j = int(origins[i, x, j])
        runs = []
        for count, op in reversed(ops):
            if runs and runs[-1][1] == op:
                runs[-1] = (runs[-1][0] + count, op)
            else:
                runs.append((count, op))
        out.append((int(best[x]), i + 1, i + 1 + j, runs))
    return out


def _codes(seqs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all sequences behind one another, and where each begins."""
    return _CODE[np.frombuffer(b"".join(seqs), dtype=np.uint8)], np.concatenate([[0], np.cumsum([len(s) for s in seqs])]).astype(np.int64)


def _rows(codes: np.ndarray, starts: np.ndarray, of: np.ndarray, first: np.ndarray, n: int, absent: int) -> np.ndarray:
    """n codes of each of the sequences `of` from place `first` on (below 0 or beyond the end: absent)."""
    at = first[:, None] + np.arange(n)[None, :]
    inside = (at >= 0) & (at < (starts[of + 1] - starts[of])[:, None])
    return np.where(inside, codes[np.where(inside, starts[of][:, None] + at, 0)], absent).astype(np.uint8)


def _chained(reads: list[bytes], alleles: list[bytes], index, k: int, w: int):
    """(read, allele, least and greatest diagonal) of the chain of each pair that shares seeds."""
    a_of, a_at, a_h, a_forward = index
    of, at, h, forward = minimizers(reads, k, w)
    lo, hi = np.searchsorted(a_h, h), np.searchsorted(a_h, h, side="right")
    seed = np.repeat(np.arange(len(h)), hi - lo)
    there = np.arange(len(seed)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[seed]
    same = forward[seed] == a_forward[there]
    seed, there = seed[same], there[same]
    pair, diagonal = of[seed] * len(alleles) + a_of[there], a_at[there] - at[seed]
    order = np.argsort(pair, kind="stable")
    pair, diagonal, seed, there = pair[order], diagonal[order], seed[order], there[order]
    edges = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    low, high = (np.minimum.reduceat(diagonal, edges), np.maximum.reduceat(diagonal, edges)) if len(edges) else (diagonal, diagonal)
    ends = np.append(edges[1:], len(pair))
    for i in np.flatnonzero(low != high):
        own = slice(edges[i], ends[i])
        found = diagonal[own][longest_chain(at[seed[own]], a_at[there[own]])]
        low[i], high[i] = found.min(), found.max()
    return pair[edges] // len(alleles), pair[edges] % len(alleles), low, high


def align_pairs(reads: list[bytes], alleles: list[bytes], least: int = 40, most: int = 51, k: int = K, w: int = W) -> list[tuple]:
    """(read, allele, score, start, CIGAR, nm) of the `most` best alignments of each read (ties: by allele) of score `least` at least.

    A pair whose chain keeps one diagonal gets its best alignment without
    gaps, if that leaves too little of the read to pay for one; any other its
    best in a band of BAND beyond the chain.  Parts of the read outside the
    alignment are clipped.
    """
    codes, starts = _codes(alleles)
    a_of, a_at, a_h, a_forward = minimizers(alleles, k, w)
    by = np.argsort(a_h, kind="stable")
    index = a_of[by], a_at[by], a_h[by], a_forward[by]
    out = []
    for a in range(0, len(reads), 128):
        part = reads[a : a + 128]
        r_codes, r_starts = _codes(part)
        of, allele, low, high = _chained(part, alleles, index, k, w)
        length, size = np.diff(r_starts)[of], np.diff(starts)[allele]
        gapped = low != high
        band = np.where(gapped, BAND << np.ceil(np.log2(np.maximum(((high - low) // 2 + BAND) / BAND, 1))).astype(np.int64), 0)
        middle = (low + high) // 2
        found, wider = [], np.zeros(len(band), dtype=bool)
        for b in sorted({0, BAND, *band.tolist()}):
            band[wider & (b > 0)] = np.maximum(band[wider & (b > 0)], BAND)
            # The part of the read that the allele can meet.
            first = np.maximum(0, -middle - band)
            n = np.minimum(length, size - middle + band) - first
            own = np.flatnonzero((band == b) & (n > 0))
            own = own[np.argsort(n[own], kind="stable")]
            at = 0
            while at < len(own):
                widest = n[own[at:]] * (2 * b + 1)
                count = max(1, int(np.searchsorted(widest * np.arange(1, len(widest) + 1), CELLS)))
                take = own[at : at + count]
                at += count
                m = int(n[take].max())
                read = _rows(r_codes, r_starts, of[take], first[take], m, _NO_READ)
                target = _rows(codes, starts, allele[take], first[take] + middle[take] - b, m + 2 * b, _NO_TARGET)
                if not b:
                    score, start, end = ungapped(read, target)
                    # What is clipped although the allele goes on could pay for a gap: these are done again in a band.
                    lost = (read != _NO_READ).sum(axis=1) - (end - start)
                    again = np.flatnonzero(lost * MATCH > OPEN + EXTEND + MATCH)
                    wider[take[again]] = True
                    keep = np.setdiff1d(np.arange(len(take)), again)
                    take, score, start, end, read, target = take[keep], score[keep], start[keep], end[keep], read[keep], target[keep]
                    wrong = np.concatenate([np.zeros((len(take), 1), np.int64), np.cumsum((read != target) | (read >= _OTHER), axis=1)], axis=1)
                    nm = wrong[np.arange(len(take)), end] - wrong[np.arange(len(take)), start]
                    found += [(x, int(s), int(first[x] + i), int(first[x] + i + middle[x]), [(int(j - i), "M")], int(e)) for x, s, i, j, e in zip(take, score, start, end, nm) if s >= least]
                else:
                    for row, (x, (s, i, j, ops)) in enumerate(zip(take, banded(read, target, b))):
                        if s >= least:
                            found.append((x, s, int(first[x] + i), int(first[x] + middle[x] - b + j), ops, _differences(read[row], target[row], i, j, ops)))
        ranked = {}
        for x, s, i, j, ops, nm in found:
            ranked.setdefault(int(of[x]), []).append((-s, int(allele[x]), x, i, j, ops, nm))
        for r, hits in ranked.items():
            for s, t, x, i, j, ops, nm in sorted(hits)[:most]:
                after = int(length[x]) - i - sum(c for c, op in ops if op != "D")
                clipped = [(i, "S"), *ops, (after, "S")]
                out.append((a + r, t, -s, j, "".join(f"{c}{op}" for c, op in clipped if c), nm))
    return out


def _differences(read: np.ndarray, target: np.ndarray, i: int, j: int, ops: list) -> int:
    nm = 0
    for count, op in ops:
        if op == "M":
            r, t = read[i : i + count], target[j : j + count]
            nm += int(((r != t) | (r >= _OTHER)).sum())
            i, j = i + count, j + count
        else:
            nm += count
            i, j = (i + count, j) if op == "I" else (i, j + count)
    return nm


def align(oriented: DataFrame, chosen: DataFrame, least: int = 40, most: int = 51, slice_rows: int = SLICE) -> DataFrame:
    """(sample_id, locus, read_id, flip, allele, as_score, pos0, cigar, nm) of oriented(sample_id, locus, read_id, flip, seq) and chosen(sample_id, locus, allele, seq).

    A locus's reads are cut into slices of about slice_rows by their hash;
    the chosen alleles, which are few, go with each slice.
    """
    n = oriented.groupBy(*LOCUS).agg(F.ceil(F.count("*") / slice_rows).cast("int").alias("_n"))
    reads = oriented.join(n, LOCUS).withColumn("_slice", F.pmod(F.xxhash64("read_id"), F.col("_n")).cast("int")).select(*LOCUS, "_slice", "read_id", "flip", "seq")
    targets = chosen.join(n, LOCUS).select(*LOCUS, F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("_slice"), "allele", "seq")
    # Names of their own, as both sides come from the same reads.
    targets = targets.toDF("_sample", "_locus", "_part", "allele", "seq")
    kinds = {c: oriented.schema[c].dataType.simpleString() for c in (*LOCUS, "read_id")}
    schema = f"sample_id {kinds['sample_id']}, locus {kinds['locus']}, read_id {kinds['read_id']}, flip boolean, allele string, as_score int, pos0 long, cigar string, nm int"

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        right = right.sort_by("allele")
        rows = align_pairs([s.encode() for s in left["seq"].to_pylist()], [s.encode() for s in right["seq"].to_pylist()], least, most) if len(left) and len(right) else []
        read, allele, score, start, cigar, nm = zip(*rows) if rows else [()] * 6
        taken = left.take(pa.array(read, pa.int64()))
        own = {"allele": right["allele"].take(pa.array(allele, pa.int64())), "as_score": pa.array(score, pa.int32()), "pos0": pa.array(start, pa.int64()), "cigar": pa.array(cigar, pa.string()), "nm": pa.array(nm, pa.int32())}
        return pa.table({c: taken[c] for c in ("sample_id", "locus", "read_id", "flip")} | own)

    return reads.groupBy(*LOCUS, "_slice").cogroup(targets.groupBy("_sample", "_locus", "_part")).applyInArrow(one, schema)


def map_reads(reads: DataFrame, alleles: DataFrame, top: int = 80, least: int = 40, most: int = 51) -> DataFrame:
    """reads(sample_id, read_id, seq [, qual]) against alleles(locus, allele, seq) as rows in the columns of sequences.sam, with sample_id and locus.

    A read's best hit (ties: by allele) is primary, the others, `most` in all
    at most, secondary; quality is 60 where the best score stands alone, 1 for
    hits that share it, 0 for the rest.  A read that no locus holds three
    minimizers of, and a null or short one, has no rows; an id names one read
    of a sample.
    """
    qual = F.col("qual") if "qual" in reads.columns else F.lit("*")
    own = reads.select(*READ, F.upper("seq").alias("seq"), qual.alias("qual")).where(F.length("seq") > 0)
    panel = alleles.select("locus", "allele", F.upper("seq").alias("seq"))
    read_seeds, allele_seeds = seeds(own, READ), seeds(panel, ["locus", "allele"])
    located = kept(locate(read_seeds, allele_seeds))
    chosen = candidates(located, read_seeds, allele_seeds, top).select(*LOCUS, "allele").join(panel, ["locus", "allele"])
    turned = own.join(located.select(*READ, "locus", "flip"), READ)
    turned = turned.withColumn("seq", F.when(F.col("flip"), S.reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).withColumn("qual", F.when(F.col("flip") & (F.col("qual") != "*"), F.reverse("qual")).otherwise(F.col("qual")))
    hits = align(turned.select(*LOCUS, "read_id", "flip", "seq"), chosen, least, most)
    read = Window.partitionBy(*READ)
    ranked = hits.withColumn("_best", F.max("as_score").over(read)).withColumn("_k", F.row_number().over(read.orderBy(F.col("as_score").desc(), "allele", "locus"))).where(F.col("_k") <= most)
    ranked = ranked.withColumn("_top", F.count_if(F.col("as_score") == F.col("_best")).over(read))
    mapq = F.when(F.col("as_score") < F.col("_best"), 0).when(F.col("_top") > 1, 1).otherwise(60)
    flag = F.when(F.col("flip"), 16).otherwise(0) + F.when(F.col("_k") > 1, 256).otherwise(0)
    rows = ranked.select(*READ, "locus", "flip", flag.alias("flag"), F.col("allele").alias("ref"), "pos0", mapq.alias("mapq"), "cigar", "nm", "as_score")
    return rows.join(turned.select(*READ, "locus", "seq", "qual"), [*READ, "locus"]).select("sample_id", "locus", F.col("read_id").alias("name"), "flag", "ref", "pos0", "mapq", "cigar", "seq", "qual", "nm", "as_score", F.lit(None).cast("string").alias("md"))
