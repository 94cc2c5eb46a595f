"""Iterative kernels that columns cannot express: one group is one locus of one sample.

Everything around them is native; each ships only the columns that it needs.
For variational weights reads with equal evidence are combined, with their
number, before the kernel sees them, so a group is bounded by the different
patterns of one locus; phasing gets a locus's different signatures of reads,
with their number.  Keys keep the types of the input.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, StructType

LOCUS = ["sample_id", "locus"]


def digamma(x: np.ndarray) -> np.ndarray:
    """Psi by recurrence up to 10 and the asymptotic series."""
    x = np.array(x, dtype=float)
    out = np.zeros_like(x)
    while (low := x < 10).any():
        out[low] -= 1 / x[low]
        x[low] += 1
    f = 1 / (x * x)
    return out + np.log(x) - 0.5 / x - f * (1 / 12 - f * (1 / 120 - f * (1 / 252 - f * (1 / 240 - f / 132))))


def chi2_sf(x: float, df: float) -> float:
    """Survival function of chi-square: the regularised upper incomplete gamma function."""
    a, x = df / 2, x / 2
    if x <= 0 or a <= 0:
        return 1.0
    front = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * front)
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


@pandas_udf(DoubleType())
def chi2_pvalue(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([chi2_sf(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(x, df)], dtype="float64")


def _typed(df: DataFrame, *columns: str) -> str:
    """The columns with their types, as a schema."""
    return ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in columns)


#: Numbers of a piece of the evidence matrix; what a round derives from them is made piece by piece.
PIECE = 1 << 18


def variational_weights(m: np.ndarray, prior: np.ndarray | None = None, rounds: int = 200, tolerance: float = 1e-6, times: np.ndarray | None = None):
    """(weights, dosages, evidence bound, rounds) of the allele mixture of reads x alleles scores; times: how many reads each row stands for."""
    n = m.shape[1]
    k = np.ones(len(m)) if times is None else times.astype(float)
    reads = k.sum()
    a0 = np.ones(n) if prior is None else 1 + n * prior / prior.sum()
    alpha = a0 + reads / n
    log_beta = lambda a: sum(map(math.lgamma, a)) - math.lgamma(a.sum())
    expected = lambda a: digamma(a) - digamma(np.array([a.sum()]))[0]
    size = max(1, PIECE // max(n, 1))

    def expect(alpha):
        """The reads of each allele, and what they add to the bound besides the alleles' expectations."""
        e, sums, bound = expected(alpha), np.zeros(n), 0.0
        for i in range(0, len(m), size):
            part, kp = m[i : i + size], k[i : i + size]
            with np.errstate(divide="ignore", invalid="ignore"):
                ll = np.where(part > 0, np.log(part / part.max(axis=1, keepdims=True)), -np.inf)
            finite = np.isfinite(ll)
            s = e + ll
            peak = np.where(finite.any(axis=1), s.max(axis=1, initial=-np.inf), 0)
            q = np.where(finite, np.exp(s - peak[:, None]), 0)
            total = q.sum(axis=1, keepdims=True)
            q = np.divide(q, total, out=np.zeros_like(q), where=total > 0)
            some = q > 0
            kq = kp[:, None] * q
            sums += kp @ q
            bound += (kq[some] * ll[some]).sum() - (kq[some] * np.log(q[some])).sum()
        return sums, bound

    (sums, _), last, bound, r = expect(alpha), -np.inf, -np.inf, 0
    for r in range(1, rounds + 1):
        alpha = a0 + sums
        sums, own = expect(alpha)
        e = expected(alpha)
        bound = own + (sums * e).sum() + log_beta(a0) + ((a0 - 1) * e).sum() - log_beta(alpha) - ((alpha - 1) * e).sum()
        if abs(bound - last) < tolerance:
            break
        last = bound
    dosage = sums / reads if reads else np.zeros(n)
    return alpha / alpha.sum(), dosage / dosage.sum() if dosage.sum() else dosage, float(bound), r


def vb_em(weighted: DataFrame, frequencies: DataFrame | None = None) -> DataFrame:
    """(locus keys, allele, weight, dosage, elbo, iterations); frequencies(allele, freq) are optional priors.

    Reads of equal weights are counted before the kernel; patterns stand in
    order of their alleles and weights, so reruns agree.  An allele without a
    frequency has the mean share.
    """
    of_read = weighted.groupBy(*LOCUS, "read_id").agg(F.array_sort(F.collect_list(F.struct("allele", F.col("weight").alias("w")))).alias("e"))
    rows = of_read.groupBy(*LOCUS, "e").agg(F.count("*").alias("times"))
    rows = rows.select(*LOCUS, F.col("e.allele").alias("alleles"), F.col("e.w").alias("w"), "times")
    known = {}
    if frequencies is not None:
        alleles = weighted.select("locus", "allele").distinct().join(frequencies, "allele").groupBy("locus").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("allele", "freq")))).alias("freq"))
        rows = rows.join(alleles, "locus", "left")
        known = {"freq": True}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Only numbers are held of a batch: which alleles, their weights and how many reads.
        index, parts, keys, freq = {}, [], None, None
        for b in batches:
            if keys is None:
                keys, freq = [b.column(c).slice(0, 1) for c in LOCUS], b.column("freq")[0].as_py() if known else None
            alleles, w = b.column("alleles"), b.column("w")
            coded = alleles.flatten().dictionary_encode()
            code = np.array([index.setdefault(a, len(index)) for a in coded.dictionary.to_pylist()], dtype=np.int32)
            parts.append((code[np.asarray(coded.indices)], np.asarray(w.flatten()), np.asarray(alleles.value_lengths()).astype(np.int32), np.asarray(b.column("times")).copy()))
        names = sorted(index)
        at = np.empty(len(names), dtype=np.int32)
        at[[index[a] for a in names]] = np.arange(len(names))
        m, times, have = np.zeros((sum(len(p[3]) for p in parts), len(names))), np.concatenate([p[3] for p in parts]), 0
        parts.reverse()
        while parts:
            code, w, n, _ = parts.pop()
            m[have + np.repeat(np.arange(len(n)), n), at[code]] = w
            have += len(n)
        order = np.lexsort(m.T[::-1])
        m, times = m[order], times[order]
        del order
        prior = None
        if freq is not None:
            f = dict(freq)
            prior = np.array([f.get(a, 1 / len(names)) for a in names])
        w, d, bound, r = variational_weights(m, prior, times=times)
        repeated = [pa.concat_arrays([c] * len(names)) for c in keys]
        yield pa.RecordBatch.from_arrays([*repeated, pa.array(names, pa.string()), pa.array(w), pa.array(d), pa.array([bound] * len(names)), pa.array([r] * len(names), pa.int32())], names=[*LOCUS, "allele", "weight", "dosage", "elbo", "iterations"])

    return rows.groupBy(*LOCUS).applyInArrow(run, _typed(weighted, *LOCUS, "allele") + ", weight double, dosage double, elbo double, iterations int")


class Signatures:
    """The distinct reads of a locus in order of first appearance: the sites that each sees and what it has there (0, 1), one after the other, and how many reads each is."""

    def __init__(self, seen: np.ndarray, site: np.ndarray, value: np.ndarray, times: np.ndarray):
        self.seen, self.site, self.value, self.times = seen, site, value, times
        self.start = np.concatenate([[0], np.cumsum(seen)])
        self.n, self.sites = len(seen), int(site.max()) + 1 if len(site) else 0

    @classmethod
    def of(cls, m: np.ndarray) -> tuple[Signatures, np.ndarray]:
        """Those of reads x sites (0, 1, -1 missing), and which one each read is."""
        sig, first, back, times = np.unique(m, axis=0, return_index=True, return_inverse=True, return_counts=True)
        order = np.argsort(first)
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        sig = sig[order]
        row, site = np.nonzero(sig >= 0)
        return cls(np.bincount(row, minlength=len(sig)), site, sig[row, site], times[order]), rank[back.reshape(-1)]

    def sums(self, x: np.ndarray) -> np.ndarray:
        """Sums over each signature's sites."""
        c = np.concatenate([[0], np.cumsum(x, dtype=np.int64)])
        return c[self.start[1:]] - c[self.start[:-1]]

    def against(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Sites at which each signature agrees with one of them, and at which it differs."""
        own = np.full(self.sites, -1, dtype=np.int8)
        own[self.site[self.start[i] : self.start[i + 1]]] = self.value[self.start[i] : self.start[i + 1]]
        there = own[self.site]
        return self.sums(there == self.value), self.sums((there >= 0) & (there != self.value))

    def take(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which of the rows, site, value) of some signatures."""
        n = self.seen[rows]
        at = np.repeat(self.start[rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return np.repeat(np.arange(len(rows)), n), self.site[at], self.value[at]


def _greedy(s: Signatures, later=None) -> tuple[np.ndarray, tuple[int, int] | None]:
    """(bins, the second seed): two seeds, the others by matches less mismatches; -1 if neither tells.

    The second seed, (signature, which of its reads), is in bin 1 whatever its
    signature's bin.  later(i, j): whether the second read of signature i comes
    after the first one of j.
    """
    out = np.full(s.n, -1)
    first = int(np.argmax(s.seen))
    out[first] = 0
    match, miss = s.against(first)
    differ = np.where(match + miss > 0, miss, -1)
    differ[first] = -1
    top = differ.max()
    ties = np.flatnonzero(differ == top)
    second, which = int(ties[np.argmax(s.seen[ties])]), 1
    # The other reads of the first seed's signature see as many sites as it does and differ at none.
    if s.times[first] > 1 and (top < 0 or top == 0 and (s.seen[second] < s.seen[first] or not later(first, second))):
        second, which, top = first, 2, 0
    if top < 0:
        return out, None
    same, other = s.against(second)
    a, b = match - miss, same - other
    return np.where((a == 0) & (b == 0), -1, np.where(a >= b, 0, 1)), (second, which)


def greedy_bins(m: np.ndarray) -> np.ndarray:
    """Two bins of reads x sites (0, 1, -1 missing): two seeds, the others by matches less mismatches; -1 if neither tells."""
    s, back = Signatures.of(m)
    nth = lambda i, k: int(np.flatnonzero(back == i)[k - 1])
    bins, seed = _greedy(s, lambda i, j: nth(i, 2) > nth(j, 1))
    out = bins[back]
    if seed:
        out[nth(*seed)] = 1
    return out


def _farthest(s: Signatures) -> tuple[int, int]:
    """The first pair of signatures of those that differ at most sites; the first two where none see a common site.

    Sites are bits.  A pair differs at no more sites than the ones of either
    and the zeros of the other allow, so a signature meets those only that
    could exceed what is found so far; memory is linear.
    """
    words = -(-s.sites // 64)
    bits = np.zeros((2, s.n, words), dtype=np.uint64)
    row = np.repeat(np.arange(s.n), s.seen)
    np.bitwise_or.at(bits, (s.value, row, s.site // 64), np.uint64(1) << (s.site % 64).astype(np.uint64))
    zero, one = bits
    ones = s.sums(s.value == 1)
    zeros = s.seen - ones

    def differ(i: int, j: np.ndarray) -> np.ndarray:
        n = np.bitwise_count((one[j, 0] & zero[i, 0]) | (zero[j, 0] & one[i, 0])).astype(np.int32)
        for w in range(1, words):
            n += np.bitwise_count((one[j, w] & zero[i, w]) | (zero[j, w] & one[i, w]))
        return n

    every, most = np.arange(s.n), 1
    for i in np.argsort(-s.seen, kind="stable")[:64]:  # what may be reached at once
        most = max(most, int(differ(i, every).max()))
    best, pair = most - 1, None
    while True:
        left = every[s.seen > best] if pair is None else every[(s.seen > best) & (every > pair[0])]
        kinds = np.unique(ones[left] * (s.sites + 1) + zeros[left])
        able, better = {}, None
        for i in left:
            kind = (int(ones[i]), int(zeros[i])) if len(kinds) <= 64 else None
            if kind not in able:
                able[kind] = left if kind is None else left[np.minimum(kind[0], zeros[left]) + np.minimum(kind[1], ones[left]) > best]
            j = able[kind]
            j = j[np.searchsorted(j, i, side="right") :]
            if len(j):
                n = differ(i, j)
                k = int(n.argmax())
                if n[k] > best:
                    best, better = int(n[k]), (int(i), int(j[k]))
                    break
        if better is None:
            break
        pair = better
    if pair is not None:
        return pair
    last = np.zeros(s.sites, dtype=np.int64)
    np.maximum.at(last, s.site, row)
    met = np.flatnonzero(s.sums(last[s.site] > row) > 0)
    if not len(met):
        return 0, 1
    i = int(met[0])
    match, miss = s.against(i)
    return i, i + 1 + int(np.flatnonzero((match + miss)[i + 1 :] > 0)[0])


def _signature(s: Signatures) -> np.ndarray:
    if s.n < 2:
        return np.zeros(s.n, dtype=int)
    a, b = (s.against(i)[0] for i in _farthest(s))
    return np.where(a >= b, 0, 1)


def signature_bins(m: np.ndarray) -> np.ndarray:
    """Two bins by the most divergent pair of read signatures."""
    s, back = Signatures.of(m)
    return _signature(s)[back]


class _Agreement:
    """The matrix of signatures' agreement (sites at which two have the same, as a share of those that both see) as an operator.

    The share is a sum over the subsets of the common sites: those of k sites
    weigh (-1)^(k-1) / k for each site that agrees.  So signatures of few sites
    meet in what they share of subset, site and value, which is linear in their
    number; those of many sites meet all others block by block.
    """

    MOST, BLOCK = 7, 1 << 22

    def __init__(self, s: Signatures):
        self.s = s
        width = max(1, int(s.sites).bit_length())
        most = min(self.MOST, 58 // width)
        self.long = np.flatnonzero(s.seen > most)
        self.levels, self.own = [], np.zeros(s.n)
        groups = [(n, np.flatnonzero(s.seen == n)) for n in range(1, most + 1)]
        for k in range(1, most + 1):
            keys, rows = [], []
            for n, r in groups:
                if n < k or not len(r):
                    continue
                at = s.start[r]
                for subset in combinations(range(n), k):
                    code = np.zeros(len(r), dtype=np.uint64)
                    for i in subset:
                        code = code << np.uint64(width) | (s.site[at + i] + 1).astype(np.uint64)
                    for where, i in enumerate(subset):
                        keys.append(code << np.uint64(4) | np.uint64(2 * where) | s.value[at + i].astype(np.uint64))
                        rows.append(r.astype(np.int32))
            if not keys:
                continue
            _, feature, times = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
            del keys
            # What one signature has alone is a part of its agreement with itself, which is known.
            shared = times[feature] > 1
            rank = np.cumsum(times > 1) - 1
            row, feature = np.concatenate(rows)[shared], rank[feature[shared]].astype(np.int32)
            weight = (-1.0) ** (k - 1) / k
            self.own += weight * np.bincount(row, minlength=s.n)
            self.levels.append((weight, row, feature, int(rank[-1]) + 1))
        self.kept = [] if len(self.long) * s.n <= self.BLOCK * 4 else None

    def _blocks(self):
        """(rows, columns, their agreement) of signatures of many sites with all."""
        if self.kept:
            yield from self.kept
            return
        for a in range(0, len(self.long), 512):
            rows = self.long[a : a + 512]
            for b in range(0, self.s.n, 8192):
                columns = np.arange(b, min(b + 8192, self.s.n))
                both = same = 0
                dense = []
                for r in (rows, columns):
                    which, site, value = self.s.take(r)
                    d = np.zeros((2, len(r), self.s.sites), dtype=np.float32)
                    d[value, which, site] = 1
                    dense.append(d)
                (x0, x1), (y0, y1) = dense
                same, both = x0 @ y0.T + x1 @ y1.T, (x0 + x1) @ (y0 + y1).T
                block = rows, columns, np.divide(same, both, out=np.zeros(both.shape), where=both > 0)
                if self.kept is not None:
                    self.kept.append(block)
                yield block

    def __matmul__(self, x: np.ndarray) -> np.ndarray:
        n = self.s.n
        y = np.zeros(n)
        for weight, row, feature, features in self.levels:
            t = np.zeros(features)
            parts = [slice(i, i + self.BLOCK) for i in range(0, len(row), self.BLOCK)]
            for p in parts:
                t += np.bincount(feature[p], weights=x[row[p]], minlength=features)
            for p in parts:
                y += weight * np.bincount(row[p], weights=t[feature[p]], minlength=n)
        y += (1 - self.own) * x
        y[self.long] = 0
        if len(self.long):
            many = np.zeros(n, dtype=bool)
            many[self.long] = True
            for rows, columns, block in self._blocks():
                y[rows] += block @ x[columns]
                few = ~many[columns]
                y[columns[few]] += x[rows] @ block[:, few]
        return y


def _second_vector(apply, n: int, first: np.ndarray, keep: int = 40, rounds: int = 100) -> np.ndarray:
    """Eigenvector of the second largest eigenvalue of a symmetric operator whose first is known: Krylov spaces of `keep` vectors, begun again with the best ones until it settles."""
    first = first / np.linalg.norm(first)
    keep = min(keep, n - 1)
    x = np.cos(np.arange(n) * 2.399963)  # a fixed start
    x -= first * (first @ x)
    basis, h, have = np.zeros((keep + 1, n)), np.zeros((keep + 1, keep + 1)), 0
    basis[0] = x / np.linalg.norm(x)
    for _ in range(rounds):
        for k in range(have, keep):
            y = apply(basis[k])
            for again in range(3):
                y -= first * (first @ y)
                part = basis[: k + 1] @ y
                y -= part @ basis[: k + 1]
                if not again:
                    h[k, : k + 1] = h[: k + 1, k] = part
            size = np.linalg.norm(y)
            if k % 10 == 9 or k == keep - 1 or size < 1e-12:
                value, vector = np.linalg.eigh(h[: k + 1, : k + 1])
                if abs(size * vector[-1, -1]) < 1e-9 or size < 1e-12:
                    return vector[:, -1] @ basis[: k + 1]
            basis[k + 1] = y / size
        have = min(keep // 4, keep - 1)
        basis[:have], basis[have] = vector[:, -have:].T @ basis[:keep], basis[keep].copy()
        h[:] = 0
        h[np.arange(have), np.arange(have)] = value[-have:]
    return vector[:, -1] @ basis[:keep] if not have else basis[have - 1]


#: Signatures up to which the eigenvectors are all found from the whole matrix.
DENSE = 800


def _spectral(s: Signatures) -> np.ndarray | None:
    """Bins of signatures, or nothing if the eigenvectors cannot be found."""
    sim = _Agreement(s)
    times = s.times.astype(float)
    degree = sim @ times - 1
    degree[degree == 0] = 1e-10
    scale = np.sqrt(times / degree)
    first = np.sqrt(times * degree)
    apply = lambda x: scale * (sim @ (scale * x)) - x / degree  # noqa: E731  the Laplacian is 1 less this
    try:
        if s.n <= DENSE:
            _, vectors = np.linalg.eigh(np.array([apply(x) for x in np.eye(s.n)]))
            v = vectors[:, -2] if s.n > 1 else vectors[:, 0]
        else:
            v = _second_vector(apply, s.n, first)
    except np.linalg.LinAlgError:
        return None
    v = v / np.sqrt(times)
    v = v * (np.sign(v[np.flatnonzero(np.abs(v) > 1e-12)[:1]]).prod() or 1)  # a fixed sign
    order = np.argsort(v, kind="stable")
    upto = np.cumsum(s.times[order])
    at = lambda k: v[order[np.searchsorted(upto, k, side="right")]]
    median = (at((upto[-1] - 1) // 2) + at(upto[-1] // 2)) / 2
    return np.where(v <= median, 0, 1)


def spectral_bins(m: np.ndarray) -> np.ndarray:
    """Two bins by the second eigenvector of the normalised Laplacian of reads' agreement, cut at its median.

    Reads of equal signature have equal entries in the eigenvector, so it is
    found on signatures weighted by their reads.
    """
    s, back = Signatures.of(m)
    bins = _spectral(s)
    return greedy_bins(m) if bins is None else bins[back]


def phase(matrix: DataFrame, method: str = "greedy", min_sites: int = 2, min_reads: int = 4) -> DataFrame:
    """(locus keys, read_id, bin, method) of matrix(locus keys, read_id, pos, v); bin -1 is unassigned.

    method: greedy (with the spectral one where its balance is below 0.1 and
    there are 3 sites or more), signature or spectral.  Loci with too few
    sites or reads stay unassigned.  A kernel gets the different signatures of
    a locus with their numbers of reads; the reads join their signature's bin.
    """
    seen = matrix.groupBy(*LOCUS, "read_id").agg(F.array_sort(F.collect_list(F.struct("pos", "v"))).alias("_all"))
    seen = seen.select(*LOCUS, "read_id", F.filter("_all", lambda x, i: (i == 0) | (F.get("_all", i - 1).pos != x.pos)).alias("sig"))
    same = [*LOCUS, "sig"]
    reads = seen.withColumn("_k", F.row_number().over(Window.partitionBy(*same).orderBy("read_id")))
    found = reads.groupBy(*same).agg(F.count("*").alias("times"), F.min("read_id").alias("first"), F.max(F.when(F.col("_k") == 2, F.col("read_id"))).alias("next"))

    def run(t: pa.Table) -> pa.Table:
        t = t.take(pa.compute.sort_indices(t, [("first", "ascending")])).combine_chunks()
        sig = t.column("sig").combine_chunks()
        flat = sig.flatten()
        sites, site = np.unique(flat.field("pos").to_numpy(zero_copy_only=False), return_inverse=True)
        s = Signatures(np.asarray(sig.value_lengths()).astype(np.int64), site.astype(np.int64), np.asarray(flat.field("v")).astype(np.int8), np.asarray(t.column("times")))
        bins, used, seed = np.full(s.n, -1), "none", None
        if len(sites) >= min_sites and s.times.sum() >= min_reads:
            used = method
            greedy = lambda: _greedy(s, lambda i, j: t.column("next")[i].as_py() > t.column("first")[j].as_py())
            if method == "greedy":
                bins, seed = greedy()
                n = np.array([s.times[bins == b].sum() for b in (0, 1)])
                if seed and bins[seed[0]] != 1:  # one read more in bin 1
                    n += [-1 if bins[seed[0]] == 0 else 0, 1]
                if len(sites) >= 3 and n.sum() and n.min() / n.sum() < 0.10:
                    found = _spectral(s)
                    bins, seed, used = (*greedy(), "spectral") if found is None else (found, None, "spectral")
            elif method == "spectral":
                bins = _spectral(s)
                if bins is None:
                    bins, seed = greedy()
            else:
                bins = _signature(s)
        seeds = np.zeros(s.n, dtype=np.int32)
        if seed:
            seeds[seed[0]] = seed[1]
        out = {"bin": pa.array(bins.astype(np.int32)), "method": pa.array([used] * s.n), "_seed": pa.array(seeds)}
        return pa.table({**{c: t.column(c) for c in same}, **out})

    bins = found.groupBy(*LOCUS).applyInArrow(run, StructType([found.schema[c] for c in same]).add("bin", "integer").add("method", "string").add("_seed", "integer"))
    bin_ = F.when(F.col("_k") == F.col("_seed"), F.lit(1)).otherwise(F.col("bin"))
    return reads.join(bins, same).select(*LOCUS, "read_id", bin_.alias("bin"), "method")
