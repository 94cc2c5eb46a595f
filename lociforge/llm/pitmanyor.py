"""Hierarchical Pitman-Yor language model, fitted and applied on packed batches.

The model has three levels: a uniform base over the training words and one
unknown word, a root restaurant of single words, and a restaurant for each
context, the word before (or the start of the text), whose parent is the root.

1. A slice of documents becomes a row of word numbers.  It sends each context's
   bucket one packed row: the words after it and their training counts.
2. A bucket holds whole restaurants.  A dish of one customer has one table; all
   others are live.  A sweep is a step of a block Gibbs sampler: each
   restaurant's rate is drawn from its gamma distribution given its tables,
   which makes its dishes independent, and then all customers of every live dish
   are seated at once by an exact draw of the number of tables given the rate
   (random numbers belong to the dish, so they are the same however the corpus
   is dealt).  A restaurant's tables are kept from sweep to sweep.
3. Every table is a customer of the root, whose dishes lie in shards.  After each
   round of sweeps the buckets send the tables of their words to the shards,
   which draw the root's rate and seat its dishes in the same way, and send the
   words' probabilities back for the next round.
4. Of each kept sample, the tables of pairs, of contexts and of the root go back
   to the slices that asked; a token's probability is the mean over the samples
   of the probability that each predicts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, gathered, written
from .wordscan import mix, scan

#: Discount and strength of the context restaurants and of the root.
DISCOUNT, STRENGTH = 0.75, 1.0
ROOT_DISCOUNT, ROOT_STRENGTH = 0.6, 20.0
#: Sweeps of the rounds before the last, sweeps of the last that are not kept, samples kept.
ROUNDS, BURN, KEPT = (2, 2), 1, 4
SLICE, BUCKET = 8 << 20, 8 << 20
#: Words of a shard of the root, about.
SHARD_WORDS = 1 << 19
#: Customers up to which the seating's recursion is run step by step (16 times as many where that matters), and cells of dishes x tables that are weighed at once.
STEPS, CELLS = 4096, 1 << 20
END, START = np.uint64(0x51ED270B35F7A3C9), np.uint64(0x2C1B3C6D9E77A5F1)
_GOLD = 0x9E3779B97F4A7C15
_ROW = "kind int, slice long, bucket int, blob binary, x array<double>"
_SCHEMA = pa.schema([("kind", pa.int32()), ("slice", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary()), ("x", pa.list_(pa.float64()))])
#: Kinds of rows: live dishes; a bucket's names; what a slice is told of counts; where a slice's questions stand; words of a bucket; sums; a slice's samples; answers of the root; a slice's tokens; tables for the root; a shard's words; tables of a bucket's restaurants.
LIVE, NAMES, COUNTS, PLACES, WORDS, SUMS, TABLES, ROOTS, TOKENS, UP, SHARD, STATE = range(12)


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays with their types and lengths, compressed byte plane by byte plane."""
    head = ";".join(f"{a.dtype.str},{len(a)}" for a in arrays).encode()
    planes = lambda a: np.ascontiguousarray(a).view(np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b""
    raw = len(head).to_bytes(4, "little") + head + b"".join(planes(a) for a in arrays)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int.from_bytes(raw[:4], "little")
    out, at = [], 4 + n
    for item in raw[4 : 4 + n].decode().split(";"):
        kind, size = item.split(",")
        n, width = int(size), np.dtype(kind).itemsize
        planes = np.frombuffer(raw, dtype=np.uint8, count=n * width, offset=at).reshape(width, n)
        out.append(np.ascontiguousarray(planes.T).reshape(-1).view(kind))
        at += n * width
    return out


def _steps(a: np.ndarray) -> np.ndarray:
    """Differences, which pack well; undone by a running sum."""
    return np.diff(a, prepend=a.dtype.type(0))


def _around(samples) -> list[np.ndarray]:
    """Samples of counts as the first and what the others are away from it, folded to be positive: mostly noughts."""
    first, *rest = (np.asarray(x).astype(np.int64) for x in samples)
    return [first.astype(np.uint32), *[np.where(x < first, 2 * (first - x) - 1, 2 * (x - first)).astype(np.uint32) for x in rest]]


def _samples(packed) -> list[np.ndarray]:
    """What _around was given."""
    first, *rest = (x.astype(np.int64) for x in packed)
    return [first, *[first + np.where(x % 2 == 1, -(x + 1) // 2, x // 2) for x in rest]]


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _SCHEMA)] if rows else [pa.array([], f.type) for f in _SCHEMA], schema=_SCHEMA)


def _row(kind: int, bucket: int, blob: bytes | None, sid: int = -1, x: list | None = None) -> tuple:
    return kind, sid, bucket, blob, x


def _of(t: pa.Table, kind: int):
    """(slice, arrays) of a group's rows of a kind."""
    for k, sid, blob in zip(t.column("kind").to_pylist(), t.column("slice").to_pylist(), t.column("blob")):
        if k == kind:
            yield sid, _unpack(blob.as_py())


def uniform(key: np.ndarray, k) -> np.ndarray:
    """The k-th random number in (0, 1) of each key; k is one number or one for each key."""
    step = np.uint64(int(k) * _GOLD & 0xFFFFFFFFFFFFFFFF) if np.isscalar(k) else k.astype(np.uint64) * np.uint64(_GOLD)
    return ((mix(key + step) >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)


def gamma(shape: np.ndarray, key: np.ndarray, salt: int) -> np.ndarray:
    """Gamma numbers of shapes of 1 and more (Marsaglia and Tsang), from each key's random numbers."""
    d = shape - 1 / 3
    out = np.empty(len(shape))
    todo = np.arange(len(shape))
    while len(todo):
        u, v, w = (uniform(key[todo], salt + i) for i in range(3))
        salt += 3
        z = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
        cube = (1 + z / np.sqrt(9 * d[todo])) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            ok = (cube > 0) & (np.log(w) < 0.5 * z * z + d[todo] * (1 - cube + np.log(np.where(cube > 0, cube, 1))))
        out[todo[ok]] = d[todo[ok]] * cube[ok]
        todo = todo[~ok]
    return out


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.array([math.lgamma(v) for v in x])


def draw_tables(c: np.ndarray, a: np.ndarray, discount: float, key: np.ndarray, salt: int) -> np.ndarray:
    """Tables of c customers of each dish, drawn from their distribution when a new table weighs a.

    That is proportional to a**t times the generalised Stirling number of c and
    t.  Those numbers, over their share for one table and times
    discount**(t - 1) (t - 1)!, are probabilities r_c(t), as their recursion

        r_{n+1}(t) = (discount (t - 1) r_n(t - 1) + (n - discount t) r_n(t)) / (n - discount)

    mixes two of them, and t - 1 has the weights of a Poisson number of mean
    a / discount times r_c(t): one row of the recursion serves all dishes of c
    customers.  Beyond STEPS customers r_c(t) is taken from the last row at
    the mean that the tables beside the first shrink to on the way there, which
    is exact to first order: off by some per cent only beyond 16 * STEPS
    customers with tables for a good part of them.
    """
    out = np.ones(len(c), dtype=np.int64)
    rate = a / discount
    # No more tables than customers, nor than a Poisson number ever gives.
    most = np.minimum(c, np.ceil(rate + 12 * np.sqrt(rate) + 40).astype(np.int64))
    # Where tables press against the customers the recursion is run further.
    limit = np.where(rate > c**discount, 16 * STEPS, STEPS)
    step = np.minimum(c, limit)
    order = np.lexsort((most, step))
    order = order[c[order] > 1]
    if not len(order):
        return out
    far = c > limit
    shrink = np.ones(len(c))
    if far.any():
        size = c[far].astype(np.float64)
        end = limit[far].astype(np.float64)
        shrink[far] = np.exp(_log_gamma(size - 2 * discount) - _log_gamma(size - discount) - _log_gamma(end - 2 * discount) + _log_gamma(end - discount))
    need = np.ceil(most * shrink).astype(np.int64) + 2
    starts = np.flatnonzero(np.concatenate([[True], np.diff(step[order]) > 0]))
    widest = np.maximum.accumulate(np.maximum.reduceat(need[order], starts)[::-1])[::-1]
    log_factorial = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, int(most.max()) + 1)))])
    u = uniform(key, salt)
    beside = np.arange(int(widest.max()) + 1)
    r, n = np.zeros(len(beside), dtype=np.longdouble), 1
    r[0] = 1
    for i, first in enumerate(starts):
        wide = int(widest[i])
        s, row = beside[:wide], r[:wide]
        while n < step[order[first]]:
            if n == STEPS:  # what only extended numbers hold no longer weighs
                row, r = row.astype(np.float64), r.astype(np.float64)
            shifted = np.concatenate([row[:1] * 0, row[:-1]])
            row = (discount * s * shifted + (n - discount * (s + 1)) * row) / (n - discount)
            n += 1
        r[:wide] = row
        last = starts[i + 1] if i + 1 < len(starts) else len(order)
        with np.errstate(divide="ignore"):
            log_r = np.log(row).astype(np.float64)
        log_r = np.maximum(log_r, -1e15)
        at = first
        while at < last:
            ahead = most[order[at:last]]
            take = order[at : at + max(1, int(np.searchsorted(ahead * np.arange(1, len(ahead) + 1), CELLS)))]
            at += len(take)
            t = np.arange(int(most[take].max()))
            own = log_r[None, : len(t)] if not far[take].any() else np.interp(t[None, :] * shrink[take][:, None], s, log_r)
            weight = t[None, :] * np.log(rate[take])[:, None] - log_factorial[t][None, :] + own
            weight[t[None, :] >= most[take][:, None]] = -np.inf
            share = np.cumsum(np.exp(weight - weight.max(axis=1, keepdims=True)), axis=1)
            out[take] = 1 + (share < u[take][:, None] * share[:, -1:]).sum(axis=1)
    return out


def seat(context: np.ndarray, count: np.ndarray, p: np.ndarray, single: np.ndarray, word: np.ndarray, name: np.ndarray, sweeps: int, keep: int, seed: int, total: np.ndarray | None = None):
    """The last `keep` samples of (tables of live dishes, tables of contexts).

    context, count, p, word: of each live dish its restaurant, customers,
    probability at the root and id; single, name: of each restaurant its
    dishes of one customer and its id; total: tables of restaurants after
    earlier sweeps, by default one for each dish.
    """
    key = mix(word ^ mix(name[context] + np.uint64(seed)))
    own = mix(name + np.uint64(seed + 1))
    total = single + np.bincount(context, minlength=len(single)) if total is None else total
    out = []
    for s in range(sweeps):
        rate = gamma(STRENGTH / DISCOUNT + total, own, s << 32)
        t = draw_tables(count, DISCOUNT * rate[context] * p, DISCOUNT, key, s + 1)
        total = single + np.bincount(context, weights=t, minlength=len(single)).astype(np.int64)
        if s >= sweeps - keep:
            out.append((t, total))
    return out


def _tokens(words) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes with one end after each document, and how many tokens each document has."""
    n = np.diff(words.first) + 1
    out = np.empty(int(n.sum()), dtype=np.uint64)
    is_end = np.zeros(len(out), dtype=bool)
    is_end[np.cumsum(n) - 1] = True
    out[is_end] = END
    out[~is_end] = words.hashes
    return out, n


_TOKENS = "slice long, blob binary, names binary"


def _sliced(buckets: int):
    """One row a slice: its documents, its tokens as ranks of its words by frequency with the places of the ranks, and its words."""

    def run(batches):
        task = TaskContext.get()
        sid = (task.partitionId() if task else 0) << 32
        for part in gathered(batches, "text", SLICE):
            tokens, n = _tokens(scan(part.column(1)))
            names, at, times = np.unique(tokens, return_inverse=True, return_counts=True)
            del tokens
            by = np.argsort(-times, kind="stable")
            rank = np.empty(len(by), dtype=np.uint32)
            rank[by] = np.arange(len(by), dtype=np.uint32)
            names = np.append(names[by], START)
            # Words stand in order of bucket and hash, the start among them.
            order = np.lexsort((names, _bucket(names, buckets)))
            place = np.empty(len(order), dtype=np.uint32)
            place[order] = np.arange(len(order), dtype=np.uint32)
            ids = part.column(0)
            blob = _pack(np.asarray(ids.fill_null(0)), np.asarray(ids.is_null()), np.asarray(part.column(2).fill_null(False)), n.astype(np.uint32), place, rank[at])
            yield pa.RecordBatch.from_arrays([pa.array([sid]), pa.array([blob], pa.binary()), pa.array([_pack(names[order])], pa.binary())], names=["slice", "blob", "names"])
            sid += 1

    return run


def _bucket(names: np.ndarray, buckets: int) -> np.ndarray:
    return ((names >> np.uint64(24)) % np.uint64(buckets)).astype(np.int64)


class Slice:
    """A slice's tokens as places among its words, and its pairs (context, word) with their counts."""

    def __init__(self, blob: bytes):
        self.ids, self.missing, self.train, n, place, rank = _unpack(blob)
        self.n, self.words = n.astype(np.int64), len(place)
        place = place.astype(np.int64)
        self.word = place[rank]
        self.first = np.cumsum(self.n) - self.n
        before = np.empty(len(rank), dtype=np.int64)
        before[1:] = self.word[:-1]
        before[self.first] = place[-1]
        pairs, self.pair_of = np.unique(before * self.words + self.word, return_inverse=True)
        self.context, self.after = pairs // self.words, pairs % self.words

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """Training counts of words and of pairs."""
        learnt = np.repeat(self.train, self.n)
        return np.bincount(self.word, weights=learnt, minlength=self.words), np.bincount(self.pair_of, weights=learnt, minlength=len(self.context))


def _questions(buckets: int):
    """What a slice asks each bucket: its words and their counts, and the words after each with theirs."""

    def run(batches):
        for batch in batches:
            for sid, blob, names in zip(batch.column("slice").to_pylist(), batch.column("blob"), batch.column("names")):
                s, names = Slice(blob.as_py()), _unpack(names.as_py())[0]
                seen, count = (x.astype(np.uint32) for x in s.counts())
                to = _bucket(names, buckets)
                have = np.unique(to)
                w = np.append(np.searchsorted(to, have), len(to))
                p = np.searchsorted(s.context, w)
                rows = []
                for i, b in enumerate(have.tolist()):
                    words, pairs = slice(w[i], w[i + 1]), slice(p[i], p[i + 1])
                    each = np.bincount(s.context[pairs] - w[i], minlength=w[i + 1] - w[i]).astype(np.uint32)
                    after, at = np.unique(names[s.after[pairs]] >> np.uint64(24), return_inverse=True)
                    rows.append(_row(TOKENS, b, _pack(_steps(names[words]), seen[words], each, _steps(after), at.astype(np.uint32), count[pairs]), sid))
                yield _rows(rows)

    return run


def _combine(t: pa.Table) -> pa.Table:
    """A bucket's restaurants from all slices' counts, and what each slice may know at once."""
    bucket, slices = t.column("bucket")[0].as_py(), t.column("slice").to_pylist()
    asked = []
    for b in t.column("blob"):
        words, seen, each, after, at, count = _unpack(b.as_py())
        asked.append((np.cumsum(words), seen, each, np.cumsum(after)[at], count))
    names, back = np.unique(np.concatenate([a[0] for a in asked]), return_inverse=True)
    seen = np.bincount(back, weights=np.concatenate([a[1] for a in asked]), minlength=len(names)).astype(np.int64)
    context = np.repeat(back, np.concatenate([a[2] for a in asked]).astype(np.int64)).astype(np.uint64)
    pairs, pair_of = np.unique(context << np.uint64(40) | np.concatenate([a[3] for a in asked]), return_inverse=True)
    del context
    count = np.bincount(pair_of, weights=np.concatenate([a[4] for a in asked]), minlength=len(pairs)).astype(np.int64)
    of, word = (pairs >> np.uint64(40)).astype(np.int64), pairs & np.uint64((1 << 40) - 1)
    live, some = count > 1, count > 0
    total = np.bincount(of, weights=count, minlength=len(names)).astype(np.int64)
    single = np.bincount(of[count == 1], minlength=len(names))
    ids, at = np.unique(word[some], return_inverse=True)
    rows = [
        _row(NAMES, bucket, _pack(names)),
        _row(LIVE, bucket, _pack(_steps(of[live]), word[live], count[live].astype(np.uint32), single.astype(np.uint32))),
        _row(WORDS, bucket, _pack(_steps(ids), np.bincount(at, weights=~live[some], minlength=len(ids)).astype(np.uint32), np.bincount(at, weights=live[some], minlength=len(ids)).astype(np.uint32))),
        _row(SUMS, bucket, None, x=[float(seen.sum()), float((seen > 0).sum()), float(some.sum())]),
    ]
    live_at = np.cumsum(live) - 1
    w = p = 0
    for sid, a in zip(slices, asked):
        ws, ps = back[w : w + len(a[0])], pair_of[p : p + len(a[3])]
        w, p = w + len(a[0]), p + len(a[3])
        rows.append(_row(COUNTS, bucket, _pack(seen[ws].astype(np.uint32), total[ws].astype(np.uint32), count[ps].astype(np.uint32)), sid))
        rows.append(_row(PLACES, bucket, _pack(_steps(ws), _steps(live_at[ps[live[ps]]])), sid))
    return pa.Table.from_batches([_rows(rows)])


def _dealt_words(buckets: int, shards: int):
    """A bucket's words to the shards of the root that hold them."""

    def run(batches):
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob")):
                ids, single, live = _unpack(blob.as_py())
                ids = np.cumsum(ids)
                yield _rows([_row(WORDS, k, _pack(_steps(ids[at]), single[at], live[at]), bucket) for k, at in _by_shard(ids, buckets, shards)])

    return run


def _by_shard(ids: np.ndarray, buckets: int, shards: int):
    """(shard, places) of ascending ids; a shard holds whole buckets of words."""
    to = (ids % np.uint64(buckets) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(to, kind="stable")
    have = np.unique(to)
    for k, at in zip(have.tolist(), np.split(order, np.searchsorted(to[order], have[1:]))):
        yield k, at


def _root_weight(tables: float, v: float, seed: int) -> float:
    """What a new table weighs at the root for any word, by a rate drawn given the root's tables."""
    rate = gamma(np.array([ROOT_STRENGTH / ROOT_DISCOUNT + tables]), mix(np.array([seed], dtype=np.uint64)), 1)[0]
    return float(ROOT_DISCOUNT * rate / (v + 1))


def _root_tables(ids: np.ndarray, c: np.ndarray, weights: list[float], seed: int) -> np.ndarray:
    """Tables of the root's dishes with c (words x samples) customers."""
    one = lambda k, w: draw_tables(c[:, k], np.full(len(c), w), ROOT_DISCOUNT, mix(ids + np.uint64(seed + k)), 1)
    return np.stack([np.minimum(one(k, w), c[:, k]) for k, w in enumerate(weights)], axis=1)


def _new_table(tables: float, v: float) -> float:
    return (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (v + 1)


def _first_shard(v: float, pairs: float, weight: float, seed: int):
    """The root before any seating, every pair with one table: its words, and probabilities for the buckets."""

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("bucket")[0].as_py()
        asked = [(b, np.cumsum(x[0]), x[1], x[2]) for b, x in _of(t, WORDS)]
        ids, back = np.unique(np.concatenate([a[1] for a in asked]), return_inverse=True)
        total = lambda k: np.bincount(back, weights=np.concatenate([a[k] for a in asked]), minlength=len(ids)).astype(np.int64)
        single = total(2)
        c = single + total(3)
        tables = _root_tables(ids, c[:, None], [weight], seed)[:, 0]
        p = (c - ROOT_DISCOUNT * tables + _new_table(v, v)) / (ROOT_STRENGTH + pairs)
        rows = [_row(SHARD, shard, _pack(_steps(ids), single.astype(np.uint32))), _row(SUMS, shard, None, x=[float(single.sum()), float(tables.sum())])]
        at = 0
        for b, own, _, live in asked:
            mine = back[at : at + len(own)][live > 0]
            at += len(own)
            rows.append(_row(ROOTS, b, _pack(_steps(ids[mine]), p[mine]), shard))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _restaurants(buckets: int, shards: int, sweeps: int, keep: int, seed: int, last: bool):
    """Seats a bucket's live dishes, given its words' probabilities: the tables of its words for the root and, at last, what its slices asked."""

    def run(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        place = next(_of(t, LIVE), None)
        if place is None:
            return pa.Table.from_batches([_rows([])])
        of, word, count, single = place[1]
        of = np.cumsum(of)
        given = [(np.cumsum(x[0]), x[1]) for _, x in _of(t, ROOTS)]
        p = np.zeros(0)
        if len(word):
            ids, p = (np.concatenate(x) for x in zip(*given))
            by = np.argsort(ids)
            p = p[by][np.searchsorted(ids[by], word)]
        names = next(_of(t, NAMES))[1][0] >> np.uint64(24)
        before = next(_of(t, STATE), None)
        samples = seat(of, count.astype(np.int64), p, single.astype(np.int64), word, names, sweeps, keep, seed, before and before[1][0].astype(np.int64))
        ids, at = np.unique(word, return_inverse=True)
        tables = [np.bincount(at, weights=x, minlength=len(ids)).astype(np.uint32) for x, _ in samples]
        rows = [_row(UP, k, _pack(_steps(ids[i]), *_around([x[i] for x in tables])), bucket) for k, i in _by_shard(ids, buckets, shards)] if len(ids) else []
        rows.append(_row(SUMS, bucket, None, x=[float(x.sum()) for x in tables]))
        if not last:
            rows.append(_row(STATE, bucket, _pack(samples[-1][1].astype(np.uint32))))
        else:
            for sid, (ws, ls) in _of(t, PLACES):
                ws, ls = np.cumsum(ws), np.cumsum(ls)
                rows.append(_row(TABLES, bucket, _pack(*_around([x[ls] for x, _ in samples]), *_around([y[ws] for _, y in samples])), sid))
        return pa.Table.from_batches([_rows(rows)])

    return run


def _shard(buckets: int, weights: list[float], v: float, tables: float, customers: float, seed: int, last: bool):
    """A shard of the root with the tables that the buckets sent: probabilities for them or, at last, the words' customers and tables for those who ask by word."""

    def run(t: pa.Table) -> pa.Table:
        shard = t.column("bucket")[0].as_py()
        ids, single = next(_of(t, SHARD))[1]
        ids = np.cumsum(ids)
        c = np.repeat(single.astype(np.int64)[:, None], len(weights), axis=1)
        asked = [(b, np.searchsorted(ids, np.cumsum(x[0])), x[1:]) for b, x in _of(t, UP)]
        for _, at, up in asked:
            c[at] += np.stack(_samples(up), axis=1)  # a bucket names a word once
        own = _root_tables(ids, c, weights, seed)
        rows = [_row(SUMS, shard, None, x=[float(x) for x in (*c.sum(axis=0), *own.sum(axis=0))])]
        if last:
            for b, at in _by_shard(ids, 1 << 62, buckets):
                rows.append(_row(ROOTS, b, _pack(_steps(ids[at]), *_around(c[at].T), *_around(own[at].T))))
        else:
            p = (c[:, 0] - ROOT_DISCOUNT * own[:, 0] + _new_table(tables, v)) / (ROOT_STRENGTH + customers)
            rows += [_row(ROOTS, b, _pack(_steps(ids[at]), p[at]), shard) for b, at, _ in asked]
        return pa.Table.from_batches([_rows(rows)])

    return run


def _known_words(t: pa.Table) -> pa.Table:
    """What the slices of a bucket asked of its words: customers and tables at the root in each sample."""
    bucket = t.column("bucket")[0].as_py()
    place = next(_of(t, NAMES), None)
    if place is None:
        return pa.Table.from_batches([_rows([])])
    names = place[1][0] >> np.uint64(24)
    out = np.zeros((len(names), 2 * KEPT), dtype=np.uint32)  # folded differences pass through as they are
    for _, (ids, *value) in _of(t, ROOTS):
        ids = np.cumsum(ids)
        at = np.minimum(np.searchsorted(ids, names), len(ids) - 1)
        hit = ids[at] == names
        out[hit] = np.stack(value, axis=1)[at[hit]]
    rows = []
    for sid, (ws, _) in _of(t, PLACES):
        ws = np.cumsum(ws)
        rows.append(_row(ROOTS, bucket, _pack(*[np.ascontiguousarray(out[ws, j]) for j in range(2 * KEPT)]), sid))
    return pa.Table.from_batches([_rows(rows)])


def _scored(n_train: int, v: float, totals: list[tuple[float, float]]):
    def run(t: pa.Table) -> pa.Table:
        kinds, of = t.column("kind").to_pylist(), t.column("bucket").to_pylist()
        held = {k: {} for k in (COUNTS, TABLES, ROOTS)}
        s = None
        for kind, b, blob in zip(kinds, of, t.column("blob")):
            if kind == TOKENS:
                s = Slice(blob.as_py())
                continue
            got = _unpack(blob.as_py())
            held[kind][b] = got if kind == COUNTS else _samples(got[:KEPT]) + _samples(got[KEPT:])
        order = sorted(held[COUNTS])
        join = lambda kind, k: np.concatenate([held[kind][b][k] for b in order]).astype(np.float64)
        seen, total, count = (join(COUNTS, k) for k in range(3))
        own, back = count[:] / (STRENGTH + total[s.context]), 1 / (STRENGTH + total[s.context])
        p = np.zeros(len(count))
        live = count > 1
        for k, (customers, tables) in enumerate(totals):
            t_pair = (count > 0).astype(np.float64)
            t_pair[live] = join(TABLES, k)
            t_context = join(TABLES, KEPT + k)
            base = (ROOT_STRENGTH + ROOT_DISCOUNT * tables) / (v + 1)
            root = (join(ROOTS, k) - ROOT_DISCOUNT * join(ROOTS, KEPT + k) + base) / (ROOT_STRENGTH + customers)
            p += own - DISCOUNT * t_pair * back + (STRENGTH + DISCOUNT * t_context[s.context]) * back * root[s.after]
        log = np.log10(p / len(totals))[s.pair_of]
        c = seen[s.word]
        add = lambda x: np.add.reduceat(x, s.first)
        return pa.table(
            {
                "id": pa.array(s.ids, mask=s.missing), "n_tokens": pa.array(s.n), "n_known": pa.array(add((c > 0).astype(np.int64))),
                "train_tokens": pa.array(np.full(len(s.n), n_train, np.int64)), "base_score": pa.array(add(np.log10((c + 1) / (n_train + v + 1)))), "score": pa.array(add(log)),
            }
        )

    return run


def score_documents(docs: DataFrame, train, key: str = "doc_id", text: str = "text", seed: int = 11, bucket_bytes: int = BUCKET) -> DataFrame:
    """(id, n_tokens, n_known, train_tokens, base_score, score) of every row.

    train: the condition (null: false) under which a row's text is learnt
    from.  A text's tokens are its lower-cased words and one end; null and
    empty texts have the end alone.  base_score is the sum of the log10 of
    add-one unigram probabilities, score that of the model's probabilities,
    each the mean over the kept samples.  Words not in training share the
    unknown word's probability; contexts not in training fall back to the
    root.  Without training rows every token has the base probability.
    Repeated rows are rows of their own; an empty table gives no rows; other
    columns are left out.  Restaurants and random numbers go by the upper 40
    bits of a word's hash: words that share them share a parent dish, counts
    never.  The number of buckets only deals the work and changes no score.
    """
    d = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    size = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(4, size // bucket_bytes)
    tokens = written(d.mapInArrow(_sliced(buckets), _TOKENS), "tokens")
    held = written(tokens.mapInArrow(_questions(buckets), _ROW).groupBy("bucket").applyInArrow(_combine, _ROW), "counts")
    only = lambda df, *kinds: df.where(F.col("kind").isin(*kinds))
    sums = lambda df, n: [float(x or 0) for x in only(df, SUMS).agg(*[F.sum(F.col("x")[i]) for i in range(n)]).first()]
    n_train, v, pairs = sums(held, 3)
    if not n_train:
        return tokens.select("blob").mapInArrow(_untrained, _SCORES)
    shards = max(1, min(buckets, round(v / SHARD_WORDS)))
    words = only(held, WORDS).mapInArrow(_dealt_words(buckets, shards), _ROW)
    root = written(words.groupBy("bucket").applyInArrow(_first_shard(v, pairs, _root_weight(v, v, seed), seed), _ROW), "root")
    single, tables = sums(root, 2)
    told, up = root, None
    for i, sweeps in enumerate((*ROUNDS, BURN + KEPT)):
        last = i == len(ROUNDS)
        given = only(held, LIVE, NAMES, *[PLACES] * last).unionByName(only(told, ROOTS))
        if up is not None:
            given = given.unionByName(only(up, STATE))
        seated = _restaurants(buckets, shards, sweeps, KEPT if last else 1, seed + 7 * i, last)
        used, up = [told, up], written(given.groupBy("bucket").applyInArrow(seated, _ROW), "seats")
        for x in used:
            if x is not None and x is not root:
                discard(x)
        weights = [_root_weight(tables, v, seed + 101 * i + k) for k in range(KEPT if last else 1)]
        customers = single + sums(up, 1)[0]
        meet = _shard(buckets, weights, v, tables, customers, seed + 13 * (i + 1), last)
        told = written(only(root, SHARD).unionByName(only(up, UP)).groupBy("bucket").applyInArrow(meet, _ROW), "root")
        tables = sums(told, 2)[1]
    found = sums(told, 2 * KEPT)
    known = only(held, NAMES, PLACES).unionByName(only(told, ROOTS)).groupBy("bucket").applyInArrow(_known_words, _ROW)
    both = tokens.select(F.lit(TOKENS).alias("kind"), "slice", F.lit(-1).alias("bucket"), "blob")
    for answers in (only(held, COUNTS), only(up, TABLES), known):
        both = both.unionByName(answers.select("kind", "slice", "bucket", "blob"))
    return both.groupBy("slice").applyInArrow(_scored(int(n_train), v, list(zip(found[:KEPT], found[KEPT:]))), _SCORES)


_SCORES = "id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _untrained(batches):
    for batch in batches:
        for blob in batch.column(0):
            ids, missing, _, n, _, _ = _unpack(blob.as_py())
            none, zero = pa.array(np.zeros(len(n), np.int64)), pa.array(np.zeros(len(n)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, mask=missing), pa.array(n.astype(np.int64)), none, none, zero, zero], names=["id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
