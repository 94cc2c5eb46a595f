"""Embedding near-dedup with an inverted multi-index.

Vectors are normalised and halved; each half has a codebook of its own
(k-means), and the product of the two is a grid of cells.  A vector asks cells
in the order of its squared distance to them, which the multi-sequence
traversal gives from the two sorted lists of distances, until the distance
exceeds that of the nearest cell by more than `reach`.  The reach is set so
that pairs at the similarity threshold are found with the target recall
whatever sets them apart: it is the largest of those that partners in random
directions, along one dimension, within one half, along the data's own spread
and towards other vectors need, and that true neighbours within the sample
need.  The recall is then measured on vectors that were not fitted on, and the
reach grows until each kind reaches the target; the least is in the result.
What is found is verified in double precision.

Rows of the grid (cells with one first code) are the units of the cluster: a
row is cut into blocks of a bounded number of vectors, and a vector visits a
row once, with the list of cells that it asks there.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, written
from .topk import usable

#: Vectors that codebooks and reach are fitted on, at most, and partners of each kind made from them.
SAMPLE, PARTNERS = 16_384, 2048
#: Codewords a half at most; further vectors fill the cells, which are compared whole.
CODES = SAMPLE // 4
#: Vectors of a block, on either side of a comparison.
BLOCK = 8192
#: Share of threshold pairs whose cells one of the two visits.
RECALL = 0.98


def kmeans(x: np.ndarray, k: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=len(x) < k)]
    for _ in range(rounds):
        near = squared(x, c).argmin(axis=1)
        n = np.bincount(near, minlength=k)
        sums = np.stack([np.bincount(near, weights=x[:, d], minlength=k) for d in range(x.shape[1])], axis=1)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(axis=1)[:, None] - 2 * x @ c.T + (c * c).sum(axis=1)[None], 0)


def multi_sequence(a: np.ndarray, b: np.ndarray, limit: float):
    """Cells (i, j) in the order of a[i] + b[j], up to the limit."""
    ia, ib = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    heap, seen = [(a[ia[0]] + b[ib[0]], 0, 0)], {(0, 0)}
    while heap:
        s, p, q = heapq.heappop(heap)
        if s > limit:
            return
        yield int(ia[p]), int(ib[q])
        for nxt in ((p + 1, q), (p, q + 1)):
            if nxt[0] < len(ia) and nxt[1] < len(ib) and nxt not in seen:
                seen.add(nxt)
                heapq.heappush(heap, (a[ia[nxt[0]]] + b[ib[nxt[1]]], *nxt))


def partners(x: np.ndarray, cosine: float, half: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    """For each unit vector a partner at exactly the cosine, by what sets them apart; rows that have no such partner are NaN."""
    n, width = x.shape
    spread = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][: max(1, width // 8)]
    one = np.zeros_like(x)
    one[np.arange(n), rng.integers(0, width, n)] = rng.choice([-1.0, 1.0], n)
    first, last = rng.standard_normal(x.shape), rng.standard_normal(x.shape)
    first[:, half:], last[:, :half] = 0, 0
    few = np.zeros_like(x)
    few[:, : max(1, half // 4)] = rng.standard_normal((n, max(1, half // 4)))
    kinds = {"random": rng.standard_normal(x.shape), "one dimension": one, "first half": first, "second half": last, "few dimensions": few, "spread": rng.standard_normal((n, len(spread))) @ spread, "other vectors": x[rng.permutation(n)]}
    out = {}
    for kind, to in kinds.items():
        to = to - (to * x).sum(axis=1, keepdims=True) * x
        norm = np.linalg.norm(to, axis=1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            out[kind] = np.where(norm > 1e-9, cosine * x + math.sqrt(1 - cosine**2) * to / norm, np.nan)
    return out


def neighbours(x: np.ndarray, cosine: float, chunk: int = 1024) -> tuple[np.ndarray, np.ndarray]:
    """Pairs i < j of the sample whose cosine is in the range just above the threshold, by brute force; of each i the four least similar."""
    left, right = [], []
    for s in range(0, len(x), chunk):
        c = x[s : s + chunk] @ x.T
        c[(c < cosine) | (np.arange(len(x))[None] <= np.arange(s, s + len(c))[:, None])] = np.inf
        near = np.argpartition(c, min(4, len(x) - 1), axis=1)[:, :4]
        i, k = np.nonzero(np.isfinite(np.take_along_axis(c, near, axis=1)))
        left.append(i + s)
        right.append(near[i, k])
    return np.concatenate(left), np.concatenate(right)


class Grid:
    """Two codebooks, the reach, and the recall measured on vectors apart from those that the reach was fitted on."""

    def __init__(self, sample: np.ndarray, k: int, cosine: float, recall: float, seed: int = 7):
        self.half = max(1, sample.shape[1] // 2)
        self.books = [kmeans(h, k, seed=seed + i) for i, h in enumerate(self.halves(sample))]
        rng = np.random.default_rng(seed)
        order = rng.permutation(len(sample))
        parts = [sample[order[:PARTNERS]], sample[order[PARTNERS : 2 * PARTNERS]]]
        if not len(parts[1]):
            parts[1] = parts[0]
        gaps = [self._gaps(x, cosine, rng) for x in parts]
        i, j = neighbours(sample, cosine)
        for s, held in enumerate(gaps):  # true neighbours, half to fit and half to measure
            own = i % 2 == s
            if own.any():
                held["neighbours"] = self._either(sample[i[own]], sample[j[own]])
        self.reach = max((float(np.quantile(g, recall)) for g in gaps[0].values() if len(g)), default=0.0)
        measure = lambda: min((float((g <= self.reach).mean()) for g in gaps[1].values() if len(g)), default=1.0)
        if measure() < recall:  # what was held back needs more
            self.reach = max(self.reach, *(float(np.quantile(g, recall)) for g in gaps[1].values() if len(g)))
        self.measured = measure()

    def _either(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The lesser gap of the two: a link is found if either visits the other's cell."""
        return np.minimum(self._gap(x, y), self._gap(y, x))

    def _gaps(self, x: np.ndarray, cosine: float, rng: np.random.Generator) -> dict[str, np.ndarray]:
        out = {}
        for kind, y in partners(x, cosine, self.half, rng).items():
            ok = ~np.isnan(y).any(axis=1)
            if ok.any():
                out[kind] = self._either(x[ok], y[ok])
        return out

    def halves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return x[:, : self.half], x[:, self.half :]

    def distances(self, x: np.ndarray) -> list[np.ndarray]:
        return [squared(h, c) for h, c in zip(self.halves(x), self.books)]

    def _gap(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How much farther than its nearest cell x finds the cell of y."""
        a, b = self.distances(x)
        i, j = (d.argmin(axis=1) for d in self.distances(y))
        r = np.arange(len(x))
        return a[r, i] + b[r, j] - a.min(axis=1) - b.min(axis=1)

    def visits(self, a: np.ndarray, b: np.ndarray) -> list[tuple[int, int]]:
        """The cells that a vector with distances a and b asks, nearest first."""
        return list(multi_sequence(a, b, a.min() + b.min() + self.reach))


def _unit(m: np.ndarray) -> np.ndarray:
    top = np.abs(m).max(axis=1, keepdims=True)
    m = m / np.where(top > 0, top, 1)  # no overflow of squares
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def _read(column: pa.Array, width: int) -> np.ndarray:
    """Matrix of the lists as double; shorter ones end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = np.asarray(pa.compute.list_value_length(column)).astype(np.int64)
    flat = np.asarray(column.flatten()).astype(np.float64)
    out = np.zeros((len(n), width))
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def _compare(grid: Grid, cosine: float, d: dict, q: dict, chunk: int = 1024):
    """Of one block of a grid row: (id, links to add) and edges (a, b) that connect what is linked."""
    da, db = grid.distances(d["v"])
    limit = da.min(axis=1) + db.min(axis=1) + grid.reach
    label = d["id"].copy()
    d_add = np.zeros(len(label), dtype=np.int64)
    q_add = np.zeros(len(q["id"]), dtype=np.int64)
    edges = []
    for s in range(0, len(q["id"]), chunk):
        e = slice(s, s + chunk)
        found = (q["v"][e] @ d["v"].T >= cosine) & q["mask"][e][:, d["j"]] & (q["id"][e][:, None] != d["id"][None])
        if not found.any():
            continue
        q_add[e] += found @ d["n"]
        # The other side counts the link itself if it visits the query's cell.
        back = da[:, q["i"][e]] + db[:, q["j"][e]] <= limit[:, None]
        d_add += (found.T & ~back) @ q["n"][e]
        rows, cols = np.flatnonzero(found.any(axis=1)), np.flatnonzero(found.any(axis=0))
        m = found[np.ix_(rows, cols)]
        lq, ld = q["id"][e][rows].copy(), label[cols]
        big = np.iinfo(np.int64).max
        while True:
            new_q = np.minimum(lq, np.where(m, ld[None], big).min(axis=1))
            new_d = np.minimum(ld, np.where(m, new_q[:, None], big).min(axis=0))
            if (new_q == lq).all() and (new_d == ld).all():
                break
            lq, ld = new_q, new_d
        label[cols] = ld
        edges += [np.stack([q["id"][e][rows], lq], axis=1), np.stack([d["id"][cols], ld], axis=1)]
    return np.concatenate([q["id"], d["id"]]), np.concatenate([q_add, d_add]), np.unique(np.concatenate(edges), axis=0) if edges else np.zeros((0, 2), np.int64)


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, key: str = "vec_id", vector: str = "embedding", codes: int | None = None, recall: float = RECALL, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """(id, n_links, component_id, kept, index_recall) for every row: vectors linked by a cosine of `cosine` or more.

    codes: codewords a half; by default they grow as the square root of the
    number of vectors up to CODES, beyond which cells hold more and are
    compared whole as before, in blocks.  Codebooks and reach are fitted on
    `sample` vectors at most; all vectors are indexed and all ask.
    index_recall is the least share of pairs at the threshold that the index
    finds, measured on vectors that the reach was not fitted on (1 without vectors).  Vectors that are null, zero, or hold null or non-finite
    components link with nothing; a shorter vector counts as one that ends in
    zeros.  Equal vectors are compared once and count each other.  Repeated
    ids are rows of their own that share one node, counted once where its rows
    are equal; a null id links with nothing.  An empty table gives no rows; other columns are left out.
    """
    rows = vectors.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v"))
    good = usable(F.col("v")) & F.exists("v", lambda x: x != 0) & F.col("id").isNotNull()
    held = rows.where(good).groupBy("v", "id").agg(F.count("*").alias("c"))
    reps = written(held.groupBy("v").agg(F.min("id").alias("id"), F.count("*").alias("n")), "vectors")
    n, width = reps.agg(F.count("*"), F.max(F.size("v"))).first()
    copies = held.join(reps.select(F.col("v").alias("w"), F.col("id").alias("first"), "n"), F.col("v") == F.col("w")).select("id", "first", "n")
    if n:
        taken = reps.orderBy(F.xxhash64("id"), "id").limit(sample).select("v").toArrow()
        k = codes or max(4, min(CODES, round(math.sqrt(n / 16))))
        grid = Grid(_unit(_read(taken.column(0), width)), min(k, taken.num_rows), cosine, recall)
        links = written(_links(reps, grid, width, cosine, block), "links")
        measured = grid.measured
    else:
        measured = 1.0
        links = reps.sparkSession.createDataFrame([], "id long, add long, a long, b long")
    adds = links.where("id is not null").groupBy(F.col("id").alias("first")).agg(F.sum("add").alias("add"))
    edges = links.where("a is not null").select("a", "b").unionByName(copies.where("id != first").select(F.col("id").alias("a"), F.col("first").alias("b")))
    found = connected_components(edges)
    own = copies.join(adds, "first", "left").groupBy("id").agg(F.sum(F.coalesce("add", F.lit(0)) + F.col("n") - 1).alias("links"))
    out = rows.select("id").join(own, "id", "left").join(found, F.col("id") == F.col("node"), "left")
    out = out.select("id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "id").alias("component_id"))
    return out.withColumn("kept", F.col("id").eqNullSafe(F.col("component_id"))).withColumn("index_recall", F.lit(measured))


def _links(reps: DataFrame, grid: Grid, width: int, cosine: float, block: int) -> DataFrame:
    k = len(grid.books[0])

    def coded(batches):
        for batch in batches:
            if batch.num_rows:
                m = _unit(_read(batch.column(batch.schema.get_field_index("v")), width))
                a, b = grid.distances(m)
                yield batch, m, a, b

    def count(batches):
        d, q = np.zeros(k, np.int64), np.zeros(k, np.int64)
        for _, _, a, b in coded(batches):
            d += np.bincount(a.argmin(axis=1), minlength=k)
            # A row of the grid is visited if its nearest cell is.
            low = b.min(axis=1)[:, None]
            q += (a + low <= a.min(axis=1)[:, None] + low + grid.reach).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k, dtype=np.int32)), pa.array(d), pa.array(q)], names=["i", "d", "q"])

    def code(batches):
        for batch, m, a, b in coded(batches):
            i, j = a.argmin(axis=1), b.argmin(axis=1)
            ids = np.asarray(batch.column(batch.schema.get_field_index("id")))
            n = np.asarray(batch.column(batch.schema.get_field_index("n")))
            for r in range(len(ids)):
                rows: dict[int, np.ndarray] = {}
                for x, y in grid.visits(a[r], b[r]):
                    rows.setdefault(x, np.zeros(k, dtype=bool))[y] = True
                yield r, ids[r], n[r], m[r], int(i[r]), int(j[r]), rows

    # One number a grid row: k rows at most reach the driver.
    sizes = reps.mapInArrow(count, "i int, d long, q long").groupBy("i").agg(F.sum("d"), F.sum("q")).collect()
    parts = {r[0]: (max(1, -(-r[1] // block)), max(1, -(-r[2] // block))) for r in sizes}
    fields = [("row", pa.int32()), ("d", pa.int32()), ("q", pa.int32()), ("side", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("v", pa.binary()), ("mask", pa.binary())]
    schema = pa.schema(fields)

    def deal(batches):
        out = []
        for r, vid, n, v, i, j, rows in code(batches):
            raw, spread = v.tobytes(), (int(vid) * 0x9E3779B1) & 0x7FFFFFFF
            nd, nq = parts[i]
            out += [(i, spread % nd, y, 0, vid, n, i, j, raw, None) for y in range(nq)]
            for x, mask in rows.items():
                nd, nq = parts[x]
                out += [(x, y, spread % nq, 1, vid, n, i, j, raw, np.packbits(mask).tobytes()) for y in range(nd)]
            if len(out) >= 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*out), fields)], schema=schema)

    def search(t: pa.Table) -> pa.Table:
        side = t.column("side").to_numpy()

        def part(s: int) -> dict:
            p = t.filter(pa.array(side == s))
            raw = p.column("v").combine_chunks()
            held = {c: p.column(c).to_numpy() for c in ("id", "n", "i", "j")}
            held["v"] = np.frombuffer(b"".join(raw.to_pylist()), dtype=np.float64).reshape(p.num_rows, -1)
            if s:
                packed = np.frombuffer(b"".join(p.column("mask").to_pylist()), dtype=np.uint8).reshape(p.num_rows, -1)
                held["mask"] = np.unpackbits(packed, axis=1)[:, :k].astype(bool)
            return held

        d, q = part(0), part(1)
        if not len(d["id"]) or not len(q["id"]):
            return pa.table({c: pa.array([], pa.int64()) for c in ("id", "add", "a", "b")})
        ids, add, edges = _compare(grid, cosine, d, q)
        some = add > 0
        gone = np.count_nonzero(some)
        return pa.table(
            {
                "id": pa.concat_arrays([pa.array(ids[some], pa.int64()), pa.nulls(len(edges), pa.int64())]),
                "add": pa.concat_arrays([pa.array(add[some], pa.int64()), pa.nulls(len(edges), pa.int64())]),
                "a": pa.concat_arrays([pa.nulls(gone, pa.int64()), pa.array(edges[:, 0], pa.int64())]),
                "b": pa.concat_arrays([pa.nulls(gone, pa.int64()), pa.array(edges[:, 1], pa.int64())]),
            }
        )

    dealt = reps.mapInArrow(deal, "row int, d int, q int, side int, id long, n long, i int, j int, v binary, mask binary")
    return dealt.groupBy("row", "d", "q").applyInArrow(search, "id long, add long, a long, b long")
