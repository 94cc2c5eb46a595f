"""Exact top-k by inner product: columnar branch and bound.

Rows stand in blocks, stored dimension by dimension.  A query adds up its
product with a block a few dimensions at a time; after each step a candidate's
best possible score is its sum so far plus the product of the norms of what is
left of query and candidate.  Those that cannot reach the query's k-th best
score are dropped and the survivors compacted.  The final scores are integers.

Query blocks meet row blocks as pairs of block numbers, so a task holds one
block of each, whatever the tables' sizes.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a row block, queries of a query block, dimensions added at a time.
ROWS, QUERIES, STEP = 8192, 2048, 8
#: Products of numbers below this add up exactly in 64 bits.
SAFE = 1 << 26


def usable(vector: Column) -> Column:
    """Not null, and without null or non-finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def fixed_point(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component x, taken as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def _matrix(vectors, width: int) -> np.ndarray:
    """Integer matrix of the lists; shorter ones end in zeros."""
    out = np.zeros((len(vectors), width), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def best_of_block(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, row_ids: np.ndarray, k: int, step: int = STEP):
    """(query index, row index, score) of each query's k best rows, ties to the smaller row id, without the query's own id."""
    order = np.lexsort((row_ids, -(rows.astype(np.float64) ** 2).sum(axis=1)))  # long vectors first: they set high bars
    rows, row_ids = rows[order], row_ids[order]
    columns = np.ascontiguousarray(rows.T)
    width = len(columns)
    cuts = list(range(0, width, step)) or [0]
    tail = lambda m: np.sqrt(np.cumsum((m.astype(np.float64) ** 2)[:, ::-1], axis=1)[:, ::-1])  # noqa: E731  norms of what is left from a dimension on
    row_tail, query_tail = (tail(rows), tail(queries)) if width else (None, None)
    head = min(len(rows), max(16 * k, 64))
    exact = np.abs(rows).max(initial=0) < SAFE and np.abs(queries).max(initial=0) < SAFE
    kind = np.int64 if exact else object
    first = queries.astype(kind) @ columns[:, :head].astype(kind) if width else np.zeros((len(queries), head), np.int64)
    out = []
    for i, q in enumerate(queries):
        own = row_ids == query_ids[i]
        seen = np.sort(first[i][~own[:head]])
        bar = seen[-k] if len(seen) >= k else None
        alive = np.flatnonzero(~own)
        sums = np.zeros(len(alive), dtype=kind)
        for a in cuts:
            b = min(a + step, width)
            for d in range(a, b):
                if q[d]:
                    sums = sums + columns[d, alive].astype(kind, copy=False) * (q[d] if exact else int(q[d]))
            if b < width and bar is not None and len(alive):
                left = row_tail[alive, b] * query_tail[i, b]
                keep = sums.astype(np.float64) + left * (1 + 1e-9) + 1e-6 * (1 + abs(float(bar))) >= float(bar)
                alive, sums = alive[keep], sums[keep]
        top = sorted(range(len(alive)), key=lambda j: (-int(sums[j]), int(row_ids[alive[j]])))[:k] if not exact else np.lexsort((row_ids[alive], -sums))[:k]
        out += [(i, order[alive[j]], sums[j]) for j in top]
    return out


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: float = 256.0, rows: int = ROWS, query_rows: int = QUERIES) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's k best other rows by inner product of the fixed-point vectors.

    queries: the condition that makes a row a query.  A query with fewer than k
    candidates gets all.  Ties go to the smaller id.  Vectors that are null or
    hold null or non-finite components, and rows without an id, take no part;
    a shorter vector counts as one that ends in zeros.  A repeated id is a
    candidate as often as it occurs, never of itself; as a query it is asked
    once (its least vector).  Empty tables give no rows; other columns are left
    out.  Scores beyond 64 bits raise an error.
    """
    good = vectors.where(usable(F.col(vector)) & F.col(key).isNotNull())
    data = good.select(F.col(key).cast("long").alias("id"), fixed_point(F.col(vector), scale).alias("v"), queries.alias("q"))
    n, n_queries = data.agg(F.count("*"), F.count_if("q")).first()
    row_blocks, query_blocks = max(1, math.ceil(n / rows)), max(1, math.ceil(n_queries / query_rows))
    block = lambda count, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(count)).cast("int")
    asked = data.where("q").groupBy("id").agg(F.min("v").alias("v"))
    left = data.select("id", "v", block(row_blocks, 1).alias("rb"), F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1))).alias("qb"), F.lit(False).alias("q"))
    right = asked.select("id", "v", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))).alias("rb"), block(query_blocks, 2).alias("qb"), F.lit(True).alias("q"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        ask = pdf["q"].to_numpy(dtype=bool)
        width = int(pdf["v"].map(len).max())
        m = _matrix(pdf["v"].tolist(), width)
        ids = pdf["id"].to_numpy(dtype=np.int64)
        if not ask.any() or ask.all():
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []}).astype("int64")
        found = best_of_block(m[ask], ids[ask], m[~ask], ids[~ask], k)
        qi, ri, s = zip(*found) if found else ((), (), ())
        return pd.DataFrame({"query_id": ids[ask][list(qi)], "vec_id": ids[~ask][list(ri)], "score": np.array(s, dtype=np.int64)})

    local = left.unionByName(right).groupBy("rb", "qb").applyInPandas(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
