"""Sharding of indivisible groups by Karmarkar-Karp differencing.

A group of equal texts goes to one shard as a whole.  Differencing runs as a
tree: each task takes a bounded chunk of groups, repeatedly combines the two
partial partitions of largest spread in opposite order, and ends with one
partial partition of `shards` sums.  The partial partitions of all chunks are
the items of the next level, until one is left.  Only (size, key) pairs enter
the kernels, and slots are numbered on them; texts move once, to be joined with
their shard and slot, and only if they are asked for.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Fresh, own, small_side, written

#: Partial partitions combined in one task.
CHUNK = 20_000
#: Chunks of small groups at least, and partial partitions that the last step takes.
LEAST_CHUNKS, TOP = 64, 1024
#: A group of more than this share of a shard is large: at most shards x LARGE groups are.
LARGE = 1024
#: Row buckets per shard in which slots are numbered independently.
SLOT_BUCKETS = 256


def difference(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Karmarkar-Karp over partial partitions.

    parts: n x k sums, any order.  Returns (bins, sums): bins[i, j] is the bin
    of the result that takes part i's j-th bin; sums are the k totals.
    """
    n, k = parts.shape
    heap, nodes = [], []
    for i in range(n):
        order = np.argsort(-parts[i], kind="stable").tolist()
        row = [int(parts[i, j]) for j in order]
        nodes.append((i, None, order, None))
        heap.append((row[-1] - row[0], i, row))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, x, big = heapq.heappop(heap)
        _, y, low = heapq.heappop(heap)
        # The largest sums of one meet the smallest of the other.
        met = sorted(((big[j] + low[k - 1 - j], j) for j in range(k)), key=lambda t: (-t[0], t[1]))
        nodes.append((x, y, [j for _, j in met], None))
        row = [s for s, _ in met]
        heapq.heappush(heap, (row[-1] - row[0], len(nodes) - 1, row))
    bins = np.zeros((n, k), dtype=np.int32)
    todo = [(heap[0][1], list(range(k)))]
    while todo:
        at, place = todo.pop()  # place[j]: bin of the result for this node's j-th largest sum
        x, y, order, _ = nodes[at]
        if y is None:
            for j, b in zip(order, place):
                bins[x, j] = b
            continue
        left, right = [0] * k, [0] * k
        for j, b in zip(order, place):
            left[j], right[k - 1 - j] = b, b
        todo += [(x, left), (y, right)]
    return bins, np.array(heap[0][2], dtype=np.int64)


def _combine(k: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("item", kind="stable")
        bins, sums = difference(np.stack(pdf["sums"].to_numpy()).astype(np.int64).reshape(len(pdf), k))
        return pd.DataFrame({"chunk": [pdf["chunk"].iloc[0]], "items": [pdf["item"].tolist()], "bins": [bins.reshape(-1).tolist()], "sums": [sums.tolist()]})

    return run


def _last(k: int):
    def run(t: pa.Table) -> pa.Table:
        t = t.select(["chunk", "bin", "item", "bytes"]).sort_by([("chunk", "ascending"), ("bin", "ascending"), ("item", "ascending")])
        parts = np.zeros((t.num_rows, k), dtype=np.int64)
        parts[:, 0] = t.column("bytes").to_numpy()
        return t.drop_columns(["bytes"]).append_column("shard", pa.array(difference(parts)[0][:, 0], pa.int32()))

    return run


def shards_of_groups(groups: DataFrame, shards: int, chunk: int = CHUNK) -> DataFrame:
    """(_g, shard) for groups(_g binary, bytes long): differencing level by level."""
    n, total = groups.agg(F.count("*"), F.sum("bytes")).first()
    items = groups.select("_g", F.xxhash64("_g").alias("item"), "bytes", (F.lit(n <= chunk) | (F.col("bytes") * F.lit(shards * LARGE) > F.lit(total or 0))).alias("_large"))
    none = F.lit(None).cast("long")
    last = items.where("_large").select(none.alias("chunk"), none.cast("int").alias("bin"), "item", "bytes")
    levels = []
    if n > chunk:
        width = max(LEAST_CHUNKS, -(-n // chunk))
        level = items.where("not _large").select("item", F.array(F.col("bytes"), *[F.lit(0).cast("long")] * (shards - 1)).alias("sums"), F.pmod(F.xxhash64("item"), F.lit(width)).alias("chunk"))
        while True:
            levels.append(written(level.groupBy("chunk").applyInPandas(_combine(shards), "chunk long, items array<long>, bins array<int>, sums array<long>"), "shards"))
            if width <= TOP:
                break
            width = -(-width // TOP)
            level = levels[-1].select(F.col("chunk").alias("item"), "sums", F.pmod("chunk", F.lit(width)).alias("chunk"))
        last = last.unionByName(levels[-1].select("chunk", F.posexplode("sums").alias("bin", "bytes")).withColumn("item", none))
    # One task: at most TOP x shards sums and shards x LARGE groups, or `chunk` groups.
    done = written(last.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_last(shards), "chunk long, bin int, item long, shard int"), "last")
    out = done.where("chunk is null").select("item", "shard")
    place = done.where("chunk is not null").groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("bin", "shard"))).alias("t")).select("chunk", F.col("t.shard").alias("to"))
    for level in reversed(levels):
        # From the top down: where each bin of an item ends.
        of = F.expr(f"transform(items, (x, i) -> struct(x as item, slice(bins, i * {shards} + 1, {shards}) as b))")
        into = level.join(place, "chunk").select(F.explode(of).alias("z"), "to")
        place = into.select(F.col("z.item").alias("chunk"), F.expr("transform(z.b, x -> to[x])").alias("to"))
    if levels:
        out = out.unionByName(place.select(F.col("chunk").alias("item"), F.col("to")[0].cast("int").alias("shard")))
    return items.select("_g", "item").join(out, "item").select("_g", "shard")


def shard_documents(docs: DataFrame, shards: int = 8, key: str = "doc_id", text: str = "text", chunk: int = CHUNK) -> DataFrame:
    """docs with `size`, `shard` and `slot`: shards of near-equal bytes that keep equal texts together.

    A row weighs its text's UTF-8 bytes plus 1.  Null texts form one group of
    weight 1 a row, empty texts another; a null key is a key like any other;
    repeated rows get slots of their own; an empty table gives no rows.  Slots
    count from 0 without gaps in each shard, in an order that depends on the
    rows' keys and texts alone.  Columns named size, shard or slot of the input
    are replaced; all others, whatever their names, stay as they are.
    """
    kept_columns = [c for c in docs.columns if c not in ("shard", "slot", "size")]
    f = Fresh(docs)
    base = docs.select(
        *own(kept_columns),
        F.coalesce(F.unhex(F.md5(F.encode(text, "utf-8"))), F.encode(F.lit("null"), "utf-8")).alias(f.g),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
    )
    rows = base.groupBy(F.col(key).alias("k"), F.col(f.g).alias("_g")).agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    rows = written(rows, "rows")
    groups = written(rows.groupBy("_g").agg(F.sum("bytes").cast("long").alias("bytes")), "groups")
    placed = rows.join(shards_of_groups(groups, shards, chunk), "_g").withColumn("b", F.pmod(F.xxhash64("k", "_g"), F.lit(SLOT_BUCKETS)))
    counts = placed.groupBy("shard", "b").agg(F.sum("n").alias("c"))
    before = Window.partitionBy("shard").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    starts = counts.select("shard", "b", (F.sum("c").over(before) - F.col("c")).alias("start"))  # at most shards x SLOT_BUCKETS rows
    within = Window.partitionBy("shard", "b").orderBy("k", "_g").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    slots = placed.withColumn("at", F.sum("n").over(within) - F.col("n")).join(F.broadcast(starts), ["shard", "b"])
    slots = written(slots.select(F.col("k").alias(f.k), F.col("_g").alias(f.h), "shard", (F.col("start") + F.col("at")).alias(f.first), F.col("n").alias(f.n)), "slots")
    n, n_again = slots.agg(F.count("*"), F.count_if(F.col(f.n) > 1)).first()
    out = base.join(small_side(slots, n), F.col(key).eqNullSafe(F.col(f.k)) & (F.col(f.g) == F.col(f.h)))
    done = lambda df, slot: df.select(*own(kept_columns), "size", "shard", slot.alias("slot"))
    if not n_again:
        return done(out, F.col(f.first))
    # Rows that repeat key and text, and they alone, are numbered among themselves.
    nth = F.row_number().over(Window.partitionBy(f.k, f.h).orderBy(f.first))
    once = done(out.where(F.col(f.n) == 1), F.col(f.first))
    return once.unionByName(done(out.where(F.col(f.n) > 1).withColumn(f.nth, nth), F.col(f.first) + F.col(f.nth) - 1))


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Writes shard_documents(docs, **options) as Parquet folders shard=0, shard=1, ...; an empty table gives a folder without rows."""
    shard_documents(docs, **options).write.partitionBy("shard").parquet(path)
