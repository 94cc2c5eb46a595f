"""Helpers shared by the corpus operators: batches of text, scratch storage, components."""

from __future__ import annotations

import atexit
import ctypes
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import kept, shared_dir

try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError, TypeError):  # another C library
    _TRIM = None

#: Words are maximal runs of characters other than the blank and 0x09-0x0D.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session has ended and its folder with it
        pass


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the program ends."""
    path = f"{shared_dir(spark)}/lociforge/{what}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def discard(df: DataFrame) -> None:
    """Removes what `written` wrote, once nothing reads it any more: all that came of it must be written itself."""
    _remove(df.sparkSession, df._written)


cut = kept


class Fresh:
    """Names of internal columns that no column of a table has, by attribute: fresh.rank is '_rank', or '__rank' where that is taken, and so on."""

    def __init__(self, *tables: DataFrame):
        self._taken = {c.lower() for t in tables for c in t.columns}

    def __getattr__(self, name: str) -> str:
        if name.startswith("_"):
            raise AttributeError(name)
        out = "_" + name
        while out.lower() in self._taken:
            out = "_" + out
        return out


def own(columns) -> list:
    """The columns by name, whatever characters their names hold."""
    return [F.col("`" + c.replace("`", "``") + "`") for c in columns]


def give_back() -> None:
    """Returns freed memory to the system: Python workers are reused and else keep their peak."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def text_slices(batches, column: str | int, most: int = 4 << 20):
    """Record batches cut so that their text column holds about `most` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(column)
        n = np.asarray(pa.compute.fill_null(pa.compute.binary_length(texts), 0)).astype(np.int64)
        at = np.cumsum(n) // most
        edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)
            give_back()


def gathered(batches, column: str | int, most: int):
    """Record batches whose text column holds about `most` bytes (one row at least): small ones are joined, large ones cut."""
    held, size = [], 0
    for part in text_slices(batches, column, most):
        held.append(part)
        size += part.column(column).nbytes
        if 4 * size >= 3 * most:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def list_column(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """A list column from its flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, dtype=np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, type=kind))


#: Rows up to which a narrow side of a join is broadcast; its number is checked each time.
BROADCAST_ROWS = 400_000


def small_side(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df, marked for broadcast if it has BROADCAST_ROWS rows at most: a join with it then moves no texts.

    df should be narrow and cheap to read again; beyond the bound the join shuffles.
    """
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


#: Distinct edges up to which one task finds the components; 16 bytes each.
ONE_TASK = 1_000_000


def smallest_reachable(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node that each reaches) of edges (a, b)."""
    nodes, back = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = back[: len(a)], back[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        for at in (label[x], label[y], x, y):
            np.minimum.at(new, at, low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _in_one_task(e: DataFrame) -> DataFrame:
    def run(batches):
        held = [(np.asarray(x.column(0)), np.asarray(x.column(1))) for x in batches if x.num_rows]
        if held:
            nodes, component = smallest_reachable(*(np.concatenate(c) for c in zip(*held)))
            yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(component)], names=["node", "component"])

    return e.coalesce(1).mapInArrow(run, "node long, component long")


def connected_components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """(node, component) for every node that an edge joins to another; component is the smallest node it reaches.

    Up to one_task distinct edges (their number is checked) go to one task.
    More are solved by alternating large-star and small-star steps: the links
    stay in tables on the cluster and only a count and a checksum reach the
    driver.  A hub's rows meet in an aggregate (combined before the shuffle)
    and a join that AQE can split.  Null ends and self-links are ignored; no
    edges give no rows.
    """
    e = cut(
        edges.where(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .distinct()
    )
    state = None
    while True:
        found = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(found) == state or not found[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
                e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        if found[0] <= one_task:
            return _in_one_task(e)
        state = tuple(found)
        low = e.groupBy("u").agg(F.min("v").alias("m"))
        both = low.select("u", "m").unionByName(e.select(F.col("v").alias("u"), F.col("v").alias("m")))
        hub = both.groupBy("u").agg(F.min("m").alias("m"))
        # Large star: every neighbour above u hangs itself below u's smallest neighbour.
        large = e.select(F.col("u").alias("w"), F.col("v").alias("u")).join(hub, "u").select(F.col("w").alias("u"), F.col("m").alias("v"))
        # Small star: u and its lower neighbours meet at the smallest of them.
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        )
        e = cut(small.distinct())
