"""N-gram Jaccard join with signature trees.

1. Each document becomes its set of word shingles (64-bit hashes).
2. Routing.  Shingles stand in one order over the corpus, rarest first.  Two
   sets of similarity t have a shingle in common among the first
   n - ceil(t * n) + 1 of each.  Shingles that one document alone has fill
   these places without being able to match, so most documents drop out at
   once, passages that many documents share come last, and only what is left
   is a routing key.  No pair is lost and none is enumerated here: a key links
   its sets to the first of them only.
3. Sets that keys connect form a candidate class.  Over each class a signature
   tree is built: leaves are the sets' bitmaps, inner nodes hold OR-combined
   bitmaps and size ranges.  A dual traversal drops node pairs whose sizes
   cannot match or whose largest possible overlap is too small, and all pairs
   of sets that are left are compared exactly, many at once.  Classes over a
   size limit are cut into blocks by size, and every pair of blocks whose size
   ranges match is a task.  A task returns each set's number of links, weighted
   by how many texts have the other set, and edges that connect what links.
4. Edges and equal sets give the components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.ipc  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Fresh, connected_components, own, small_side, smallest_reachable, text_slices, written
from .wordscan import mix, scan, shingle_sets

#: Shingles of a block; a task holds two blocks.
BLOCK = 2_000_000
#: Bytes of text a routing bucket.
BUCKET = 10_000_000
FANOUT = 16
SALTS = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)


def _running(flat: np.ndarray, salt: int) -> np.ndarray:
    total = np.zeros(len(flat) + 1, dtype=np.uint64)
    np.cumsum(mix(flat + np.uint64(salt)), out=total[1:])
    return total


def _spans(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ends = np.cumsum([len(s) for s in sets], dtype=np.int64)
    flat = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    return flat, np.concatenate([[0], ends[:-1]]).astype(np.int64), ends


def fingerprints(sets: list[np.ndarray]) -> list[np.ndarray]:
    """Two 64-bit fingerprints of each set."""
    flat, starts, ends = _spans(sets)
    return [(t := _running(flat, salt))[ends] - t[starts] for salt in SALTS]


def places(n: np.ndarray, percent: int) -> np.ndarray:
    """How many of a set's first shingles must be looked at, one to spare for hash clashes."""
    return n + (-percent * n) // 100 + 2


class SignatureTree:
    """Bitmaps, size ranges and slack of sets in levels of FANOUT children a node.

    The slack of a set is the number of its elements that share a bit with
    another: sets with c common bits have c + slack common elements at most.
    """

    def __init__(self, sets: list[np.ndarray], bits: int):
        self.sets = sets
        n = np.array([len(s) for s in sets], dtype=np.int64)
        maps = np.zeros((len(sets), bits // 64), dtype=np.uint64)
        for i, s in enumerate(sets):
            one = np.zeros(bits, dtype=bool)
            one[(s & np.uint64(bits - 1)).astype(np.int64)] = True
            maps[i] = np.packbits(one).view(np.uint64)
        slack = n - np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, n, n, slack)]
        while len(self.levels[-1][0]) > 1:
            maps, low, high, slack = self.levels[-1]
            at = np.arange(0, len(maps), FANOUT)
            self.levels.append((np.bitwise_or.reduceat(maps, at), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(slack, at)))

    def children(self, level: int, node: int) -> np.ndarray:
        return np.arange(node * FANOUT, min((node + 1) * FANOUT, len(self.levels[level - 1][0])))

    def leaves(self, level: int, node: int) -> range:
        width = FANOUT**level
        return range(node * width, min((node + 1) * width, len(self.sets)))


def possible(a, i: np.ndarray, b, j: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of nodes i of level a and j of level b can hold sets that link."""
    (ma, la, ha, sa), (mb, lb, hb, sb) = a, b
    most = np.bitwise_count(ma[i][:, None] & mb[j][None]).sum(axis=-1, dtype=np.int64) + np.minimum(sa[i][:, None], sb[j][None])
    most = np.minimum(most, np.minimum(ha[i][:, None], hb[j][None]))
    need = percent * (la[i][:, None] + lb[j][None])
    sizes = (100 * ha[i][:, None] >= percent * lb[j][None]) & (100 * hb[j][None] >= percent * la[i][:, None])
    return sizes & ((100 + percent) * most >= need)


#: Pairs that are compared at once, and bytes of bits that the comparison may hold.
PAIRS, BITS = 1 << 18, 1 << 26


def tree_pairs(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None):
    """(a, b) in arrays: the pairs of sets that the dual traversal cannot rule out, each once.

    side: if given, only sets of different sides are paired (two blocks).
    """
    order = np.array(sorted(range(len(sets)), key=lambda i: (len(sets[i]), int(sets[i][0]) if len(sets[i]) else 0)), dtype=np.int64)
    sides = [order] if side is None else [order[side[order] == s] for s in (0, 1)]
    if not all(len(x) for x in sides):
        return
    bits = min(1 << 15, max(64, 1 << (4 * max(len(s) for s in sets)).bit_length()))
    trees = [SignatureTree([sets[i] for i in part], bits) for part in sides]
    left, right = trees[0], trees[-1]
    stack, held, size = [(len(left.levels) - 1, 0, len(right.levels) - 1, 0)], [], 0
    while stack:
        p, i, q, j = stack.pop()
        leaves = p <= 1 and q <= 1
        down_p, down_q = leaves or p >= q, leaves or q >= p
        ci, pl = (left.children(p, i), p - 1) if p and down_p else (np.array([i]), p)
        cj, ql = (right.children(q, j), q - 1) if q and down_q else (np.array([j]), q)
        ok = possible(left.levels[pl], ci, right.levels[ql], cj, percent)
        if side is None and pl == ql:
            ok &= ci[:, None] < cj[None] if leaves else ci[:, None] <= cj[None]
        x, y = np.nonzero(ok)
        if not leaves:
            stack.extend((pl, int(ci[k]), ql, int(cj[m])) for k, m in zip(x, y))
        elif len(x):
            held.append((sides[0][ci[x]], sides[-1][cj[y]]))
            size += len(x)
            if size >= PAIRS:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, size = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


class Overlaps:
    """Exact sizes of intersections of many pairs of sets: a bit for each element that some but not all of the sets share."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        flat, starts, ends = _spans(sets)
        self.n = ends - starts
        values, at, times = np.unique(flat, return_inverse=True, return_counts=True)
        self.common = int((times == len(sets)).sum())
        some = (times > 1) & (times < len(sets))
        width = -(-int(some.sum()) // 64)
        self.bits = None
        if 8 * width * len(sets) <= BITS:
            place = np.cumsum(some) - 1
            of, column = np.repeat(np.arange(len(sets)), self.n)[some[at]], place[at[some[at]]]
            self.bits = np.zeros((len(sets), width), dtype=np.uint64)
            # Elements of a set stand in ascending columns, so those of a word are neighbours.
            word = of * width + column // 64
            new = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]])) if len(word) else word
            if len(word):
                self.bits.reshape(-1)[word[new]] = np.bitwise_or.reduceat(np.uint64(1) << (column % 64).astype(np.uint64), new)

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        if self.bits is None:  # sets that share little: element by element
            return np.array([len(np.intersect1d(self.sets[i], self.sets[j], assume_unique=True)) for i, j in zip(a, b)], dtype=np.int64)
        out = np.full(len(a), self.common, dtype=np.int64)
        step = max(1, (BITS >> 4) // max(self.bits.shape[1], 1))
        for k in range(0, len(a), step):
            out[k : k + step] += np.bitwise_count(self.bits[a[k : k + step]] & self.bits[b[k : k + step]]).sum(axis=1, dtype=np.int64)
        return out


def tree_links(sets: list[np.ndarray], percent: int, side: np.ndarray | None = None):
    """(a, b) in arrays: all pairs of sets that link."""
    overlaps = Overlaps(sets)
    for a, b in tree_pairs(sets, percent, side):
        both = overlaps.of(a, b)
        ok = 100 * both >= percent * (overlaps.n[a] + overlaps.n[b] - both)
        if ok.any():
            yield a[ok], b[ok]


def linked_sets(sets: list[np.ndarray], copies: np.ndarray, percent: int, side: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(for each set how many texts' other sets it links with, edges from each linked set to the first one that links lead to)."""
    count, label = np.zeros(len(sets), dtype=np.int64), np.arange(len(sets))
    for a, b in tree_links(sets, percent, side):
        count += np.bincount(a, weights=copies[b], minlength=len(sets)).astype(np.int64) + np.bincount(b, weights=copies[a], minlength=len(sets)).astype(np.int64)
        nodes, low = smallest_reachable(np.concatenate([label, a]), np.concatenate([np.arange(len(sets)), b]))
        label[nodes] = low
    own = np.flatnonzero(label != np.arange(len(sets)))
    return count, np.stack([own, label[own]], axis=1)


def _pack5(*columns: np.ndarray) -> bytes:
    """Rows of five-byte numbers."""
    return np.concatenate([np.ascontiguousarray(c).view(np.uint8).reshape(-1, 8)[:, :5] for c in columns], axis=1).tobytes()


def _unpack5(blob: bytes, columns: int) -> list[np.ndarray]:
    raw = np.frombuffer(blob, dtype=np.uint8).reshape(-1, columns, 5)
    out = np.zeros((len(raw), columns, 8), dtype=np.uint8)
    out[:, :, :5] = raw
    return [np.ascontiguousarray(out[:, c]).view(np.uint64).reshape(-1) for c in range(columns)]


def node_of(f1: np.ndarray) -> np.ndarray:
    """The set's 40-bit name in the candidate graph; a clash only joins two candidate classes."""
    return f1.view(np.uint64) >> np.uint64(24)


def hub_edges(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct edges from the first node of each key to its others, index of the first row of each key)."""
    order = np.lexsort((nodes, keys))
    k, v = keys[order], nodes[order]
    new = np.ones(len(k), dtype=bool)
    np.not_equal(k[1:], k[:-1], out=new[1:])
    first = np.flatnonzero(new)
    hub = v[first][np.cumsum(new) - 1]
    odd = hub != v
    pairs = np.unique(np.stack([hub[odd], v[odd]], axis=1), axis=0) if odd.any() else np.zeros((0, 2), np.uint64)
    return pairs, order[first]


_BASE = pa.schema([(c, pa.int64()) for c in ("id", "n", "f1", "f2")])
_PACKED = "slice long, bucket int, blob binary"


def _packed(slices, buckets, blobs) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(slices, pa.int64()), pa.array(buckets, pa.int32()), pa.array(blobs, pa.binary())], names=["slice", "bucket", "blob"])


def _signed(values: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(values).view(np.int64)


def _counted(docs: DataFrame, n: int, buckets: int) -> DataFrame:
    """Packed rows: bucket -1 holds (id, n, f1, f2) of a slice's documents, any other those of their shingles that more documents have, with their number.

    A slice sends each bucket one row with its shingles; slices are numbered
    within their task, so that equal ones are two.
    """

    def run(batches):
        task = TaskContext.get()
        sid = (task.partitionId() if task else 0) << 32
        for part in text_slices(batches, "text"):
            sid += 1
            sets = list(shingle_sets(scan(part.column(1)), n))
            f1, f2 = fingerprints(sets)
            sizes = np.array([len(s) for s in sets], dtype=np.int64)
            ids = part.column(0)
            base = pa.table([ids, pa.array(sizes), pa.array(_signed(f1)), pa.array(_signed(f2))], schema=_BASE)
            flat = np.concatenate(sets)
            doc = np.repeat(np.arange(len(sets), dtype=np.uint32), sizes)
            to = (flat % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(to, kind="stable")
            flat, doc = flat[order] // np.uint64(buckets), doc[order]
            at = np.searchsorted(to[order], np.arange(buckets + 1))
            out = [(-1, _ipc(base))] + [(j, _pack5(flat[at[j] : at[j + 1]]) + doc[at[j] : at[j + 1]].astype(np.uint32).tobytes()) for j in range(buckets) if at[j] < at[j + 1]]
            yield _packed([sid] * len(out), *zip(*out))

    def count(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        if bucket < 0:
            return t
        slices, blobs = t.column("slice").to_pylist(), t.column("blob").to_pylist()
        rows = [len(b) // 9 for b in blobs]
        shingle = _unpack5(b"".join(b[: 5 * r] for b, r in zip(blobs, rows)), 1)[0]
        order = np.argsort(shingle, kind="stable")
        new = np.ones(len(order), dtype=bool)
        np.not_equal(shingle[order][1:], shingle[order][:-1], out=new[1:])
        first = np.flatnonzero(new)
        times = np.diff(np.append(first, len(order)))
        df = np.empty(len(order), dtype=np.uint32)
        df[order] = np.repeat(np.minimum(times, np.iinfo(np.uint32).max), times)
        out, at = [], 0
        for sid, b, r in zip(slices, blobs, rows):
            some = df[at : at + r] > 1
            if some.any():
                doc = np.frombuffer(b, dtype=np.uint32, offset=5 * r)
                out.append((sid, bucket, _pack5(shingle[at : at + r][some]) + doc[some].tobytes() + df[at : at + r][some].tobytes()))
            at += r
        return pa.Table.from_batches([_packed(*zip(*out))]) if out else t.slice(0, 0)

    # The documents' own rows go to as many groups as there are slices.
    group = F.when(F.col("bucket") < 0, -1 - F.col("slice")).otherwise(F.col("bucket").cast("long"))
    return docs.mapInArrow(run, _PACKED).groupBy(group).applyInArrow(count, _PACKED)


def first_places(doc: np.ndarray, shingle: np.ndarray, df: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Which of the documents' shared shingles stand in the first places; all others of a document are its own and come before."""
    order = np.lexsort((shingle, df, doc))
    shared = np.bincount(doc, minlength=len(n))
    rank = np.arange(len(doc)) - np.repeat(np.cumsum(shared) - shared, shared)
    return order[rank < (places(n, percent) - (n - shared))[doc[order]]]


def _edges(counted: DataFrame, percent: int, buckets: int) -> DataFrame:
    """Candidate edges (a, b) between sets that have a routing key in common."""

    def keys(t: pa.Table) -> pa.Table:
        held, base = [], None
        for bucket, blob in zip(t.column("bucket").to_pylist(), t.column("blob").to_pylist()):
            if bucket < 0:
                base = pa.ipc.open_stream(blob).read_all()
            else:
                r = len(blob) // 13
                shingle = _unpack5(blob[: 5 * r], 1)[0]
                held.append((np.frombuffer(blob, np.uint32, r, 5 * r), mix(shingle * np.uint64(buckets) + np.uint64(bucket)), np.frombuffer(blob, np.uint32, r, 9 * r)))
        if base is None or not held:
            return t.slice(0, 0)
        doc, shingle, df = (np.concatenate(x) for x in zip(*held))
        n = base.column("n").to_numpy()
        at = first_places(doc.astype(np.int64), shingle, df, n, percent)
        nodes = node_of(base.column("f1").to_numpy())[doc[at]]
        if not len(at):
            return t.slice(0, 0)
        edges, first = hub_edges(shingle[at], nodes)
        key, nodes = shingle[at][first], nodes[first]
        to = (key % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(to, kind="stable")
        key, nodes = key[order] // np.uint64(buckets), nodes[order]
        cut = np.searchsorted(to[order], np.arange(buckets + 1))
        out = [(j, _pack5(key[cut[j] : cut[j + 1]], nodes[cut[j] : cut[j + 1]])) for j in range(buckets) if cut[j] < cut[j + 1]]
        if len(edges):
            out.append((-1, _signed(edges).tobytes()))
        return pa.Table.from_batches([_packed([0] * len(out), *zip(*out))])

    def meet(t: pa.Table) -> pa.Table:
        blobs = t.column("blob").to_pylist()
        if t.column("bucket")[0].as_py() < 0:
            edges = np.unique(np.frombuffer(b"".join(blobs), dtype=np.int64).reshape(-1, 2), axis=0)
        else:
            edges = _signed(hub_edges(*_unpack5(b"".join(blobs), 2))[0])
        return pa.table({"a": pa.array(edges[:, 0]), "b": pa.array(edges[:, 1])})

    met = counted.groupBy("slice").applyInArrow(keys, _PACKED)
    return met.groupBy("bucket", F.when(F.col("bucket") < 0, F.pmod(F.xxhash64("blob"), F.lit(buckets))).otherwise(F.lit(0))).applyInArrow(meet, "a long, b long")


def _base_rows(counted: DataFrame) -> DataFrame:
    """(id, n, f1, f2) of every document."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0):
                yield from pa.ipc.open_stream(blob.as_buffer()).read_all().to_batches()

    return counted.where("bucket = -1").select("blob").mapInArrow(run, "id long, n long, f1 long, f2 long")


def _ipc(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema) as writer:
        writer.write_table(t)
    return sink.getvalue().to_pybytes()


def _placed(members: DataFrame, percent: int, block: int) -> DataFrame:
    """members(id, n, f1, copies, component) with the tasks they go to: task string, side int (null in a task of one block)."""
    sized = members.groupBy("component").agg(F.sum("n").alias("weight"))
    big = sized.where(F.col("weight") > block)
    upto = Window.partitionBy("component").orderBy("n", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    small = members.join(sized.where(F.col("weight") <= block), "component").select("id", "f1", "copies", F.concat(F.lit("c"), F.col("component")).alias("task"), F.lit(None).cast("int").alias("side"))
    blocks = members.join(big, "component").withColumn("block", F.floor((F.sum("n").over(upto) - F.col("n")) / block).cast("int"))
    ranges = blocks.groupBy("component", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"))
    x, y = ranges.alias("x"), ranges.alias("y")
    pairs = x.join(y, (F.col("x.component") == F.col("y.component")) & (F.col("x.block") <= F.col("y.block")) & (F.col("x.high") * 100 >= F.col("y.low") * percent))
    pairs = pairs.select(F.col("x.component").alias("component"), F.col("x.block").alias("i"), F.col("y.block").alias("j"))
    ends = pairs.select("component", F.explode(F.when(F.col("i") == F.col("j"), F.array(F.struct(F.col("i").alias("block"), F.lit(None).cast("int").alias("side")))).otherwise(F.array(F.struct(F.col("i").alias("block"), F.lit(0).alias("side")), F.struct(F.col("j").alias("block"), F.lit(1).alias("side"))))).alias("e"), F.concat_ws("-", F.lit("b"), "component", "i", "j").alias("task"))
    large = blocks.join(ends.select("component", "e.block", "e.side", "task"), ["component", "block"]).select("id", "f1", "copies", "task", "side")
    return small.unionByName(large)


def _verify(docs: DataFrame, placed: DataFrame, n: int, percent: int) -> DataFrame:
    """Of each task edges (a, b) between sets, by their fingerprints, that connect what links, and (a, n): the links of each set that has any."""

    def sets(batches):
        for part in text_slices(batches, "text"):
            found = list(shingle_sets(scan(part.column(1)), n))
            f1 = fingerprints(found)[0]
            same = _signed(f1) == np.asarray(part.column(2))  # else another row of the same id
            out = part.append_column("set", pa.array([s.tobytes() for s in found], pa.binary())).filter(pa.array(same))
            yield out.select(["f1", "copies", "task", "side", "set"])

    def search(t: pa.Table) -> pa.Table:
        # A set is one, however many rows of its id hold it.
        ids, first = np.unique(t.column("f1").to_numpy(), return_index=True)
        t = t.take(pa.array(first))
        held = [np.frombuffer(b, dtype=np.uint64) for b in t.column("set").to_pylist()]
        side = None if t.column("side").null_count else t.column("side").to_numpy()
        count, edges = linked_sets(held, t.column("copies").to_numpy(), percent, side)
        some = np.flatnonzero(count)
        a = np.concatenate([ids[edges[:, 0]], ids[some]])
        none = lambda k: pa.nulls(k, pa.int64())
        b, links = pa.chunked_array([pa.array(ids[edges[:, 1]], pa.int64()), none(len(some))]), pa.chunked_array([none(len(edges)), pa.array(count[some], pa.int64())])
        return pa.table({"a": pa.array(a, pa.int64()), "b": b, "n": links})

    texts = docs.join(small_side(written(placed, "placed")), "id").select("id", "text", "f1", "copies", "task", "side")
    return texts.mapInArrow(sets, "f1 long, copies long, task string, side int, set binary").groupBy("task").applyInArrow(search, "a long, b long, n long")


def _classes(d: DataFrame, n: int, percent: int, block: int) -> DataFrame:
    """(id, n, f1, first, links) for every row of d(id, text): its set's size and fingerprint, the least (id, f1) of its class and how many other rows it links with; first is null without words or id."""
    size = d.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    buckets = max(8, size // BUCKET)
    counted = written(_counted(d, n, buckets), "counted")
    base = written(_base_rows(counted), "base")
    known = base.where("id is not null and n > 0")
    classes = connected_components(_edges(counted, percent, buckets))
    equal = known.groupBy("f1", "f2", "n").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    node = F.shiftrightunsigned("f1", 24)
    members = written(equal.join(classes, node == classes.node).select("id", "n", "f1", "copies", "component"), "members")
    links = written(_verify(d, _placed(members, percent, block), n, percent), "links")
    # The graph's nodes are sets, so equal sets are one node and rows that share an id are not.
    found = connected_components(links.where("b is not null"))
    labelled = known.join(found, known.f1 == found.node, "left").select("id", "f1", F.coalesce("component", "f1").alias("label"))
    first = labelled.groupBy("label").agg(F.min(F.struct("id", "f1")).alias("first"))
    partners = links.where("b is null").groupBy(F.col("a").alias("f1")).agg(F.sum("n").alias("_others"))
    sets = labelled.groupBy("f1", "label").agg(F.count("*").alias("_copies")).join(first, "label").join(partners, "f1", "left")
    sets = sets.select(F.col("f1").alias("_f"), "first", (F.col("_copies") - 1 + F.coalesce("_others", F.lit(0))).alias("links"))
    held = F.when(F.col("id").isNotNull() & (F.col("n") > 0), F.col("f1"))
    return base.join(sets, held == F.col("_f"), "left").select("id", "n", "f1", "first", F.coalesce("links", F.lit(0)).alias("links"))


def jaccard_join(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """(id, n_shingles, component_id, n_links) for every row of docs: classes of texts linked by shingle similarity.

    A text's words are lower-cased (A-Z) and its set is that of its windows of
    n words; with fewer words the whole sequence is the one shingle; without
    words, or null, the set is empty and linked with nothing.  Two texts link
    when 100 * |intersection| >= percent * |union|; equal sets do.  The
    component is the smallest id reachable by links, the row's own included;
    n_links counts the other rows that the row itself links with.
    Repeated rows are rows of their own, whatever ids they share; a row with a
    null id is linked with nothing and has a null component.  An empty table
    gives no rows; other columns are left out.
    """
    d = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    found = _classes(d, n, percent, block)
    return found.select("id", F.col("n").alias("n_shingles"), F.coalesce("first.id", "id").alias("component_id"), F.col("links").alias("n_links"))


def distinct_documents(docs: DataFrame, n: int = 5, percent: int = 80, key: str = "doc_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with one document of each class of jaccard_join, that of the smallest id.

    Rows without words or without an id stay.  Of rows that repeat an id and a
    set of shingles one stays; rows of one id with other texts are judged each
    by its own.  Columns of any name stay as they are; an empty table gives no rows.
    """
    f = Fresh(docs)
    d = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    found = written(_classes(d, n, percent, block).where("id is not null"), "found")
    gone = found.where("first is not null and (id <> first.id or f1 <> first.f1)")
    again = written(found.groupBy(F.col("id").alias(f.id)).count().where("count > 1").select(f.id), "again")
    n_again = again.count()
    kept = docs.join(small_side(gone.select(F.col("id").alias(f.id)).distinct()), F.col(key) == F.col(f.id), "left_anti")
    if not n_again:
        return kept
    kept = kept.join(small_side(again, n_again), F.col(key) == F.col(f.id), "left_anti")
    # Rows of repeated ids, and they alone, are told apart by their sets.
    rows = docs.join(small_side(again, n_again), F.col(key) == F.col(f.id), "left_semi")
    at = docs.columns.index(text)

    def marked(batches):
        for part in text_slices(batches, at):
            sets = list(shingle_sets(scan(part.column(at)), n))
            f1 = pa.array(_signed(fingerprints(sets)[0]), mask=np.array([not len(x) for x in sets]))
            yield pa.RecordBatch.from_arrays([*part.columns, f1], names=[*part.schema.names, f.f1])

    rows = rows.mapInArrow(marked, T.StructType([*docs.schema.fields, T.StructField(f.f1, T.LongType())]))
    copies = gone.select(F.col("id").alias(f.id), F.col("f1").alias(f.gone)).distinct()
    rows = rows.join(small_side(copies), (F.col(key) == F.col(f.id)) & (F.col(f.f1) == F.col(f.gone)), "left_anti")
    nth = F.when(F.col(f.f1).isNull(), F.lit(1)).otherwise(F.row_number().over(Window.partitionBy(key, f.f1).orderBy(F.lit(1))))
    return kept.unionByName(rows.withColumn(f.nth, nth).where(F.col(f.nth) == 1).select(*own(docs.columns)))
