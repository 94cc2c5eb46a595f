"""K-mer validation and similarity."""

from __future__ import annotations

from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..storage import kept


#: Windows of a chunk; finding a position in a string takes time in proportion to it.
CHUNK = 256


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys if its scan has fewer partitions than the cluster has cores; a large scan stays as it is."""
    few = df.rdd.getNumPartitions() < df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(*keys) if few else df


def explode_kmers(df: DataFrame, key: list[str], seq: str, k: int, distinct: bool = True) -> DataFrame:
    """(key, km), canonical, of windows without other letters than A, C, G and T; sequences are cut into overlapping chunks first."""
    rows = spread(df.select(*key, F.col(seq).alias("_s")).where(F.length("_s") >= k), *key)
    chunks = rows.select(*key, "_s", F.explode(F.sequence(F.lit(0), F.length("_s") - k, F.lit(CHUNK))).alias("_i")).select(*key, F.substring("_s", F.col("_i") + 1, F.lit(CHUNK + k - 1)).alias("_c"))
    windows = chunks.select(*key, "_c", F.explode(F.sequence(F.lit(1), F.length("_c") - (k - 1))).alias("_i")).select(*key, F.substring("_c", F.col("_i"), F.lit(k)).alias("_w"))
    out = windows.where(~F.col("_w").rlike("[^ACGTacgt]")).select(*key, S.canonical(F.col("_w")).alias("km"))
    return out.distinct() if distinct else out


def depth_of_alleles(alleles: DataFrame, reads: DataFrame, key: list[str], k: int = 31) -> DataFrame:
    """Coverage of each allele set's k-mers by reads, and reads' k-mers that no allele has.

    alleles(key, seq), reads(key, seq).  Columns: n_kmers, covered, mean_depth
    (absent k-mers count 0), chi2 and df over the depths above 0, and
    unexpected: the share of the reads' distinct k-mers outside the alleles.
    """
    a = explode_kmers(alleles, key, "seq", k)
    n = explode_kmers(reads, key, "seq", k, distinct=False).groupBy(*key, "km").agg(F.count("*").alias("d"))
    both = n.join(a.withColumn("_a", F.lit(1)), [*key, "km"], "full")
    inside, seen = F.col("_a").isNotNull(), F.col("d").isNotNull()
    d = F.when(inside, F.coalesce("d", F.lit(0)))
    stats = both.groupBy(*key).agg(
        F.count_if(inside).alias("n_kmers"), F.count_if(inside & seen).alias("_hit"), F.avg(d).alias("mean_depth"), F.count_if(seen).alias("_reads"), F.count_if(seen & ~inside).alias("_out"),
        F.sum(F.when(inside & seen, F.col("d"))).alias("_s1"), F.sum(F.when(inside & seen, F.col("d") * F.col("d"))).alias("_s2"),
    )
    return _coverage(stats, key)


def _coverage(stats: DataFrame, key: list[str]) -> DataFrame:
    mu = F.col("_s1") / F.col("_hit")
    chi2 = F.when(F.col("_hit") > 5, F.col("_s2") / mu - F.col("_s1"))
    return stats.select(
        *key, "n_kmers", F.when(F.col("n_kmers") > 0, F.col("_hit") / F.col("n_kmers")).otherwise(0.0).alias("covered"), F.coalesce("mean_depth", F.lit(0.0)).alias("mean_depth"),
        chi2.alias("chi2"), (F.col("_hit") - 1).alias("df"), (F.col("_out") / F.greatest(F.col("_reads"), F.lit(1))).alias("unexpected"),
    )


#: Letters of a slice, and about as many k-mers as a bucket holds.
SLICE, BUCKET = 4 << 20, 2 << 20
#: Rows of a batch that leaves a slice.
ROWS = 256
#: Codes of letters; 4 breaks a k-mer: N, and with it the letters for several bases that contigs hold.
_LETTERS = np.full(256, 4, dtype=np.uint8)
_LETTERS[[ord(c) for c in "ACGT"]] = range(4)


def kmer_codes(bases: bytes, k: int, piece: int = 1 << 19) -> tuple[np.ndarray, np.ndarray]:
    """(where, code) of the windows of A, C, G and T only: canonical, two bits a base; k up to 31.  Made piece by piece, to need little memory."""
    n = max(len(bases) - k + 1, 0)
    where, codes = np.empty(n, dtype=np.uint32), np.empty(n, dtype=np.uint64)
    have = 0
    for a in range(0, n, piece):
        w, c = _piece_codes(bases[a : a + piece + k - 1], k)
        where[have : have + len(w)], codes[have : have + len(w)] = w + a, c
        have += len(w)
    return where[:have], codes[:have]


def _piece_codes(bases: bytes, k: int) -> tuple[np.ndarray, np.ndarray]:
    c = _LETTERS[np.frombuffer(bases, dtype=np.uint8)]
    bad = np.concatenate([[0], np.cumsum(c == 4, dtype=np.int32)])
    where = np.flatnonzero(bad[k:] == bad[:-k])
    two = lambda i: np.uint64(2 * i)
    # Windows of 1, 2, 4 ... bases, put together to windows of k.
    f, r, size = (c & 3).astype(np.uint64), (3 - (c & 3)).astype(np.uint64), 1
    forward, back, have = None, None, 0
    while True:
        if k & size:
            if forward is None:
                forward, back = f, r
            else:
                m = min(len(forward) - size, len(f) - have)
                forward, back = forward[:m] << two(size) | f[have : have + m], back[:m] | r[have : have + m] << two(have)
            have += size
        if have == k:
            return where, np.minimum(forward[where], back[where])
        f, r, size = f[:-size] << two(size) | f[size:], r[:-size] | r[size:] << two(size), 2 * size


def _sorted_counts(codes: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and how often each occurs."""
    if counts is None:
        codes.sort()
    else:
        by = np.argsort(codes)
        codes, counts = codes[by], counts[by]
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    return codes[first], np.diff(np.append(first, len(codes))) if counts is None else np.add.reduceat(counts, first)


def _packed(a: np.ndarray) -> bytes:
    """An array, compressed byte plane by byte plane."""
    raw = a.view(np.uint8).reshape(len(a), -1).T.tobytes()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(blob: bytes, kind) -> np.ndarray:
    raw = np.frombuffer(pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True), dtype=np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(kind).itemsize, -1).T).reshape(-1).view(kind)


def _listed(names: list[str]) -> bytes:
    """Names of sets as one compressed text; being JSON, they hold no line breaks."""
    raw = "\n".join(names).encode()
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _names(blob: bytes) -> list[str]:
    return pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True).decode().split("\n")


def _slice_rows(names: list[str], seqs: list[list[str]], k: int, bits: int):
    """A slice's rows, one a bucket: its sets, and of each set the distinct k-mers and their counts; uses up seqs.

    Sets are counted one by one into two arrays, and only places in these are dealt.
    """
    odd, low = np.uint64(0x9E3779B97F4A7C15), np.uint64((1 << 2 * k) - 1)
    n = sum(max(sum(map(len, own)) + len(own) - k, 0) for own in seqs)
    codes, counts = np.empty(n, dtype=np.uint64), np.empty(n, dtype=np.uint32)
    starts, have = [], 0
    for own in seqs:
        found = kmer_codes("N".join(own).encode(), k)[1]
        own.clear()
        found *= odd  # mixed one to one, so that the upper bits deal evenly
        found &= low
        starts.append(have)
        found.sort()
        first = np.flatnonzero(np.diff(found, prepend=~found[:1]))
        end, size = have + len(first), len(found)
        codes[have:end] = found[first]
        del found
        counts[have:end] = np.diff(first, append=size)
        have = end
    bucket = (codes[:have] >> np.uint64(max(2 * k - bits, 0))).astype(np.uint16 if bits <= 16 else np.uint32)
    starts, every, step = np.array(starts), _listed(names), max((1 << bits) >> 3, 1)
    for low_end in range(0, 1 << bits, step):
        places = np.flatnonzero((bucket >= low_end) & (bucket < low_end + step))
        places = places[np.argsort(bucket[places], kind="stable")]  # by bucket; there set by set, and in order within a set
        first = np.flatnonzero(np.diff(bucket[places].astype(np.int64), prepend=-1))
        for i, j in zip(first, [*first[1:], len(places)]):
            own = places[i:j]
            has, sizes = _sorted_counts(np.searchsorted(starts, own, side="right") - 1)
            sets = every if len(has) == len(names) else _listed([names[x] for x in has])
            yield int(bucket[own[0]]), sets, _packed(sizes.astype(np.uint32)), _packed(np.diff(codes[own], prepend=np.uint64(0))), _packed(counts[own])


def _dealt(k: int, bits: int):
    """Rows of _slice_rows for each slice of about SLICE letters."""

    def run(batches):
        kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.binary()]
        for batch in batches:
            n = np.asarray(pa.compute.binary_length(batch.column(1))).astype(np.int64)
            at = np.cumsum(n) // SLICE
            edges = [0, *(np.flatnonzero(np.diff(at)) + 1).tolist(), batch.num_rows] if batch.num_rows else [0]
            for a, b in zip(edges, edges[1:]):
                by: dict[str, list[str]] = {}
                for name, seq in zip(batch.column(0)[a:b].to_pylist(), batch.column(1)[a:b].to_pylist()):
                    by.setdefault(name, []).append(seq)
                names = sorted(by)
                rows = _slice_rows(names, [by.pop(name) for name in names], k, bits)
                while part := list(islice(rows, ROWS)):
                    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*part), kinds)], names=["bucket", "sets", "sizes", "codes", "counts"])

    return run


def _bucket_stats(t: pa.Table) -> pa.Table:
    """Counts of a bucket's k-mers for each key and, under no key, those of the sequences that all keys share."""
    sizes = [_unpacked(x, np.uint32) for x in t.column("sizes").to_pylist()]
    n = sum(int(x.sum()) for x in sizes)
    codes, counts, member = np.empty(n, np.uint64), np.empty(n, np.uint32), np.empty(n, np.int32)
    number: dict[str, int] = {}
    at, last, listed = 0, None, None
    for row, size in enumerate(sizes):
        sets = t.column("sets")[row].as_py()
        if sets != last:
            last, listed = sets, np.array([number.setdefault(x, len(number)) for x in _names(sets)], dtype=np.int32)
        end = at + int(size.sum())
        np.cumsum(_unpacked(t.column("codes")[row].as_py(), np.uint64), out=codes[at:end])
        counts[at:end] = _unpacked(t.column("counts")[row].as_py(), np.uint32)
        member[at:end] = np.repeat(listed, size)
        at = end
    order = np.argsort(member, kind="stable")
    edges = np.searchsorted(member[order], np.arange(len(number) + 1))
    del member

    def whole(name):
        i = number.get(name)
        if i is None:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        own = order[edges[i] : edges[i + 1]]
        return _sorted_counts(codes[own], counts[own].astype(np.int64))

    shared = whole("s")[0]
    out = [(None, len(shared), 0, 0, 0, 0, 0)] if len(shared) else []
    for key in sorted({name[1:] for name in number if name != "s"}):
        a = np.union1d(shared, whole("a" + key)[0]) if "a" + key in number else shared
        d = whole("r" + key)
        inside = d[1][np.isin(d[0], a, assume_unique=True)]
        out.append((key, len(a) - len(shared), len(inside), len(d[0]), len(d[0]) - len(inside), int(inside.sum()), int((inside * inside).sum())))
    names = ["_key", "n_kmers", "_hit", "_reads", "_out", "_s1", "_s2"]
    return pa.table({n: pa.array(v, pa.string() if n == "_key" else pa.int64()) for n, v in zip(names, zip(*out))})


def depth_of_dna(alleles: DataFrame | None, reads: DataFrame, key: list[str], k: int = 31, letters: int | None = None, shared: DataFrame | None = None) -> DataFrame:
    """depth_of_alleles for whole corpora and k up to 31; windows with other letters than A, C, G and T are left out.

    Every k-mer of every sequence counts.  Slices combine their k-mers as
    numbers and deal them to buckets by their bits; a bucket counts those of
    all sets, and the buckets' sums are added up.  shared(seq): sequences that
    every key of `reads` has among its alleles, dealt once and not once a key.
    letters: about how many there are; read if not given.  Null keys are a key
    of their own.
    """
    if k > 31:
        raise ValueError("k is 31 at most")
    name = F.to_json(F.struct(*key))
    side = lambda df, s: df.where(F.col("seq").isNotNull()).select(F.concat(F.lit(s), name).alias("set"), "seq")
    rows = side(reads, "r")
    if alleles is not None:
        rows = side(alleles, "a").unionByName(rows)
    if shared is not None:
        rows = rows.unionByName(shared.where(F.col("seq").isNotNull()).select(F.lit("s").alias("set"), "seq"))
    if letters is None:
        letters = rows.agg(F.sum(F.length("seq").cast("long"))).first()[0] or 0
    bits = min(max(2, int(letters // BUCKET).bit_length()), 2 * k)
    dealt = rows.mapInArrow(_dealt(k, bits), "bucket int, sets binary, sizes binary, codes binary, counts binary")
    found = dealt.groupBy("bucket").applyInArrow(_bucket_stats, "_key string, n_kmers long, _hit long, _reads long, _out long, _s1 long, _s2 long")
    columns = found.columns[1:]
    stats = found.groupBy("_key").agg(*[F.sum(c).alias(c) for c in columns])
    if shared is not None:
        # Every key has the shared k-mers, also one whose reads have none; their number is one row.
        stats = kept(stats)
        n = stats.where("_key is null").agg(F.coalesce(F.sum("n_kmers"), F.lit(0)).alias("_shared"))
        keys = reads.select(name.alias("_key")).distinct()
        stats = keys.join(stats, "_key", "left").na.fill(0, columns).crossJoin(F.broadcast(n)).withColumn("n_kmers", F.col("n_kmers") + F.col("_shared")).drop("_shared")
    schema = reads.select(*key).schema
    stats = stats.withColumn("_k", F.from_json("_key", schema)).select(*[F.col("_k")[c].alias(c) for c in key], *columns)
    return _coverage(stats.withColumn("mean_depth", F.when(F.col("n_kmers") > 0, F.col("_s1") / F.col("n_kmers"))), key)


def validate(depths: DataFrame, min_covered: float = 0.90, max_unexpected: float = 0.30) -> DataFrame:
    """depths with concordant and flags."""
    flags = F.filter(
        F.array(
            F.when(F.col("n_kmers") == 0, "no_kmers"), F.when(F.col("covered") < min_covered, "low_kmer_coverage"),
            F.when(F.col("unexpected") > max_unexpected, "high_unexpected_kmers"), F.when(F.col("chi2").isNull(), "too_few_kmers"),
        ),
        lambda x: x.isNotNull(),
    )
    ok = (F.col("n_kmers") > 0) & (F.col("covered") >= min_covered) & (F.col("unexpected") <= max_unexpected)
    return depths.withColumn("concordant", ok).withColumn("flags", flags)


#: K-mers of the right side up to which it is broadcast; counted each time.
BROADCAST_KMERS = 500_000


def kmer_lists(df: DataFrame, key: str, k: int) -> DataFrame:
    """(key, n, codes): the distinct canonical k-mers of each sequence df(key, seq) as numbers, two bits a base; k up to 31.

    Windows with other letters than A, C, G and T have none.  Null sequences
    count as empty.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                found = [np.unique(kmer_codes((s or "").encode(), k)[1]).view(np.int64) for s in part.column(1).to_pylist()]
                n = np.array([len(c) for c in found], dtype=np.int64)
                offsets = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
                flat = pa.array(np.concatenate(found) if found else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n), pa.ListArray.from_arrays(pa.array(offsets), flat)], names=[key, "n", "codes"])

    if k > 31:
        raise ValueError("k is 31 at most")
    return df.select(key, "seq").mapInArrow(run, f"`{key}` {kind}, n long, codes array<long>")


def jaccard(left: DataFrame, right: DataFrame, k: int = 21) -> DataFrame:
    """(id, other, common, jaccard) of sequences left(id, seq) and right(other, seq) with common k-mers.

    K-mers are numbers that are made, with their count, in one pass over each
    side.  A right side of bounded size is broadcast, so that only matches are
    shuffled; a larger one meets the left's k-mers in a join.
    """
    a = kmer_lists(spread(left, "id"), "id", k).select("id", F.col("n").alias("n1"), F.explode("codes").alias("km"))
    b = kmer_lists(right, "other", k).select("other", F.col("n").alias("n2"), F.explode("codes").alias("km"))
    small = b.count() <= BROADCAST_KMERS
    c = a.join(F.broadcast(b) if small else b, "km").groupBy("id", "other", "n1", "n2").agg(F.count("*").alias("common"))
    return c.select("id", "other", "common", (F.col("common") / (F.col("n1") + F.col("n2") - F.col("common"))).alias("jaccard"))


def seed_hits(reads: DataFrame, alleles: DataFrame, k: int = 15, least: int = 2) -> DataFrame:
    """Alignments without an aligner: reads(sample_id, read_id, seq) against alleles(locus, allele, seq) by common k-mers.

    (sample_id, read_id, locus, allele, as_score, mapq, is_secondary): score is
    the number of common distinct k-mers, `least` at least.  A read's best hit
    (ties by name) is primary; quality is 60 where it stands alone, 1 for hits
    that share the best score, 0 for all others.
    """
    r = reads.select(F.struct("sample_id", "read_id").alias("id"), "seq")
    hits = jaccard(r.withColumn("id", F.to_json("id")), alleles.select(F.to_json(F.struct("locus", "allele")).alias("other"), "seq"), k).where(F.col("common") >= least)
    keys, targets = reads.select("sample_id", "read_id").schema, alleles.select("locus", "allele").schema
    rows = hits.select(F.from_json("id", keys).alias("r"), F.from_json("other", targets).alias("t"), F.col("common").cast("int").alias("as_score")).select("r.*", "t.*", "as_score")
    read = Window.partitionBy("sample_id", "read_id")
    rows = rows.withColumn("_best", F.max("as_score").over(read)).withColumn("_k", F.row_number().over(read.orderBy(F.col("as_score").desc(), "allele")))
    rows = rows.withColumn("_top", F.count_if(F.col("as_score") == F.col("_best")).over(read))
    mapq = F.when(F.col("as_score") < F.col("_best"), 0).when(F.col("_top") > 1, 1).otherwise(60)
    return rows.select("sample_id", "read_id", "locus", "allele", "as_score", mapq.alias("mapq"), (F.col("_k") > 1).alias("is_secondary"))


def closest_alleles(needed: DataFrame, contigs: DataFrame, alleles: DataFrame, hits: DataFrame | None = None, k: int = 21, top: int = 5, novel: float = 0.995) -> DataFrame:
    """needed(sample_id, locus) with closest, identity, n_contigs and is_novel.

    A locus's contigs(sample_id, locus, seq) are compared as one set of k-mers
    with alleles(locus, allele, seq).  Where hits(sample_id, locus, allele,
    cigar, nm), their alignments, hold one of the `top` most similar alleles, the
    one of highest identity is the closest; else the most similar by k-mers.
    Less than `novel` identity is novel, and so is a locus without contigs.
    """
    key = ["sample_id", "locus"]
    joined = contigs.join(needed.select(*key), key, "left_semi").groupBy(*key).agg(F.concat_ws("N", F.array_sort(F.collect_list("seq"))).alias("seq"), F.count("*").alias("n_contigs"))
    ids = joined.withColumn("id", F.to_json(F.struct(*key)))
    targets = alleles.select(F.to_json(F.struct("locus", "allele")).alias("other"), "seq")
    similar = jaccard(ids.select("id", "seq"), targets, k).withColumn("t", F.from_json("other", alleles.select("locus", "allele").schema))
    similar = similar.join(ids.select("id", *key), "id").where(F.col("t.locus") == F.col("locus")).select(*key, F.col("t.allele").alias("allele"), "jaccard")
    order = Window.partitionBy(*key).orderBy(F.round("jaccard", 9).desc(), "allele")
    best = similar.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= top)
    if hits is not None:
        own = hits.select(*key, "allele", S.identity(F.col("cigar"), F.coalesce("nm", F.lit(0))).alias("_i")).groupBy(*key, "allele").agg(F.max("_i").alias("_i"))
        best = best.join(own, [*key, "allele"], "left")
    else:
        best = best.withColumn("_i", F.lit(None).cast("double"))
    pick = Window.partitionBy(*key).orderBy(F.when(F.col("_i") > 0, F.col("_i")).desc_nulls_last(), "_r")
    one = best.withColumn("_p", F.row_number().over(pick)).where("_p = 1").select(*key, F.col("allele").alias("closest"), F.when(F.col("_i") > 0, F.col("_i")).otherwise(F.col("jaccard")).alias("identity"))
    out = needed.join(joined.select(*key, "n_contigs"), key, "left").join(one, key, "left").na.fill(0, ["n_contigs"]).na.fill(0.0, ["identity"]).na.fill("", ["closest"])
    return out.withColumn("is_novel", F.col("identity") < novel)


def best_matches(similar: DataFrame, k: int = 5) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.round("jaccard", 9).desc(), "other")
    return similar.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def contig_stats(contigs: DataFrame, key: list[str], length: str, tie: str, gene: int = 4000) -> DataFrame:
    """n, total, n50 and gene coverage of each key's contigs."""
    order = Window.partitionBy(*key).orderBy(F.col(length).desc(), tie)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = contigs.withColumn("_c", F.sum(length).over(upto)).withColumn("_t", F.sum(length).over(Window.partitionBy(*key)))
    return w.groupBy(*key).agg(
        F.count("*").alias("n"), F.max("_t").alias("total"), F.max(F.when(F.col("_c") * 2 >= F.col("_t"), F.col(length))).alias("n50"),
        F.least(F.lit(1.0), F.max("_t") / gene).alias("coverage"),
    )
