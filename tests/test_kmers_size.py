"""Counting k-mers takes little memory a slice, and few bytes a bucket besides the k-mers."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from lociforge.operators import kmers

N = 4_000_000


def slice_of(sets):
    r = np.random.default_rng(3)
    seqs = ["".join(x) for x in np.array(list("ACGT"))[r.integers(0, 4, (sets, N // sets))]]
    return pa.RecordBatch.from_arrays([pa.array([f'r{{"lang":"l{i % 4}","source":"source {i}"}}' for i in range(sets)]), pa.array(seqs)], names=["set", "seq"])


@pytest.mark.parametrize("sets", [1, 80, 2000])
def test_a_slice_needs_little_memory(sets):
    batch = slice_of(sets)
    tracemalloc.start()
    n = sum(b.num_rows for b in kmers._dealt(21, 9)([batch]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 512
    assert peak < 40 * N  # whole arrays of sets, k-mers, counts, buckets and their order took twice that


def test_names_of_sets_are_few_bytes_of_a_row():
    rows = pa.Table.from_batches(kmers._dealt(21, 9)([slice_of(80)]))
    assert rows.select(["sets", "sizes"]).nbytes / rows.num_rows < 1000  # 80 names and sizes as they are: 3,600
    first = kmers._bucket_stats(rows.filter(pa.compute.equal(rows.column("bucket"), 0)))
    assert first.num_rows == 80 and 6000 < sum(first.column("_reads").to_pylist()) < 9500  # N / 512 k-mers, all different
