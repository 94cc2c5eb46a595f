"""Variational weights are made piece by piece."""

import tracemalloc

import numpy as np

from lociforge.operators import kernels


def test_pieces_give_what_the_whole_gives(monkeypatch):
    r = np.random.default_rng(1)
    m = np.where(r.random((500, 6)) < 0.5, r.random((500, 6)), 0)
    times = r.integers(1, 5, 500)
    whole = kernels.variational_weights(m, times=times)
    monkeypatch.setattr(kernels, "PIECE", 60)
    for a, b in zip(whole, kernels.variational_weights(m, times=times)):
        assert np.allclose(a, b, atol=1e-9)


def test_a_round_needs_little_besides_the_evidence():
    r = np.random.default_rng(2)
    m = np.where(r.random((400_000, 10)) < 0.4, r.random((400_000, 10)), 0)
    tracemalloc.start()
    kernels.variational_weights(m, rounds=2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < m.nbytes  # all rows at once took eight times that
