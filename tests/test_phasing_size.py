"""Phasing kernels on many different reads: against dense matrices where these are small, in bounded memory where they are not."""

import resource
import time

import numpy as np

from lociforge.operators import kernels


def reads(n, sites, share, seed=3):
    r = np.random.default_rng(seed)
    hap = r.integers(0, 2, n)
    m = np.where(r.random((n, sites)) < share, hap[:, None] ^ (r.random((n, sites)) < 0.05), -1)
    return m[(m >= 0).any(axis=1)]


def test_agreement_of_few_and_of_many_sites():
    for share in (0.1, 0.4, 0.8):
        m = np.unique(reads(80, 15, share), axis=0)
        s, back = kernels.Signatures.of(m)
        seen, sim = (m >= 0).astype(float), kernels._Agreement(s)
        same = sum((m == v).astype(float) @ (m == v).astype(float).T for v in (0, 1))
        want = np.divide(same, seen @ seen.T, out=np.zeros_like(same), where=seen @ seen.T > 0)
        assert np.allclose(np.array([sim @ x for x in np.eye(s.n)])[np.ix_(back, back)], want)


def test_farthest_pair_is_the_first_of_the_largest():
    for seed in range(30):
        s, _ = kernels.Signatures.of(reads(40, 9, 0.5, seed))
        best = max(((int(kernels.Signatures.against(s, i)[1][j]) if sum(x[j] for x in s.against(i)) else -1, -i, -j) for i in range(s.n) for j in range(i + 1, s.n)))
        assert kernels._farthest(s) == (-best[1], -best[2])


def test_many_signatures_need_little_memory_and_time():
    m = reads(60_000, 50, 0.06).astype(np.int8)
    before, start = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
    assert kernels.Signatures.of(m)[0].n > 20_000
    for f in (kernels.spectral_bins, kernels.signature_bins, kernels.greedy_bins):
        assert set(f(m)) <= {-1, 0, 1}
    # A matrix of all pairs would be of more than 3 GB.
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_500_000 and time.time() - start < 120
