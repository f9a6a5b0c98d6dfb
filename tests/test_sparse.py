"""Lists of neighbours in the kernel, dimension 0 of points, the table function on many points."""

import time

import numpy as np
import pytest

from skein.plans import kernel, rips
from skein.plans.kernel import point_bars, point_components, point_distances, rips_bars


@pytest.mark.parametrize("modulus", [2, 3])
def test_lists_match_matrix(monkeypatch, modulus):
    rng = np.random.default_rng(3)
    for n, m in ((12, 30), (40, 120), (7, 0), (1, 0)):
        u, v = (x[: min(m, n * (n - 1) // 2)] for x in np.array([(a, b) for a in range(n) for b in range(a)], int).reshape(-1, 2)[rng.permutation(n * (n - 1) // 2)].T)
        d = rng.integers(1, 6, len(u)).astype(float)
        found = []
        for listed in (0, 1 << 40):
            monkeypatch.setattr(kernel, "LISTED", listed)
            found.append(sorted(rips_bars(n, u, v, d, min(3, n - 1), modulus)))
        assert found[0] == found[1]


def test_components_of_points():
    rng = np.random.default_rng(5)
    for coords in (rng.random((60, 3)), rng.integers(0, 4, (50, 2)).astype(float), rng.integers(0, 9, (40, 1)).astype(float), np.array([[1e308], [-1e308]]), np.zeros((4, 0)), rng.random((1, 2))):
        d = point_distances(coords)
        u, v = np.nonzero(np.tril(d < np.inf, -1))
        for t in (None, 0.0, 0.3, 1.0):
            limit = d.max(1).min() if t is None else t
            keep = d[u, v] <= limit
            assert sorted(point_components(coords, t)) == sorted(rips_bars(len(coords), u[keep], v[keep], d[u, v][keep], 0)) == sorted(point_bars(coords, 0, t))


def test_large_sparse_group_stays_in_one_task(spark, monkeypatch):
    """A cycle of 6,000 points: the matrix would have 36 million entries."""
    from skein.sources import memory

    monkeypatch.setattr(rips, "_rounds", None)
    n = 6000
    space = memory.from_triplets(spark, n, [(k, (k + 1) % n, 1.0) for k in range(n)])
    bars = rips.rips_persistence(space).where("dim = 1").collect()
    assert [(r.birth, r.death) for r in bars] == [(1.0, float("inf"))]


def test_points_on_a_line_by_sorting():
    start = time.process_time()
    assert len(point_bars(np.arange(16000.0)[:, None], 0)) == 16000
    assert time.process_time() - start < 5
