"""The reduction kernel against brute force, and spaces of known homology."""

import math
import random
from itertools import combinations, product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from skein.oracle import rips_persistence_oracle
from skein.plans.kernel import Dense, point_bars, point_distances, rips_bars
from skein.plans.spaces import Cloud, Listed, Matrix
from skein.queries import PROJECTIVE_PLANE
from skein.sources.memory import uniform_cloud

INF = float("inf")


def matrix(n, condensed):
    m = [[0.0] * n for _ in range(n)]
    for (i, j), d in zip(((i, j) for i in range(n) for j in range(i)), condensed, strict=True):
        m[i][j] = m[j][i] = float(d)
    return m


def bars_of(m, max_dim, threshold=None, modulus=2, **toggles):
    n = len(m)
    if threshold is None:
        threshold = min(map(max, m)) if n else 0.0
    edges = [(i, j, m[i][j]) for i in range(n) for j in range(i) if m[i][j] <= threshold and m[i][j] < INF]
    u, v, d = (np.array(x) for x in zip(*edges, strict=True)) if edges else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
    return sorted(rips_bars(n, u, v, d, min(max_dim, max(n - 1, 0)), modulus, **toggles))


@pytest.mark.parametrize("modulus", [2, 3, 5])
def test_all_small_two_valued_spaces(modulus):
    for n in range(2, 6):
        for values in product((1, 2), repeat=n * (n - 1) // 2):
            m = matrix(n, values)
            assert bars_of(m, min(2, n - 2), modulus=modulus) == rips_persistence_oracle(m, min(2, n - 2), modulus=modulus)


def test_random_spaces_with_ties_and_gaps_under_all_toggles():
    draw = random.Random(20)
    for _ in range(250):
        n = draw.randint(0, 8)
        m = matrix(n, [draw.choice([1, 1.5, 2, 2.5, INF]) for _ in range(n * (n - 1) // 2)])
        modulus, dim, threshold = draw.choice([2, 3, 5]), draw.randint(0, 3), draw.choice([None, 1.0, 2.0, INF])
        expected = rips_persistence_oracle(m, dim, threshold, modulus)
        for apparent, clearing, emergent in product((True, False), repeat=3):
            assert bars_of(m, dim, threshold, modulus, apparent_pairs=apparent, clearing=clearing, emergent=emergent) == expected


@settings(max_examples=60, deadline=None)
@given(st.integers(2, 7).flatmap(lambda n: st.tuples(st.just(n), st.lists(st.sampled_from([0.5, 1.0, 2.0, 2.5, INF]), min_size=n * (n - 1) // 2, max_size=n * (n - 1) // 2), st.permutations(range(n)))))
def test_renumbering_and_doubling(space):
    n, values, order = space
    m = matrix(n, values)
    bars = bars_of(m, 2)
    assert bars_of([[m[i][j] for j in order] for i in order], 2) == bars
    assert bars_of([[2 * x for x in row] for row in m], 2) == [(k, 2 * b, 2 * d) for k, b, d in bars]


def test_projective_plane_has_torsion():
    m = matrix(13, [float(c) for c in PROJECTIVE_PLANE])
    assert [b for b in bars_of(m, 2) if b[0]] == [(1, 1.0, 2.0), (2, 1.0, 2.0)]
    for modulus in (3, 5, 32749):
        assert not [b for b in bars_of(m, 2, modulus=modulus) if b[0]]


def test_circle():
    points = np.array([[math.cos(math.pi * k / 10), math.sin(math.pi * k / 10)] for k in range(20)])
    ((_, birth, death),) = [b for b in point_bars(points, 1) if b[0] == 1]
    assert abs(birth - 2 * math.sin(math.pi / 20)) < 1e-12 and abs(death - 2 * math.sin(7 * math.pi / 20)) < 1e-12


@pytest.mark.parametrize("n", [2, 5, 17, 40])
def test_equidistant_points_are_a_cone(n):
    m = matrix(n, [1.5] * (n * (n - 1) // 2))
    assert bars_of(m, 3 if n < 20 else 1) == [(0, 0.0, 1.5)] * (n - 1) + [(0, 0.0, INF)]
    assert bars_of(m, 1, 0.75) == [(0, 0.0, INF)] * n


def test_ultrametric_has_no_higher_bars():
    m = [[float((i ^ j).bit_length()) for j in range(24)] for i in range(24)]
    assert all(b[0] == 0 for b in bars_of(m, 2))


def test_bipartite_graph_and_a_clique():
    edges = [(64 + i, j, 1.0) for i in range(64) for j in range(64)] + [(128 + i, 128 + j, 1.0) for i, j in combinations(range(3, -1, -1), 2)]
    u, v, d = (np.array(x) for x in zip(*edges, strict=True))
    bars = rips_bars(132, u, v, d, 2)
    assert sum(b == (0, 0.0, INF) for b in bars) == 2 and sum(b == (1, 1.0, INF) for b in bars) == 3969
    assert not [b for b in bars if b[0] == 2 or b[0] == 1 and b[2] < INF]


def test_distances_are_the_left_fold_bit_for_bit():
    from skein.functions.table_functions import distance

    points = uniform_cloud(40, 9, 3)
    found = point_distances(np.array(points))
    assert all(found[i, j] == distance(points[i], points[j]) for i in range(40) for j in range(40))
    big = point_distances(np.array([[1e308], [-1e308], [1e308]]))
    assert big[0, 1] == INF and big[0, 2] == 0
    assert point_distances(np.array([[3e200, 4e200], [0, 0]]))[0, 1] == pytest.approx(5e200)


def test_structures_agree():
    coords = np.array(uniform_cloud(30, 3, 5))
    coords[7] = coords[3]
    full = point_distances(coords)
    limit = 0.6
    u, v = np.nonzero(np.tril(full <= limit, -1))
    dense = Dense(30, u, v, full[u, v])
    others = Cloud(coords, limit), Listed(30, u, v, full[u, v]), Matrix(full.copy(), limit)
    draw = np.random.default_rng(1)
    names = draw.integers(0, 30, (50, 2))
    keep = full[u, v] <= 0.5
    verts, d = np.stack([v, u], 1)[keep], full[u, v][keep]
    for other in others:
        assert (other.between(names[:, 0], names[:, 1]) == dense.between(names[:, 0], names[:, 1])).all()
        assert (other.rows(np.arange(30)) == dense.distance).all()
        assert (other.last_match(verts, d) == dense.last_match(verts, d)).all()
        for k in range(0, len(verts), 7):
            for a, b in zip(other.reach(verts[k].tolist(), d[k]), dense.reach(verts[k].tolist(), d[k]), strict=True):
                assert (a == b).all()
        for a, b in zip(other.edges(4, 19), (u, v, full[u, v]), strict=True):
            assert (a == b[(u >= 4) & (u < 19)]).all()
