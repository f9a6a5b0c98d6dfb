"""Large sparse groups are taken apart into connected parts."""

import numpy as np

from skein.params import RipsParams
from skein.plans import cycles, rips
from skein.plans.kernel import Dense, point_distances, rips_bars
from skein.sources.memory import from_edge_frame


def test_parts_of_groups_go_to_tasks_of_their_own(spark, monkeypatch):
    """Three groups, one of them named null and one small; parts of 12 points, points without edges, and a part too large."""
    draw, rows, points, expected = np.random.default_rng(5), [], [], []
    for group, n_parts in (("a", 5), (None, 4), ("b", 1)):
        u, v = np.tril_indices(12, -1)
        n = 12 * n_parts + 3
        names = draw.permutation(n)
        ends = [[], [], []]
        for k in range(n_parts):
            d = draw.integers(1, 9, len(u)).astype(float)
            keep = draw.random(len(u)) < 0.7
            for found, x in zip(ends, (names[12 * k + u[keep]], names[12 * k + v[keep]], d[keep]), strict=True):
                found.extend(x.tolist())
        rows += [(group, *e) for e in zip(*ends, strict=True)]
        points += [(group, k) for k in range(n)]
        i, j, d = (np.array(e) for e in ends)
        expected += [(group, *b) for b in rips_bars(n, np.maximum(i, j), np.minimum(i, j), d, 1)]
    kept = []
    monkeypatch.setattr(rips, "PART_EDGES", 100)
    monkeypatch.setattr(rips, "LOOK_EDGES", 20)
    kernel = rips._kernel
    monkeypatch.setattr(rips, "_kernel", lambda v, e, *rest: kept.append(v.groupBy("group_id", "part").count().collect()) or kernel(v, e, *rest))
    space = from_edge_frame(spark.createDataFrame(points, "group_id string, id long"), spark.createDataFrame(rows, "group_id string, i long, j long, d double"))
    key = lambda rows: sorted(map(repr, rows))
    monkeypatch.setattr(rips, "KERNEL_POINTS", 5)
    monkeypatch.setattr(rips, "rips_rounds", None)  # no group needs them
    assert key(map(tuple, rips.rips_persistence(space, RipsParams(max_dim=1)).collect())) == key(expected)
    assert sorted(r["count"] for r in kept[0]) == [1] * 6 + [12] * 9 + [15]


def test_annotations_with_and_without_columns(monkeypatch):
    u, v = np.tril_indices(60, -1)
    d = point_distances(np.random.default_rng(6).normal(size=(60, 30)))[u, v]
    expected = sorted(rips_bars(60, u, v, d, 1, clearing=False))
    assert sorted(cycles.cycle_bars(60, u, v, d, Dense)) == expected
    monkeypatch.setattr(cycles, "BYTES", 1 << 14)  # too little for a second copy
    found = cycles.cycle_bars(60, u, v, d, Dense)
    assert found is not None and sorted(found) == expected
