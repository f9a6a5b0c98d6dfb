"""Large clouds by their shortest pairs against the kernel."""

import numpy as np

from skein.params import RipsParams
from skein.plans import clouds, rips
from skein.plans.kernel import point_bars
from skein.sources import memory


def test_shortest_pairs_give_all_bars(monkeypatch):
    """Points in many dimensions, with some far off, repeated ones, and on a grid (equal lengths); two steps or more."""
    draw = np.random.default_rng(9)
    monkeypatch.setattr(clouds, "EACH", 6)
    cube = draw.normal(size=(130, 40))
    far = np.concatenate([draw.normal(size=(90, 30)), 9 * draw.normal(size=(3, 30))])
    for coords in (cube, far, np.repeat(cube[:40], 2, 0), draw.integers(0, 3, (60, 6)).astype(float)):
        found = clouds.cloud_bars(coords)
        assert found is not None and sorted(found) == sorted(point_bars(coords, 1))


def test_large_groups_of_points_need_no_rounds(spark, monkeypatch):
    draw = np.random.default_rng(10)
    groups = {"a": draw.normal(size=(60, 32)), None: draw.normal(size=(45, 32)), "c": draw.normal(size=(7, 32))}
    rows = [(g, k, x.tolist()) for g, points in groups.items() for k, x in enumerate(points)]
    expected = [(g, *b) for g, points in groups.items() for b in point_bars(points, 1)]
    monkeypatch.setattr(rips, "KERNEL_POINTS", 20)
    monkeypatch.setattr(rips, "rips_rounds", None)
    space = memory.from_point_frame(spark.createDataFrame(rows, "g string, p long, c array<double>"), "g", "p", "c")
    found = rips.rips_persistence(space, RipsParams(max_dim=1)).collect()
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, expected))
