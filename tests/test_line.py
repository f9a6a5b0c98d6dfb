"""Points on a line: dimension 0 by sorted values, in groups of any size."""

import pytest

from skein.params import InvalidInput, RipsParams
from skein.plans import rips
from skein.sources import memory

INF = float("inf")


def test_large_groups_on_a_line_stay_whole(spark, monkeypatch):
    """Neither rounds nor a kernel's task is needed, whatever a group's size: gaps, equal values, a null group, an infinite gap."""

    def never(*given):
        raise AssertionError("a group on a line was dealt elsewhere")

    monkeypatch.setattr(rips, "FOREST_POINTS", 4)
    monkeypatch.setattr(rips, "rips_rounds", never)
    monkeypatch.setattr(rips, "_point_kernel", never)
    values = {1: [3.5, 0.0, 1.0, 1.0, -0.0, 6.0], 2: [7.0], None: [2.0, 5.0], 4: [-1e308, 1e308]}
    rows = [(g, k, [x]) for g, own in values.items() for k, x in enumerate(own)]
    space = memory.from_point_frame(spark.createDataFrame(rows, "g long, p long, at array<double>"), "g", "p", "at")
    order = lambda bars: sorted(((b.group_id or 0, b.dim, b.birth, b.death) for b in bars.collect()))
    expected = [(0, 0, 0.0, 3.0), (0, 0, 0.0, INF), *[(1, 0, 0.0, d) for d in (1.0, 2.5, 2.5, INF)], (2, 0, 0.0, INF), (4, 0, 0.0, INF), (4, 0, 0.0, INF)]
    assert order(rips.rips_persistence(space, RipsParams(max_dim=0))) == expected
    cut = [(0, 0, 0.0, INF)] * 2 + [(1, 0, 0.0, d) for d in (1.0, INF, INF, INF)] + [(2, 0, 0.0, INF)] + [(4, 0, 0.0, INF)] * 2
    assert order(rips.rips_persistence(space, RipsParams(max_dim=0, threshold=2.0))) == cut


def test_ragged_points_are_no_line(spark):
    rows = [(1, 0, [1.0]), (1, 1, [1.0, 2.0])]
    with pytest.raises(InvalidInput, match="group 1 has points of different dimensions"):
        memory.from_point_frame(spark.createDataFrame(rows, "g long, p long, at array<double>"), "g", "p", "at")
