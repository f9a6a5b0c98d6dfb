"""Dimensions 0 and 1 by annotations against the reduction of columns."""

import numpy as np
import pytest

from skein.plans import kernel
from skein.plans.cycles import cycle_bars
from skein.plans.kernel import Dense, Listed, point_distances, rips_bars


def spaces(seed):
    """n, u, v, d: points, few different lengths and other symmetric distances, some pairs left out."""
    draw = np.random.default_rng(seed)
    for k in range(90):
        n = int(draw.integers(2, 22))
        u, v = np.tril_indices(n, -1)
        d = [lambda: point_distances(draw.random((n, 1 + k % 5)))[u, v], lambda: draw.integers(0, 6, len(u)).astype(float), lambda: draw.random(len(u))][k % 3]()
        keep = draw.random(len(u)) < draw.choice([0.1, 0.4, 0.8, 1.0])
        yield n, u[keep], v[keep], d[keep]


def test_annotations_give_the_bars_of_columns():
    for k, (n, u, v, d) in enumerate(spaces(1)):
        assert sorted(cycle_bars(n, u, v, d, (Dense, Listed)[k % 2])) == sorted(rips_bars(n, u, v, d, 1, clearing=False))


def test_many_classes_that_live_together(monkeypatch):
    points = np.random.default_rng(2).normal(size=(150, 64))
    u, v = np.tril_indices(150, -1)
    d = point_distances(points)[u, v]
    expected = sorted(rips_bars(150, u, v, d, 1, clearing=False))
    assert sum(b[0] for b in expected) > 150
    monkeypatch.setattr(kernel, "FED", 0)
    calls = []
    monkeypatch.setattr(kernel, "cycle_bars", lambda *args: calls.append(1) or cycle_bars(*args))
    assert sorted(rips_bars(150, u, v, d, 1)) == expected and calls == [1]


@pytest.mark.parametrize("name", ["BYTES", "LEAST"])
def test_columns_go_on_where_annotations_give_up(monkeypatch, name):
    from skein.plans import cycles

    draw = np.random.default_rng(3)
    u, v = np.tril_indices(100, -1)
    d = point_distances(draw.normal(size=(100, 64)))[u, v]
    expected = sorted(rips_bars(100, u, v, d, 1))
    monkeypatch.setattr(cycles, name, 0)
    monkeypatch.setattr(cycles, "TRIANGLES", 0)
    assert cycle_bars(100, u, v, d, Dense) is None
    monkeypatch.setattr(kernel, "FED", 0)
    assert sorted(rips_bars(100, u, v, d, 1)) == expected
