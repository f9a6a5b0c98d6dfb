"""Annotations that are taken in steps, and when the kernel turns to them."""

import numpy as np

from skein.plans import kernel
from skein.plans.kernel import Dense, point_distances, rips_bars


def test_few_lengths_turn_to_annotations_early(monkeypatch):
    """A nearly complete graph of few lengths, as of suppliers: columns are given up before 16,384 coboundaries are merged."""
    draw = np.random.default_rng(4)
    u, v = np.tril_indices(90, -1)
    d = 1.0 / draw.integers(1, 9, len(u))
    expected = sorted(rips_bars(90, u, v, d, 1, clearing=False))
    merged, feed, calls = [0], kernel.Reducer._feed, []

    def counted(self, *args):
        merged[0] += 1
        return feed(self, *args)

    own = kernel.cycle_bars
    monkeypatch.setattr(kernel.Reducer, "_feed", counted)
    monkeypatch.setattr(kernel, "cycle_bars", lambda *args: calls.append(1) or own(*args))
    points = draw.normal(size=(400, 64))
    a, b = np.tril_indices(400, -1)
    rips_bars(400, a, b, point_distances(points)[a, b], 1)
    assert calls == [1] and merged[0] < 1 << 13
    assert sorted(own(90, u, v, d, Dense)) == expected


def test_edges_in_steps_and_dead_classes_in_relations():
    from skein.plans.cycles import Annotations, cycle_bars

    points = np.random.default_rng(8).normal(size=(120, 40))
    u, v = np.tril_indices(120, -1)
    d = point_distances(points)[u, v]
    order = np.argsort(d, kind="stable")
    u, v, d = u[order], v[order], d[order]
    found = Annotations(120)
    for at in range(0, len(d), 1000):
        assert found.take(u[at : at + 1000], v[at : at + 1000], d[at : at + 1000])
    assert not found.classes.living
    assert sorted(found.all_bars()) == sorted(cycle_bars(120, u, v, d, Dense)) == sorted(rips_bars(120, u, v, d, 1, clearing=False))
