"""Operators that go by pairs of blocks of points, against those on all edges."""

import random

import numpy as np

from skein.operators import metric
from skein.sources import memory


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def cloud(spark, sizes, draw):
    points = [(g, k, draw()) for g, n in sizes for k in range(n)]
    return memory.from_point_frame(spark.createDataFrame(points, "g string, p long, c array<double>"), "g", "p", "c")


def test_blocks_of_points(spark, monkeypatch):
    """Several blocks a group, null and one-point groups, ties, repeated points, far offsets, numbers near a double's limits."""
    monkeypatch.setattr(metric, "BLOCK", 8)
    monkeypatch.setattr(metric, "TILE", 16)
    r = random.Random(4)
    ways = (
        lambda: [r.random() for _ in range(5)],
        lambda: [float(r.randint(0, 2)) for _ in range(2)],
        lambda: [1e9 + r.random(), r.random()],
        lambda: [r.choice((1e308, -1e308, 1e-200, 0.0))],
    )
    for draw in ways:
        space = cloud(spark, (("a", 29), (None, 17), ("one", 1)), draw)
        points = space.points.collect()
        at = {(p.group_id, p.id): p.coords for p in points}
        frame = spark.createDataFrame([(g, u, v, at[g, u], at[g, v]) for g, u in at for h, v in at if h == g and v < u], "group_id string, u long, v long, a array<double>, b array<double>")
        edges = frame.select("group_id", "u", "v", metric.euclidean(frame.a, frame.b).alias("d"))
        assert rows(space.edges) == rows(edges)
        assert rows(space.enclosing_radius()) == rows(metric.enclosing_radius(space.vertices, edges))
        for k in (3, 40):
            assert rows(space.knn_graph(k)) == rows(metric.knn_graph(edges, k))
        for t in (0.0, 1.0, float("inf")):
            assert rows(space.within(t)) == rows(metric.within(edges, t))


def test_few_pairs_are_left_to_exact_distances(monkeypatch):
    """What a product in single precision leaves holds the k nearest, and is little more; also far from the origin."""
    draw = np.random.default_rng(3)
    for offset in (0.0, 1e6):
        x, y = (offset + draw.normal(size=(n, 16)) for n in (300, 700))
        exact = np.sqrt(((x[:, None] - y[None]) ** 2).sum(2))
        for kind in (np.float32, np.float64):
            rough, slack, squared = metric._rough(x, y, kind)
            assert squared and rough.dtype == kind and np.abs(rough.astype(float) - exact**2).max() <= slack
            for by, d in ((0, exact), (1, exact.T)):
                found = set(zip(*(c.tolist() for c in metric._lowest(rough, slack, 5, by)), strict=True))
                assert {(a, int(b)) for a in range(len(d)) for b in np.argsort(d[a])[:6]} <= found
                assert offset and kind is np.float32 or offset or len(found) < 9 * len(d)
