"""Frame operators and both engines, on Spark."""

import math
import random

import pytest
from pyspark.sql import functions as F

from skein.functions import diagrams, table_functions
from skein.operators import combinadic, complexes, metric
from skein.oracle import rips_persistence_oracle
from skein.params import RipsParams
from skein.plans.rips import MetricSpace, rips_persistence
from skein.queries import PROJECTIVE_PLANE
from skein.sources import memory
from skein.streaming.diagrams import diagrams_of_batches

INF = float("inf")


def grouped(spark, spaces, kind="dense"):
    """A MetricSpace of matrices, one a group."""
    vertices = [(g, i) for g, m in enumerate(spaces) for i in range(len(m))]
    edges = [(g, i, j, m[i][j]) for g, m in enumerate(spaces) for i in range(len(m)) for j in range(i)]
    return MetricSpace(spark.createDataFrame(vertices, "group_id long, id long"), spark.createDataFrame(edges, "group_id long, u long, v long, d double"), kind)


def random_spaces(seed, count, values, most=7):
    draw = random.Random(seed)
    out = []
    for _ in range(count):
        n = draw.randint(1, most)
        m = [[0.0] * n for _ in range(n)]
        for i in range(n):
            for j in range(i):
                m[i][j] = m[j][i] = float(draw.choice(values))
        out.append(m)
    return out


def by_group(bars, count):
    out = [[] for _ in range(count)]
    for r in bars.collect():
        out[r.group_id].append((r.dim, r.birth, r.death))
    return [sorted(x) for x in out]


@pytest.mark.parametrize(("engine", "modulus", "threshold"), [("kernel", 2, None), ("kernel", 3, 2.0), ("rounds", 2, None), ("rounds", 3, INF)])
def test_engines_match_brute_force(spark, engine, modulus, threshold):
    spaces = random_spaces(5, 40, [1, 1.5, 2, 2.5, INF])
    bars = rips_persistence(grouped(spark, spaces), RipsParams(max_dim=2, modulus=modulus, threshold=threshold), engine)
    assert by_group(bars, 40) == [rips_persistence_oracle(m, 2, threshold, modulus) for m in spaces]


def test_rounds_without_shortcuts_and_on_torsion(spark):
    space = memory.from_condensed(spark, [float(c) for c in PROJECTIVE_PLANE])
    for modulus, expected in ((2, [(1, 1.0, 2.0), (2, 1.0, 2.0)]), (3, [])):
        bars = rips_persistence(space, RipsParams(max_dim=2, modulus=modulus), "rounds")
        assert [b for b in by_group(bars, 1)[0] if b[0]] == expected
    spaces = random_spaces(8, 6, [1, 2], 5)
    for off in (RipsParams(max_dim=2, use_apparent_pairs=False, use_clearing=False), RipsParams(max_dim=2, use_emergent_pairs=False, threads=3), RipsParams(max_dim=2, use_apparent_pairs=False)):
        assert by_group(rips_persistence(grouped(spark, spaces), off, "rounds"), 6) == [rips_persistence_oracle(m, 2) for m in spaces]


def test_rounds_of_points_in_several_blocks_and_parts(spark, monkeypatch):
    """Groups with text, null and repeated numbers of points; columns dealt to many blocks, forests merged twice."""
    import skein.plans.rounds as plan

    monkeypatch.setattr(plan, "COLUMNS", 4)
    monkeypatch.setattr(plan, "PAIRS", 60)
    monkeypatch.setattr(plan, "FAN_IN", 2)
    draw = random.Random(6)
    rows = [(g, k, [draw.random() for _ in range(2)]) for g, n in (("a", 24), (None, 12), ("c", 1)) for k in range(n)]
    for frame in (spark.createDataFrame(rows, "g string, p long, c array<double>"), spark.createDataFrame([(None if g is None else len(g + g), k, c) for g, k, c in rows if g != "c"], "g long, p long, c array<double>")):
        space = memory.from_point_frame(frame, "g", "p", "c")
        params = RipsParams(max_dim=1) if "c" in {r[0] for r in frame.select("g").collect()} else RipsParams(max_dim=2, threshold=0.4, modulus=3)
        assert diagrams.same_diagrams(rips_persistence(space, params, "rounds"), rips_persistence(space, params, "kernel"))
    edges = metric.knn_graph(space.edges, 6)
    sparse = MetricSpace(space.vertices, edges, "sparse")
    assert diagrams.same_diagrams(rips_persistence(sparse, RipsParams(max_dim=2), "rounds"), rips_persistence(sparse, RipsParams(max_dim=2), "kernel"))


def test_partitions_and_row_order_change_nothing(spark):
    space = grouped(spark, random_spaces(2, 20, [1, 2, 3]))
    expected = by_group(rips_persistence(space, RipsParams(max_dim=2)), 20)
    for n in (1, 9):
        mixed = MetricSpace(space.vertices.repartition(n, "id"), space.edges.orderBy(F.rand(n)).repartition(n), "dense")
        assert by_group(rips_persistence(mixed, RipsParams(max_dim=2, threads=n)), 20) == expected


def test_groups_too_large_for_a_task_go_to_rounds(spark, monkeypatch):
    import skein.plans.rips as plan

    spaces = random_spaces(3, 15, [1, 2, 3], 8)
    monkeypatch.setattr(plan, "KERNEL_POINTS", 5)
    assert by_group(rips_persistence(grouped(spark, spaces), RipsParams(max_dim=1)), 15) == [rips_persistence_oracle(m, 1) for m in spaces]
    points = [(g, k, [random.Random(g * 31 + k).random() for _ in range(2)]) for g in range(4) for k in range(3 + g)]
    frame = spark.createDataFrame(points, "g long, p long, c array<double>")
    space = memory.from_point_frame(frame, "g", "p", "c")
    mixed = by_group(rips_persistence(space, RipsParams(max_dim=1)), 4)
    assert mixed == by_group(rips_persistence(space, RipsParams(max_dim=1), "kernel"), 4)


def test_metric_operators(spark):
    points = [(0, k, p) for k, p in enumerate([[0.0, 0.0], [3.0, 4.0], [0.0, 1.0], [6.0, 8.0]])] + [(1, 0, [1.0, 1.0])]
    space = memory.from_point_frame(spark.createDataFrame(points, "g long, p long, c array<double>"), "g", "p", "c")
    edges = {(r.group_id, r.u, r.v): r.d for r in space.edges.collect()}
    assert edges[0, 1, 0] == 5.0 and edges[0, 3, 0] == 10.0 and len(edges) == 6
    assert {r.group_id: r.radius for r in space.enclosing_radius().collect()} == {0: edges[0, 3, 1], 1: 0.0}
    assert {r.group_id: r.n for r in space.n().collect()} == {0: 4, 1: 1} and space.num_edges().collect()[0].n_edges == 6
    assert {(r.u, r.v) for r in metric.knn_graph(space.edges, 1).collect()} == {(2, 0), (2, 1), (3, 1)}
    near = {r.id: [x.nbr for x in r.neighbours] for r in metric.adjacency(metric.within(space.edges, 5.0)).collect()}
    assert near == {0: [1, 2], 1: [0, 2, 3], 2: [0, 1], 3: [1]}
    pairs = spark.createDataFrame([(0, 0, 1), (0, 1, 0), (0, 2, 2), (0, 0, 9)], "group_id long, i long, j long")
    assert sorted(r.d for r in metric.distances_of(space.edges, pairs).collect()) == [0.0, 5.0, 5.0, INF]


def test_distance_expression_at_the_extremes(spark):
    rows = [([], []), ([1e308], [-1e308]), ([3e200, 4e200], [0.0, 0.0]), ([3e-200, 4e-200], [0.0, 0.0]), ([2.0], [2.0])]
    found = [r.d for r in spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate(rows)], "k int, a array<double>, b array<double>").select("k", metric.euclidean(F.col("a"), F.col("b")).alias("d")).orderBy("k").collect()]
    assert found[0] == 0 and found[1] == INF and found[2] == pytest.approx(5e200) and found[3] == pytest.approx(5e-200) and found[4] == 0


def test_combinadics(spark):
    rows = [(sorted(random.Random(k).sample(range(60), 4)),) for k in range(50)]
    df = spark.createDataFrame(rows, "v array<bigint>").withColumn("r", combinadic.rank(F.col("v"), 4))
    for r in df.withColumn("back", combinadic.unrank(F.col("r"), 4)).collect():
        assert r.r == sum(math.comb(x, i + 1) for i, x in enumerate(r.v)) and r.back == r.v
    assert [combinadic.unranked(k, 2) for k in range(6)] == [[0, 1], [0, 2], [1, 2], [0, 3], [1, 3], [2, 3]]


def test_complex_and_boundary(spark):
    full = grouped(spark, [[[0.0 if i == j else 1.0 for j in range(6)] for i in range(6)]])
    counts = {r.dim: r.n_simplices for r in complexes.simplex_counts(full.vertices, full.edges, 4).collect()}
    assert counts == {0: 6, 1: 15, 2: 20, 3: 15, 4: 6}
    triangles, edges = (complexes.simplices(full.vertices, full.edges, d) for d in (2, 1))
    assert complexes.boundary_squared(triangles, edges, 2).where("coefficient <> 0").count() == 0
    euler = {r.t: r.euler for r in complexes.euler_curve(full.vertices, full.edges, 5, [0.5, 1.0]).collect()}
    assert euler == {0.5: 6, 1.0: 1}


def test_diagram_functions(spark):
    bars = spark.createDataFrame([(0, 0, 0.0, 1.0), (0, 0, 0.0, INF), (0, 1, 1.0, 3.0), (0, 1, 2.0, 2.5)], "group_id long, dim int, birth double, death double")
    assert diagrams.essential(bars).count() == 1 and diagrams.in_dim(bars, 1).count() == 2
    curve = {(r.t, r.dim): r.betti for r in diagrams.betti_curve(bars, [0.5, 2.2], 1).collect()}
    assert curve == {(0.5, 0): 2, (0.5, 1): 0, (2.2, 0): 1, (2.2, 1): 2}
    assert [r.death for r in diagrams.most_persistent(bars, 1).where("dim = 1").collect()] == [3.0]
    assert diagrams.same_diagrams(bars, bars.orderBy(F.desc("death"))) and not diagrams.same_diagrams(bars, bars.limit(3))
    assert diagrams.close_diagrams([(1, 1.0, INF)], [(1, 1.000001, INF)]) and not diagrams.close_diagrams([(1, 1.0, 2.0)], [(1, 1.1, 2.0)])
    assert [r.death for r in diagrams.canonical(bars).collect()] == [1.0, INF, 3.0, 2.5]


def test_table_function(spark):
    table_functions.register(spark)
    found = spark.sql("SELECT * FROM rips_bars(array(array(0D, 0D), array(1D, 0D), array(1D, 1D), array(0D, 1D)))").collect()
    assert [tuple(r) for r in found] == [(0, 0.0, 1.0)] * 3 + [(0, 0.0, INF), (1, 1.0, math.sqrt(2))]


def test_stream_of_points(spark, tmp_path):
    schema = "g long, p long, c array<double>"
    source = tmp_path / "in"
    results = []
    for k, rows in enumerate([[(0, 0, [0.0]), (0, 1, [1.0])], [(0, 2, [5.0])]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = spark.readStream.schema(schema).parquet(str(source))
        writer = diagrams_of_batches(stream, "g", "p", "c", str(tmp_path / "store"), lambda bars, n: results.append(sorted(r.death for r in bars.collect())), RipsParams(max_dim=0))
        query = writer.option("checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert results == [[1.0, INF], [1.0, 4.0, INF]]
