"""The engine's queries over the test tables and, where SQL can express them, their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import diagrams, table_functions
from skein.operators import combinadic, complexes, metric
from skein.params import RipsParams
from skein.plans.rips import MetricSpace, dealt, rips_persistence
from skein.sinks import csv_lines, interval_lines
from skein.sources import memory
from skein.storage import cut

#: Neighbours of the kNN graph; thresholds of curves; threshold of edge queries.
K = 5
THRESHOLDS = (0.9, 1.1, 1.25, 1.3)
LENGTH = 1.25
#: The 13-point triangulation of the projective plane, lower distances by rows.
PROJECTIVE_PLANE = "1 12 122 1222 11212 121212 1122122 12112222 211221111 2222211221 22222221112 222111111211".replace(" ", "")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def labels(spark: SparkSession, sf_dir: str) -> MetricSpace:
    """One dense space a label of the embeddings."""
    return memory.from_point_frame(_table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding")


def users(spark: SparkSession, sf_dir: str) -> MetricSpace:
    """One space on a line a user: the values of their events."""
    events = _table(spark, sf_dir, "events").select("user_id", "event_id", F.array(F.col("value").cast("double")).alias("at"))
    return memory.from_point_frame(events, "user_id", "event_id", "at")


def knn(spark: SparkSession, sf_dir: str) -> MetricSpace:
    """The sparse kNN graph of each label, found once."""
    space = labels(spark, sf_dir)
    return MetricSpace(space.vertices, cut(space.knn_graph(K)), "sparse")


def suppliers(spark: SparkSession, sf_dir: str) -> MetricSpace:
    """Suppliers that ship on one order, at the distance 1 / (number of such orders)."""
    lines = _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct()
    other = lines.select(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("s"))
    pairs = lines.join(other, (F.col("l_orderkey") == F.col("o")) & (F.col("l_suppkey") > F.col("s"))).groupBy("l_suppkey", "s").count()
    edges = pairs.select(F.lit(0).cast("long").alias("group_id"), F.col("l_suppkey").cast("long").alias("i"), F.col("s").cast("long").alias("j"), (1.0 / F.col("count")).alias("d"))
    vertices = _table(spark, sf_dir, "supplier").select(F.lit(0).cast("long").alias("group_id"), F.col("s_suppkey").cast("long").alias("id"))
    return memory.from_edge_frame(vertices, edges)


def _joined(column: str) -> Column:
    return F.array_join(F.transform(column, lambda v: v.cast("string")), ",")


def pairwise_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).edges


def enclosing_radius(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).enclosing_radius()


def edges_at_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels(spark, sf_dir).within(LENGTH)


def knn_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return knn(spark, sf_dir).edges


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metric.adjacency(knn(spark, sf_dir).edges)
    return out.select("group_id", "id", F.size("neighbours").cast("long").alias("degree"), F.array_join(F.transform("neighbours", lambda x: x["nbr"].cast("string")), ",").alias("neighbours"))


def supplier_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suppliers(spark, sf_dir).edges.drop("group_id")


def simplex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = knn(spark, sf_dir)
    return complexes.simplex_counts(space.vertices, space.edges, 3)


def simplex_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = knn(spark, sf_dir)
    out = complexes.simplices(space.vertices, space.edges, 2).withColumn("back", combinadic.unrank(F.col("idx"), 3))
    return out.select("group_id", "idx", "diameter", _joined("verts").alias("verts"), _joined("back").alias("unranked"))


def facets_signed(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = knn(spark, sf_dir)
    return complexes.facets(complexes.simplices(space.vertices, space.edges, 2), 2).select("group_id", "simplex_idx", "k", "sign", "facet_idx")


def boundary_squared(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = knn(spark, sf_dir)
    triangles, edges = (complexes.simplices(space.vertices, space.edges, d) for d in (2, 1))
    out = complexes.boundary_squared(triangles, edges, 2)
    return out.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_entries"), F.sum(F.abs("coefficient")).cast("long").alias("total"))


def cofacets(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = knn(spark, sf_dir)
    return complexes.cofacets(complexes.simplices(space.vertices, space.edges, 1), complexes.simplices(space.vertices, space.edges, 2), 1)


def apparent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return complexes.apparent_pairs(cofacets(spark, sf_dir))


def euler_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = knn(spark, sf_dir)
    return complexes.euler_curve(space.vertices, space.edges, 3, list(THRESHOLDS))


def h0_bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rips_persistence(users(spark, sf_dir), RipsParams(max_dim=0))


def h1_bars_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = rips_persistence(users(spark, sf_dir), RipsParams(max_dim=1))
    return bars.groupBy("group_id").agg(F.count_if(F.col("dim") == 1).alias("n_h1"))


def h0_bars_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rips_persistence(labels(spark, sf_dir), RipsParams(max_dim=0))


def betti0_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = rips_persistence(labels(spark, sf_dir), RipsParams(max_dim=0, threshold=float("inf")))
    return diagrams.betti_curve(bars, list(THRESHOLDS), 0).select("group_id", "t", "betti")


def h1_bars_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rips_persistence(labels(spark, sf_dir), RipsParams(max_dim=1))


def h2_bars_knn_mod3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rips_persistence(knn(spark, sf_dir), RipsParams(max_dim=2, modulus=3))


def h1_bars_knn_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rips_persistence(knn(spark, sf_dir), RipsParams(max_dim=1), engine="rounds")


def h1_bars_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rips_persistence(suppliers(spark, sf_dir), RipsParams(max_dim=1))


def _differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """The number of rows of either that the other lacks, repeated ones by their number; each is computed once."""
    both = a.withColumn("_n", F.lit(1)).unionAll(b.withColumn("_n", F.lit(-1)))
    left = both.groupBy(*a.columns).agg(F.abs(F.sum("_n")).alias("_n"))
    return left.agg(F.coalesce(F.sum("_n"), F.lit(0).cast("long")).alias("n_different"))


def engines_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = knn(spark, sf_dir)
    return _differences(rips_persistence(space, engine="kernel"), rips_persistence(space, engine="rounds"))


def toggles_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = knn(spark, sf_dir)
    off = RipsParams(use_apparent_pairs=False, use_clearing=False, use_emergent_pairs=False)
    return _differences(rips_persistence(space), rips_persistence(space, off))


def table_function_agrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    table_functions.register(spark)
    cloud = dealt(_table(spark, sf_dir, "embeddings"), "label").groupBy("label").agg(F.array_sort(F.collect_list(F.struct("vec_id", F.col("embedding").cast("array<double>").alias("at")))).alias("p"))
    cloud.select("label", F.transform("p", lambda x: x["at"]).alias("points")).createOrReplaceTempView("skein_clouds")
    found = spark.sql("SELECT label AS group_id, dim, birth, death FROM skein_clouds, LATERAL rips_bars(points, 0)")
    return _differences(found, h0_bars_embeddings(spark, sf_dir))


def essential_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagrams.essential(h0_bars_events(spark, sf_dir)).groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))


def longest_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return diagrams.most_persistent(h0_bars_events(spark, sf_dir), 3)


def _projective_plane(spark: SparkSession, modulus: int) -> DataFrame:
    space = memory.from_condensed(spark, [float(c) for c in PROJECTIVE_PLANE])
    return rips_persistence(space, RipsParams(max_dim=2, modulus=modulus)).groupBy("dim", "birth", "death").agg(F.count(F.lit(1)).alias("n"))


def projective_plane_mod2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projective_plane(spark, 2)


def projective_plane_mod3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _projective_plane(spark, 3)


def _square(spark: SparkSession) -> DataFrame:
    return rips_persistence(memory.from_points(spark, [[0, 0], [1, 0], [1, 1], [0, 1]]), RipsParams(max_dim=1))


def square_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return csv_lines(_square(spark)).select("line")


def square_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interval_lines(_square(spark)).select("dim", "line")


def pdist_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = memory.from_condensed(spark, memory.lower_from_upper([0.5, 0.5, 1, 10, 5, 6]))
    return rips_persistence(space, RipsParams(max_dim=0)).select("dim", "birth", "death")


def sparse_cycle(spark: SparkSession, sf_dir: str) -> DataFrame:
    space = memory.from_triplets(spark, 4, [(0, 1, 1.0), (1, 2, 1.0), (2, 3, 1.0), (0, 3, 1.0)])
    return rips_persistence(space, RipsParams(max_dim=1)).select("dim", "birth", "death")


_QUERIES = (
    pairwise_distance, enclosing_radius, edges_at_threshold, knn_graph, adjacency, supplier_pairs, simplex_counts, simplex_ranks, facets_signed,
    boundary_squared, cofacets, apparent_pairs, euler_curve, h0_bars_events, h1_bars_events, h0_bars_embeddings, betti0_curve, h1_bars_embeddings,
    h2_bars_knn_mod3, h1_bars_knn_rounds, h1_bars_suppliers, engines_agree, toggles_agree, table_function_agrees, essential_counts, longest_bars,
    projective_plane_mod2, projective_plane_mod3, square_csv, square_intervals, pdist_layout, sparse_cycle,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _QUERIES}


_PAIRS = """p AS (SELECT label AS group_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS id, CAST(embedding AS DOUBLE[]) AS c FROM embeddings),
g AS (SELECT a.group_id, a.id AS u, b.id AS v, list_transform(list_zip(a.c, b.c), lambda t: abs(t[1] - t[2])) AS x FROM p a JOIN p b ON a.group_id = b.group_id AND b.id < a.id),
m AS (SELECT group_id, u, v, x, list_max(x) AS m FROM g),
pairs AS (SELECT group_id, u, v, CASE WHEN m = 0 THEN 0.0::DOUBLE ELSE m * sqrt(list_reduce(list_transform(x, lambda t: (t / m) * (t / m)), lambda s, t: s + t)) END AS d FROM m)"""
_KNN = f"""{_PAIRS},
ends AS (SELECT group_id, u AS i, v AS j, d FROM pairs UNION ALL SELECT group_id, v, u, d FROM pairs),
near AS (SELECT group_id, i, j, d, row_number() OVER (PARTITION BY group_id, i ORDER BY d, j) AS r FROM ends),
e AS (SELECT DISTINCT group_id, greatest(i, j) AS u, least(i, j) AS v, d FROM near WHERE r <= {K})"""
_TRIANGLES = f"""{_KNN},
edge AS (SELECT group_id, v AS a, u AS b, d, u * (u - 1) // 2 + v AS idx FROM e),
tri AS (SELECT x.group_id, x.a, x.b, y.b AS c, greatest(x.d, y.d, z.d) AS d, x.a + x.b * (x.b - 1) // 2 + y.b * (y.b - 1) * (y.b - 2) // 6 AS idx
    FROM edge x JOIN edge y ON x.group_id = y.group_id AND x.b = y.a JOIN edge z ON x.group_id = z.group_id AND x.a = z.a AND y.b = z.b),
face AS (
    SELECT group_id, idx, d, 0 AS k, b AS p, c AS q FROM tri UNION ALL SELECT group_id, idx, d, 1, a, c FROM tri UNION ALL SELECT group_id, idx, d, 2, a, b FROM tri),
cof AS (SELECT face.group_id, edge.idx, edge.d AS diameter, face.idx AS cofacet_idx, face.d AS cofacet_diameter, face.k FROM face JOIN edge ON face.group_id = edge.group_id AND face.p = edge.a AND face.q = edge.b)"""
_TETRA = f"""{_TRIANGLES},
tet AS (SELECT t.group_id, greatest(t.d, x.d, y.d, z.d) AS d FROM tri t JOIN edge x ON x.group_id = t.group_id AND x.a = t.c
    JOIN edge y ON y.group_id = t.group_id AND y.a = t.a AND y.b = x.b JOIN edge z ON z.group_id = t.group_id AND z.a = t.b AND z.b = x.b)"""
_T = ", ".join(f"({t}::DOUBLE)" for t in THRESHOLDS)
_GAPS = """gaps AS (SELECT user_id AS group_id, CAST(value AS DOUBLE) - lag(CAST(value AS DOUBLE)) OVER (PARTITION BY user_id ORDER BY value) AS death FROM events)"""
_ESSENTIAL = "0.0::DOUBLE AS birth, 'inf'::DOUBLE AS death"


def oracle_sql() -> dict[str, str]:
    return {
        "pairwise_distance": f"WITH {_PAIRS} SELECT group_id, u, v, d FROM pairs",
        "enclosing_radius": f"""WITH {_PAIRS}, ends AS (SELECT group_id, u AS i, d FROM pairs UNION ALL SELECT group_id, v, d FROM pairs),
            far AS (SELECT group_id, i, max(d) AS f FROM ends GROUP BY 1, 2)
            SELECT n.group_id, coalesce(f, 0.0) AS radius FROM (SELECT DISTINCT group_id FROM p) n LEFT JOIN (SELECT group_id, min(f) AS f FROM far GROUP BY 1) USING (group_id)""",
        "edges_at_threshold": f"WITH {_PAIRS} SELECT group_id, u, v, d FROM pairs WHERE d <= {LENGTH}",
        "knn_graph": f"WITH {_KNN} SELECT group_id, u, v, d FROM e",
        "adjacency": f"""WITH {_KNN}, b AS (SELECT group_id, u AS id, v AS n FROM e UNION ALL SELECT group_id, v, u FROM e)
            SELECT group_id, id, count(*) AS degree, string_agg(CAST(n AS VARCHAR), ',' ORDER BY n) AS neighbours FROM b GROUP BY 1, 2""",
        "supplier_pairs": """WITH l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS s FROM lineitem)
            SELECT CAST(a.s AS BIGINT) AS u, CAST(b.s AS BIGINT) AS v, 1.0::DOUBLE / count(*) AS d FROM l a JOIN l b ON a.o = b.o AND a.s > b.s GROUP BY 1, 2""",
        "simplex_counts": f"""WITH {_TETRA} SELECT group_id, 0 AS dim, count(*) AS n_simplices FROM p GROUP BY 1 UNION ALL SELECT group_id, 1, count(*) FROM edge GROUP BY 1
            UNION ALL SELECT group_id, 2, count(*) FROM tri GROUP BY 1 UNION ALL SELECT group_id, 3, count(*) FROM tet GROUP BY 1""",
        "simplex_ranks": f"WITH {_TRIANGLES} SELECT group_id, idx, d AS diameter, concat_ws(',', a, b, c) AS verts, concat_ws(',', a, b, c) AS unranked FROM tri",
        "facets_signed": f"WITH {_TRIANGLES} SELECT group_id, idx AS simplex_idx, k, CASE WHEN k = 1 THEN -1 ELSE 1 END AS sign, q * (q - 1) // 2 + p AS facet_idx FROM face",
        "boundary_squared": f"WITH {_TRIANGLES} SELECT group_id, 3 * count(*) AS n_entries, CAST(0 AS BIGINT) AS total FROM tri GROUP BY 1",
        "cofacets": f"WITH {_TRIANGLES} SELECT group_id, idx, diameter, cofacet_idx, cofacet_diameter, k FROM cof",
        "apparent_pairs": f"""WITH {_TRIANGLES}, even AS (SELECT * FROM cof WHERE diameter = cofacet_diameter),
            f AS (SELECT group_id, cofacet_idx, min(idx) AS idx FROM even GROUP BY 1, 2), l AS (SELECT group_id, idx, diameter, max(cofacet_idx) AS cofacet_idx FROM even GROUP BY 1, 2, 3)
            SELECT group_id, idx, cofacet_idx, diameter FROM f JOIN l USING (group_id, idx, cofacet_idx)""",
        "euler_curve": f"""WITH {_TETRA}, s AS (SELECT group_id, 0.0 AS d, 1 AS sign FROM p UNION ALL SELECT group_id, d, -1 FROM edge UNION ALL SELECT group_id, d, 1 FROM tri UNION ALL SELECT group_id, d, -1 FROM tet),
            t AS (SELECT * FROM (VALUES {_T}) AS x(t)) SELECT group_id, t, CAST(sum(CASE WHEN d <= t THEN sign ELSE 0 END) AS BIGINT) AS euler FROM s, t GROUP BY 1, 2""",
        "h0_bars_events": f"WITH {_GAPS} SELECT group_id, 0 AS dim, 0.0::DOUBLE AS birth, death FROM gaps WHERE death > 0 UNION ALL SELECT DISTINCT user_id, 0, {_ESSENTIAL} FROM events",
        "h1_bars_events": "SELECT DISTINCT user_id AS group_id, CAST(0 AS BIGINT) AS n_h1 FROM events",
        "betti0_curve": f"""WITH RECURSIVE {_PAIRS}, t AS (SELECT * FROM (VALUES {_T}) AS x(t)),
            r AS (SELECT group_id, t, id AS a, id AS b FROM p, t UNION SELECT r.group_id, r.t, r.a, q.b FROM r JOIN (
                SELECT group_id, u AS a, v AS b, d FROM pairs UNION ALL SELECT group_id, v, u, d FROM pairs) q ON q.group_id = r.group_id AND q.a = r.b AND q.d <= r.t)
            SELECT group_id, t, count(DISTINCT root) AS betti FROM (SELECT group_id, t, a, min(b) AS root FROM r GROUP BY 1, 2, 3) GROUP BY 1, 2""",
        "engines_agree": "SELECT CAST(0 AS BIGINT) AS n_different",
        "toggles_agree": "SELECT CAST(0 AS BIGINT) AS n_different",
        "table_function_agrees": "SELECT CAST(0 AS BIGINT) AS n_different",
        "essential_counts": "SELECT user_id AS group_id, CAST(1 AS BIGINT) AS n FROM events GROUP BY 1",
        "longest_bars": f"""WITH {_GAPS}, r AS (SELECT group_id, death, row_number() OVER (PARTITION BY group_id ORDER BY death DESC) AS place FROM gaps WHERE death > 0)
            SELECT group_id, 0 AS dim, 0.0::DOUBLE AS birth, death, death AS persistence, place FROM r WHERE place <= 3""",
        "projective_plane_mod2": f"""SELECT 0 AS dim, 0.0::DOUBLE AS birth, 1.0::DOUBLE AS death, CAST(12 AS BIGINT) AS n UNION ALL SELECT 0, {_ESSENTIAL}, 1
            UNION ALL SELECT 1, 1.0, 2.0, 1 UNION ALL SELECT 2, 1.0, 2.0, 1""",
        "projective_plane_mod3": f"SELECT 0 AS dim, 0.0::DOUBLE AS birth, 1.0::DOUBLE AS death, CAST(12 AS BIGINT) AS n UNION ALL SELECT 0, {_ESSENTIAL}, 1",
        "square_csv": "SELECT unnest(['0,0,1', '0,0,1', '0,0,1', '0,0,inf', '1,1,1.4142135623730951']) AS line",
        "square_intervals": "SELECT unnest([0, 0, 0, 0, 1]) AS dim, unnest([' [0,1)', ' [0,1)', ' [0,1)', ' [0, )', ' [1,1.4142135623730951)']) AS line",
        "pdist_layout": f"SELECT 0 AS dim, 0.0::DOUBLE AS birth, unnest([0.5, 0.5, 1.0])::DOUBLE AS death UNION ALL SELECT 0, {_ESSENTIAL}",
        "sparse_cycle": f"SELECT 0 AS dim, 0.0::DOUBLE AS birth, unnest([1.0, 1.0, 1.0])::DOUBLE AS death UNION ALL SELECT 0, {_ESSENTIAL} UNION ALL SELECT 1, 1.0, 'inf'::DOUBLE",
    }
