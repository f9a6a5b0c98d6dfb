"""The one query: diagrams of Vietoris-Rips filtrations, one a group."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from skein.operators.metric import INF, enclosing_radius, enclosing_radius_points, knn_graph, knn_points, within, within_points
from skein.params import InvalidInput, RipsParams, checked_dim
from skein.plans.clouds import cloud_bars
from skein.plans.kernel import point_bars, rips_bars
from skein.plans.rounds import rips_rounds
from skein.storage import cut

#: Largest group that one task takes, by points, by edges in the complex and by what its simplices of the highest
#: dimension may come to; larger ones are reduced in rounds.
KERNEL_POINTS, KERNEL_EDGES, KERNEL_SIMPLICES = 3000, 5_000_000, 40_000_000
#: Groups of more edges than this are taken apart into connected parts, which have the same bars together; edges of which
#: one task looks for parts at first.
PART_EDGES, LOOK_EDGES = 1 << 20, 1 << 19
#: Least number of partitions that groups are dealt to.
LEAST_TASKS = 32
#: Largest group of points of which one task finds dimension 0 alone.
FOREST_POINTS = 1 << 14
#: Largest group of points of which one task looks for dimensions 0 and 1 among its shortest pairs, and partitions that such
#: groups are dealt to, so that hardly any two are in one.
CLOUD_POINTS, CLOUD_TASKS = 1 << 14, 256


@dataclass(frozen=True)
class MetricSpace:
    """Spaces by group: vertices (group_id, id from 0 on) and edges (group_id, u, v, d) with v < u. Of a dense space
    all pairs are edges, of a sparse one those listed; other pairs are infinitely far."""

    vertices: DataFrame
    edges: DataFrame
    kind: str = "dense"
    #: Of spaces of points: group_id, id and coords, from which one task can get its group's distances.
    points: DataFrame | None = None
    #: Whether all points are known to have one coordinate.
    line: bool = False

    def n(self) -> DataFrame:
        return self.vertices.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))

    def num_edges(self) -> DataFrame:
        return self.edges.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_edges"))

    def enclosing_radius(self) -> DataFrame:
        return enclosing_radius(self.vertices, self.edges) if self.points is None else enclosing_radius_points(self.points)

    def within(self, threshold: float) -> DataFrame:
        """The finite edges up to a threshold."""
        return within(self.edges, threshold) if self.points is None else within_points(self.points, threshold)

    def knn_graph(self, k: int) -> DataFrame:
        return knn_graph(self.edges, k) if self.points is None else knn_points(self.points, k)

    def in_complex(self, threshold: float | None) -> DataFrame:
        """The edges up to the threshold; by default up to each dense group's enclosing radius, or all listed ones."""
        if threshold is not None or self.kind == "sparse":
            return within(self.edges, INF if threshold is None else threshold)
        radius = self.enclosing_radius().withColumnRenamed("group_id", "_g")
        met = self.edges.join(radius, F.col("group_id").eqNullSafe(F.col("_g")))
        return within(met, F.col("radius")).select("group_id", "u", "v", "d")


def rips_persistence(space: MetricSpace, params: RipsParams | None = None, engine: str = "auto") -> DataFrame:
    """Bars (group_id, dim, birth, death) of dimensions 0 to max_dim; essential ones die at infinity, bars of length
    zero are left out, equal bars are repeated. Groups that one task can take go to the kernel, others to the
    distributed rounds; `engine` fixes one of "kernel" and "rounds". A space without points has no bars."""
    params = (params or RipsParams()).validate()
    if engine not in ("auto", "kernel", "rounds"):
        raise InvalidInput(f"engine must be auto, kernel or rounds, got {engine}")
    sizes = space.n()
    largest = sizes.agg(F.max("n")).first()[0] or 0
    top = checked_dim(largest, params.max_dim, params.modulus)
    if engine == "rounds":
        return _rounds(space, top, params)
    if engine == "auto" and space.line and top == 0:
        return _gaps(space.points, params.threshold)
    most = _most_points(top)
    if space.points is not None:
        if engine == "kernel" or largest <= most:
            return _point_kernel(space.points, top, params)
        large = sizes.where(F.col("n") > most).select(F.col("group_id").alias("_h"))
        small = _point_kernel(_of(space.points, large, "left_anti"), top, params)
        if engine == "auto" and top == 1 and params.threshold is None and params.modulus == 2 and all(_toggles(params).values()):
            found = cut(_clouds(_of(space.points, sizes.where((F.col("n") > most) & (F.col("n") <= CLOUD_POINTS)).select(F.col("group_id").alias("_h")), "left_semi")))
            left = sizes.where(F.col("n") > CLOUD_POINTS).select("group_id").unionByName(found.where("dim < 0").select("group_id"))
            small, large = small.unionByName(found.where("dim >= 0")), cut(left.withColumnRenamed("group_id", "_h"))
            if not large.limit(1).count():
                return small
    else:
        edges = space.in_complex(params.threshold)
        if engine == "kernel" or largest <= min(most, KERNEL_POINTS, _points_of_edges(PART_EDGES)):
            return _kernel(space.vertices, edges, top, params)
        count = edges.groupBy("group_id").agg(F.count(F.lit(1)).alias("n_edges")).withColumnRenamed("group_id", "_g")
        sized = cut(sizes.join(count, F.col("group_id").eqNullSafe(F.col("_g")), "left").drop("_g"))
        vertices, wide = space.vertices, sized.where(F.col("n_edges") > PART_EDGES)
        if wide.limit(1).count():
            vertices, edges = _in_parts(vertices, edges, wide)
            sized = _both(vertices, edges).groupBy("group_id", "part").agg(F.count_if(F.col("d").isNull()).alias("n"), F.count("d").alias("n_edges"))
        # m edges have at most (2 m) ** (k / 2) / k! cliques of k vertices.
        cliques = F.pow(2.0 * F.col("n_edges"), F.lit((top + 1) / 2)) / math.factorial(top + 1)
        # Of sparse groups a task keeps lists of neighbours.
        points = KERNEL_POINTS if space.kind == "dense" else KERNEL_EDGES
        large = cut(sized.where((F.col("n") > points) | (F.col("n_edges") > KERNEL_EDGES) | (cliques > KERNEL_SIMPLICES)).select(F.col("group_id").alias("_h")).distinct())
        if not large.limit(1).count():
            return _kernel(vertices, edges, top, params)
        small = _kernel(_of(vertices, large, "left_anti"), _of(edges, large, "left_anti"), top, params)
    points = None if space.points is None else _of(space.points, large, "left_semi")
    rest = MetricSpace(_of(space.vertices, large, "left_semi"), _of(space.edges, large, "left_semi"), space.kind, points)
    return small.unionByName(_rounds(rest, top, params))


def _most_points(top: int) -> int:
    """Points that one task takes, by the simplices of the highest dimension (of two vertices or more) among them."""
    n = KERNEL_POINTS if top else FOREST_POINTS
    while top > 1 and n > 2 and math.comb(n, top + 1) > KERNEL_SIMPLICES:
        n -= max(1, n // 64)
    return n


def _points_of_edges(edges: int) -> int:
    return (1 + math.isqrt(1 + 8 * edges)) // 2


def _in_parts(vertices: DataFrame, edges: DataFrame, wide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Vertices and edges with a further column part: in wide groups (group_id, n_edges) the smallest point that edges connect
    one with, else -1."""
    edges, wide = cut(edges), wide.select(F.col("group_id").alias("_h"), "n_edges")
    kind = vertices.schema["group_id"].dataType.simpleString()

    def tied(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found, at = np.unique(rows[["u", "v"]].to_numpy().ravel(), return_inverse=True)
        root = least_of_part(len(found), at[::2], at[1::2])
        return pd.DataFrame({"group_id": [key[0]] * len(found), "u": found, "v": found[root]})

    schema = f"group_id {kind}, u long, v long"
    slices = F.pmod(F.xxhash64("u"), F.ceil(F.col("n_edges") / LOOK_EDGES))
    some = edges.join(wide, F.col("group_id").eqNullSafe(F.col("_h"))).select("group_id", "u", "v", slices.alias("slice"))
    some = some.groupBy("group_id", "slice").applyInPandas(tied, schema)
    roots = cut(some.groupBy("group_id").applyInPandas(tied, schema).select(F.col("group_id").alias("_g"), F.col("u").alias("_u"), F.col("v").alias("_root")))

    def named(df: DataFrame, end: str, own: object) -> DataFrame:
        met = df.join(wide.select("_h"), F.col("group_id").eqNullSafe(F.col("_h")), "left").join(roots, F.col("group_id").eqNullSafe(F.col("_g")) & (F.col(end) == F.col("_u")), "left")
        return met.select(*df.columns, F.coalesce("_root", own).alias("part"))

    # A point of a wide group without edges is a part of its own.
    points = vertices.join(wide.select("_h").withColumn("_in", F.lit(True)), F.col("group_id").eqNullSafe(F.col("_h")), "left")
    points = points.withColumn("_own", F.when(F.col("_in"), F.col("id")).otherwise(F.lit(-1).cast("long"))).select(*vertices.columns, "_own")
    return named(points, "id", F.col("_own")).drop("_own"), named(edges, "u", F.lit(-1).cast("long"))


def least_of_part(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n points the smallest one that edges u, v connect it with."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _of(df: DataFrame, groups: DataFrame, how: str) -> DataFrame:
    """The rows whose group is, or is not, among the groups (_h)."""
    return df.join(groups, F.col("group_id").eqNullSafe(F.col("_h")), how)


def dealt(df: DataFrame, *group: str) -> DataFrame:
    """df dealt to tasks by group. A group's work is not in proportion to its bytes, by which Spark would put small
    partitions together again."""
    return df.repartition(max(LEAST_TASKS, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))), *group)


def _frame(key: object, bars: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(sorted(bars), columns=["dim", "birth", "death"]).astype({"dim": "int32", "birth": "float64", "death": "float64"})
    out.insert(0, "group_id", [key] * len(out))
    return out


def _gaps(points: DataFrame, threshold: float | None) -> DataFrame:
    """Bars of dimension 0 of points on a line, of any number of them: a group's points in their order, each with the gap to
    the one before it. The first point, and each behind a gap that is too long, has an essential bar."""
    rows = points.select("group_id", F.element_at("coords", 1).alias("at"))
    gap = F.col("at") - F.lag("at").over(Window.partitionBy("group_id").orderBy("at"))
    limit = F.lit(INF if threshold is None else float(threshold))
    death = F.when(F.col("gap") <= limit, F.col("gap")).otherwise(F.lit(INF))
    bars = rows.select("group_id", gap.alias("gap")).select("group_id", F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), death.alias("death"))
    return bars.where("death > 0")


def _point_kernel(points: DataFrame, top: int, params: RipsParams) -> DataFrame:
    """Only the points are dealt to tasks, not their pairs."""
    threshold, modulus, toggles = params.threshold, params.modulus, _toggles(params)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        coords = np.array(rows["coords"].tolist(), np.float64).reshape(len(rows), -1)
        return _frame(key[0], point_bars(coords, min(top, len(rows) - 1), threshold, modulus, **toggles))

    kind = points.schema["group_id"].dataType.simpleString()
    return dealt(points, "group_id").groupBy("group_id").applyInPandas(run, f"group_id {kind}, dim int, birth double, death double")


def _clouds(points: DataFrame) -> DataFrame:
    """Bars of dimensions 0 and 1 over Z/2 of groups of many points; one row of dimension -1 of a group that needs the rounds."""

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id")
        bars = cloud_bars(np.array(rows["coords"].tolist(), np.float64).reshape(len(rows), -1))
        return _frame(key[0], [(-1, 0.0, 0.0)] if bars is None else bars)

    kind = points.schema["group_id"].dataType.simpleString()
    return points.repartition(CLOUD_TASKS, "group_id").groupBy("group_id").applyInPandas(run, f"group_id {kind}, dim int, birth double, death double")


def _toggles(params: RipsParams) -> dict[str, bool]:
    return {"apparent_pairs": params.use_apparent_pairs, "clearing": params.use_clearing, "emergent": params.use_emergent_pairs}


def _rounds(space: MetricSpace, top: int, params: RipsParams) -> DataFrame:
    edges = space.in_complex(params.threshold) if space.points is None else None
    return rips_rounds(space.vertices, None if edges is None else cut(edges), space.points, top, params.threshold, params.modulus, *_toggles(params).values(), params.threads)


def _both(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """Points (u = v, without d) and edges of groups."""
    more = [c for c in vertices.columns if c == "part"]
    points = vertices.select("group_id", *more, F.col("id").alias("u"), F.col("id").alias("v"), F.lit(None).cast("double").alias("d"))
    return points.unionByName(edges.select("group_id", *more, "u", "v", "d"))


def _kernel(vertices: DataFrame, edges: DataFrame, top: int, params: RipsParams) -> DataFrame:
    """Bars of groups, each of which one task takes, or of their parts (a column part)."""
    modulus, toggles = params.modulus, _toggles(params)

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        point = rows["d"].isna().to_numpy()
        ids, pairs = np.sort(rows["u"].to_numpy()[point]), rows[~point]
        u, v = (np.searchsorted(ids, pairs[c].to_numpy()) for c in ("u", "v"))
        return _frame(key[0], rips_bars(len(ids), u, v, pairs["d"].to_numpy(), min(top, max(len(ids) - 1, 0)), modulus, **toggles))

    kind = vertices.schema["group_id"].dataType.simpleString()
    rows = _both(vertices, edges)
    by = [c for c in rows.columns if c in ("group_id", "part")]
    return dealt(rows, *by).groupBy(*by).applyInPandas(run, f"group_id {kind}, dim int, birth double, death double")
