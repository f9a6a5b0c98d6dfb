"""Distances: pairs of points, thresholds, the enclosing radius, and k-nearest-neighbour graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.plans.kernel import point_distances

INF = float("inf")
#: Points of a block, distances that are computed at once, and bytes of an Arrow batch of pairs of blocks.
BLOCK, TILE, BATCH_BYTES = 2048, 1 << 16, 16 << 20
#: Least number of partitions that pairs of blocks are dealt to.
LEAST_TASKS = 32

_EDGE = [T.StructField("u", T.LongType()), T.StructField("v", T.LongType()), T.StructField("d", T.DoubleType())]


def euclidean(a: Column, b: Column) -> Column:
    """Scaled two-norm of a - b, m * sqrt(sum(((x - y) / m) ** 2)) with m the largest |x - y|, summed from the left:
    no overflow or underflow on the way, and the same bits on every engine that folds in order. Points without
    coordinates are at distance 0; a difference that overflows makes the distance infinite."""
    # Each step is bound by a lambda, so that it is computed once a pair and not once a coordinate.
    once = lambda value, f: F.element_at(F.transform(F.array(value), f), 1)

    def norm(gaps: Column) -> Column:
        return once(F.coalesce(F.array_max(gaps), F.lit(0.0)), lambda m: F.when((m == 0) | (m == INF), m).otherwise(m * F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + (g / m) * (g / m)))))

    return once(F.zip_with(a, b, lambda x, y: F.abs(x - y)), norm)


def _pairs_of_blocks(points: DataFrame, run, schema: list[T.StructField]) -> DataFrame:
    """group_id and what run(ids, coords, other ids, other coords, same) gives, as tuples of arrays, for each two
    blocks of BLOCK points of a group, a block and itself included. Pairs of blocks are dealt to tasks one by one."""
    spark = points.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    rows = points.groupBy("group_id", F.call_function("div", F.col("id"), F.lit(BLOCK).cast("long")).alias("at")).agg(F.array_sort(F.collect_list(F.struct("id", "coords"))).alias("p"))
    a = rows.select("group_id", "at", F.col("p.id").alias("i"), F.flatten("p.coords").alias("x"))
    b = rows.select(F.col("group_id").alias("_g"), F.col("at").alias("to"), F.col("p.id").alias("j"), F.flatten("p.coords").alias("y"))
    met = a.join(b, F.col("group_id").eqNullSafe(F.col("_g")) & (F.col("to") <= F.col("at"))).drop("_g")
    met = met.repartition(max(LEAST_TASKS, int(spark.conf.get("spark.sql.shuffle.partitions"))), "group_id", "at", "to")
    schema = T.StructType([points.schema["group_id"], *schema])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                group, at, to, i, x, j, y = (batch.column(c)[k] for c in ("group_id", "at", "to", "i", "x", "j", "y"))
                i, x, j, y = (c.values.to_numpy(zero_copy_only=False) for c in (i, x, j, y))
                for found in run(i, x.reshape(len(i), -1), j, y.reshape(len(j), -1), at.as_py() == to.as_py()):
                    if len(found[0]):
                        yield pa.RecordBatch.from_arrays([pa.array([group.as_py()], group.type).take(pa.array(np.zeros(len(found[0]), np.int32))), *map(pa.array, found)], names=schema.names)

    return met.mapInArrow(whole, schema)


def _rough(a: np.ndarray, b: np.ndarray, kind: type = np.float64) -> tuple[np.ndarray, float, bool]:
    """The squares of all distances by a matrix product in numbers of a kind, how far they are from those of exact distances
    at most, and True; of points whose squares might not be in that kind's range the distances themselves, 0 and False."""
    most = max(np.abs(a).max(initial=0.0), np.abs(b).max(initial=0.0))
    far, unit = (1e100, 1e-12) if kind is np.float64 else (1e12, 2.5e-7)
    if not 1 / far < most < far:
        return _rough(a, b) if kind is not np.float64 else (point_distances(a, b), 0.0, False)
    aa, bb = (a * a).sum(1), (b * b).sum(1)
    found = a.astype(kind) @ b.astype(kind).T
    found *= -2
    found += aa.astype(kind)[:, None]
    found += bb.astype(kind)[None, :]
    return found, unit * (a.shape[1] + 10) * float(aa.max() + bb.max()), True


def _lowest(rough: np.ndarray, slack: float, k: int, by: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row (by = 0) or column (1) of a matrix the places that may hold its k least values but one, if each value is
    off by up to `slack`: rows or columns, and places in them."""
    own, width = rough if by == 0 else rough.T, max(64, 4 * (k + 1))
    # Each strip's least values bound the k-th of all from above.
    least = own[:, :width].copy(order="K")
    for at in range(width, own.shape[1], width):
        strip = own[:, at : at + width]
        np.minimum(least[:, : strip.shape[1]], strip, out=least[:, : strip.shape[1]])
    at = min(k, least.shape[1] - 1)
    limit = (np.partition(least, at, 1)[:, at] + 2.0 * slack).astype(rough.dtype)
    limit = np.nextafter(limit, rough.dtype.type(INF))
    found = np.divmod(np.flatnonzero(rough <= (limit[:, None] if by == 0 else limit[None, :])), rough.shape[1])
    return found[by], found[1 - by]


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The distances of pairs of points, a few at a time."""
    origin, out = np.zeros((1, a.shape[1])), np.empty(len(i))
    for k in range(0, len(i), TILE):
        out[k : k + TILE] = point_distances(np.asfortranarray(np.abs(a[i[k : k + TILE]] - b[j[k : k + TILE]])), origin)[:, 0]
    return out


def _edge(i: np.ndarray, j: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
    return np.maximum(i, j), np.minimum(i, j), d


def pairwise(points: DataFrame) -> DataFrame:
    """Edges (group_id, u, v, d) with v < u of points (group_id, id, coords), by pairs of blocks of a group."""

    def run(i, x, j, y, same):
        step, y = max(1, TILE // len(j)), np.asfortranarray(y)  # coordinate by coordinate
        for k in range(0, len(i), step):
            d = point_distances(x[k : k + step], y)
            left = np.nonzero(i[k : k + step, None] > j) if same else tuple(c.ravel() for c in np.indices(d.shape))
            yield _edge(i[k : k + step][left[0]], j[left[1]], d[left])

    return _pairs_of_blocks(points, run, _EDGE)


def within_points(points: DataFrame, threshold: float) -> DataFrame:
    """The edges of pairwise() that are finite and not longer than the threshold. Pairs that a matrix product shows to be
    longer are not looked at again."""

    def run(i, x, j, y, same):
        rough, slack, squared = _rough(x, y)
        if squared and 0 <= threshold < 1e100:
            a, b = np.nonzero(rough <= threshold * threshold + 2 * slack)
        else:
            a, b = (c.ravel() for c in np.indices(rough.shape))
        if same:
            a, b = a[i[a] > j[b]], b[i[a] > j[b]]
        for k in range(0, len(a), TILE):
            d = _exact(x, y, a[k : k + TILE], b[k : k + TILE])
            near = (d <= threshold) & (d < INF)
            yield _edge(i[a[k : k + TILE][near]], j[b[k : k + TILE][near]], d[near])

    return _pairs_of_blocks(points, run, _EDGE)


def enclosing_radius_points(points: DataFrame) -> DataFrame:
    """enclosing_radius() of all pairs of points."""

    def farthest(i, x, y, rough, slack):
        a, b = np.nonzero(rough >= rough.max(1)[:, None] - 2 * slack)
        far = np.zeros(len(i))
        for k in range(0, len(a), TILE):
            np.maximum.at(far, a[k : k + TILE], _exact(x, y, a[k : k + TILE], b[k : k + TILE]))
        return i, far

    def run(i, x, j, y, same):
        rough, slack, _ = _rough(x, y)
        yield farthest(i, x, y, rough, slack)
        if not same:
            yield farthest(j, y, x, rough.T, slack)

    reach = _pairs_of_blocks(points, run, [T.StructField("id", T.LongType()), T.StructField("far", T.DoubleType())])
    return reach.groupBy("group_id", "id").agg(F.max("far").alias("far")).groupBy("group_id").agg(F.min("far").alias("radius"))


def knn_points(points: DataFrame, k: int) -> DataFrame:
    """knn_graph() of all pairs of points. Of each two blocks a point keeps its k nearest in the other; these are then
    ranked over all blocks of its group."""

    def nearest(i, x, j, y, a, b):
        a, b = a[i[a] != j[b]], b[i[a] != j[b]]
        d = _exact(x, y, a, b)
        order = np.lexsort((j[b], d, a))
        a, b, d = a[order], b[order], d[order]
        first = np.arange(len(a)) - np.searchsorted(a, a) < k
        return i[a[first]], j[b[first]], d[first]

    def run(i, x, j, y, same):
        # a point itself is among its k + 1 nearest if the blocks are one
        sides = range(1 if same else 2)
        rough, slack, _ = _rough(x, y, np.float32)
        found = [_lowest(rough, slack, k, by) for by in sides]
        if rough.dtype == np.float32 and sum(len(f[0]) for f in found) > 4 * (k + 1) * (len(i) + len(j)):
            rough, slack, _ = _rough(x, y)
            found = [_lowest(rough, slack, k, by) for by in sides]
        yield nearest(i, x, j, y, *found[0])
        if not same:
            yield nearest(j, y, i, x, *found[1])

    ends = _pairs_of_blocks(points, run, [T.StructField("i", T.LongType()), T.StructField("j", T.LongType()), T.StructField("d", T.DoubleType())])
    return _nearest(ends.select("group_id", F.greatest("i", "j").alias("u"), F.least("i", "j").alias("v"), "d", "i", "j"), k)


def within(edges: DataFrame, threshold: float | Column) -> DataFrame:
    """Edges in the complex: finite and not longer than the threshold."""
    return edges.where((F.col("d") <= threshold) & (F.col("d") < INF) & ~F.isnan("d"))


def enclosing_radius(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """group_id and radius: the least over points of the largest distance from the point; 0 below two points. Pairs
    that are not among the edges are infinitely far."""
    n = vertices.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    ends = edges.select("group_id", F.inline(F.array(F.struct(F.col("u").alias("id"), "d"), F.struct(F.col("v").alias("id"), "d"))))
    reach = ends.groupBy("group_id", "id").agg(F.max("d").alias("far"), F.count(F.lit(1)).alias("met"))
    far = reach.groupBy("group_id", "met").agg(F.min("far").alias("far"))
    own = far.withColumnRenamed("group_id", "_g")
    best = n.join(own, F.col("group_id").eqNullSafe(F.col("_g")) & (F.col("met") == F.col("n") - 1), "left").groupBy("group_id").agg(F.max("n").alias("n"), F.min("far").alias("far"))
    return best.select("group_id", F.when(F.col("n") < 2, 0.0).otherwise(F.coalesce("far", F.lit(INF))).alias("radius"))


def knn_graph(edges: DataFrame, k: int) -> DataFrame:
    """The edges of which one end ranks the other among its k nearest (ties by the smaller identifier)."""
    ends = edges.select("group_id", "u", "v", "d", F.inline(F.array(F.struct(F.col("u").alias("i"), F.col("v").alias("j")), F.struct(F.col("v").alias("i"), F.col("u").alias("j")))))
    return _nearest(ends, k)


def _nearest(ends: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("group_id", "i").orderBy("d", "j"))
    return ends.withColumn("_r", rank).where(F.col("_r") <= k).select("group_id", "u", "v", "d").distinct()


def adjacency(edges: DataFrame) -> DataFrame:
    """group_id, id and neighbours: each vertex's neighbours with distances, by identifier."""
    ends = edges.select("group_id", F.inline(F.array(F.struct(F.col("u").alias("id"), F.struct(F.col("v").alias("nbr"), "d").alias("x")), F.struct(F.col("v").alias("id"), F.struct(F.col("u").alias("nbr"), "d").alias("x")))))
    return ends.groupBy("group_id", "id").agg(F.array_sort(F.collect_list("x")).alias("neighbours"))


def distances_of(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """pairs (group_id, i, j) with column d: symmetric, 0 on the diagonal, infinite where there is no edge."""
    keyed = pairs.withColumns({"u": F.greatest("i", "j"), "v": F.least("i", "j")})
    found = keyed.join(edges, ["group_id", "u", "v"], "left")
    return found.select("group_id", "i", "j", F.when(F.col("i") == F.col("j"), 0.0).otherwise(F.coalesce("d", F.lit(INF))).alias("d"))
