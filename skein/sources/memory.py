"""Spaces from Python lists and from frames."""

from __future__ import annotations

import math
import random
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from skein.operators.metric import pairwise
from skein.params import InvalidDistance, InvalidInput, rust_float
from skein.plans.rips import MetricSpace
from skein.schema import EDGES, VERTICES, keyed
from skein.storage import cut, discard

#: The group of a space that is given alone.
ALONE = 0
_LONG = T.LongType()


def _space(spark: SparkSession, n: int, edges: DataFrame | list[tuple], kind: str) -> MetricSpace:
    vertices = spark.range(n).select(F.lit(ALONE).cast("long").alias("group_id"), "id")
    if isinstance(edges, list):
        edges = spark.createDataFrame(edges, keyed(EDGES, _LONG))
    return MetricSpace(vertices, edges, kind)


def check_points(rows: Sequence[Sequence[float]]) -> None:
    for k, row in enumerate(rows):
        if len(row) != len(rows[0]):
            raise InvalidInput(f"point {k} has {len(row)} coordinates, expected {len(rows[0])}")
        for x in row:
            if not math.isfinite(x):
                raise InvalidInput(f"point {k} has a non-finite coordinate {rust_float(x)}")


def from_points(spark: SparkSession, points: Sequence[Sequence[float]]) -> MetricSpace:
    """A dense space of points with finite coordinates, all of one dimension (0 is allowed). No points: no space."""
    rows = [[float(x) for x in p] for p in points]
    check_points(rows)
    frame = spark.createDataFrame([(ALONE, k, row) for k, row in enumerate(rows)], T.StructType([*keyed(VERTICES, _LONG).fields, T.StructField("coords", T.ArrayType(T.DoubleType(), False))]))
    return MetricSpace(frame.select("group_id", "id"), pairwise(frame), "dense", frame)


def size_of_condensed(m: int) -> int:
    n = (1 + math.isqrt(1 + 8 * m)) // 2
    if n * (n - 1) // 2 != m:
        raise InvalidInput(f"condensed length {m} is not n(n-1)/2 for any n")
    return n


def check_distance(k: int, d: float) -> float:
    if math.isnan(d):
        raise InvalidDistance(f"NaN at condensed index {k}")
    if d < 0:
        raise InvalidDistance(f"negative entry {rust_float(d)} at condensed index {k}")
    return d + 0.0


def from_condensed(spark: SparkSession, data: Sequence[float]) -> MetricSpace:
    """A dense space from the lower triangle by rows: d(1,0), d(2,0), d(2,1), ... No entries: one point. Infinite
    distances are absent edges."""
    n = size_of_condensed(len(data))
    pairs = [(i, j) for i in range(n) for j in range(i)]
    return _space(spark, n, [(ALONE, i, j, check_distance(k, float(d))) for k, ((i, j), d) in enumerate(zip(pairs, data, strict=True))], "dense")


def lower_from_upper(data: Sequence[float]) -> list[float]:
    """The lower triangle by rows, from the upper one by rows (d01, d02, ..., d12, ...)."""
    n = size_of_condensed(len(data))
    at = lambda i, j: j * n - j * (j + 1) // 2 + i - j - 1
    return [float(data[at(i, j)]) for i in range(n) for j in range(i)]


def from_triplets(spark: SparkSession, n: int, triplets: Sequence[tuple[int, int, float]]) -> MetricSpace:
    """A sparse space of n points: only the listed pairs are at a finite distance."""
    met: dict[tuple[int, int], float] = {}
    clash: tuple | None = None
    for k, (i, j, d) in enumerate(triplets):
        i, j, d = int(i), int(j), float(d)
        if not (0 <= i < n and 0 <= j < n):
            raise InvalidInput(f"triplet {k}: vertex out of range ({i}, {j}) for n = {n}")
        if i == j:
            raise InvalidInput(f"triplet {k}: self-distance for vertex {i}")
        if not math.isfinite(d) or d < 0:
            raise InvalidDistance(f"triplet {k}: distance must be finite and non-negative, got {rust_float(d)}")
        pair, d = (max(i, j), min(i, j)), d + 0.0
        if met.setdefault(pair, d) != d:
            clash = min(filter(None, (clash, (pair[1], pair[0], *sorted((met[pair], d))))))
    if clash:
        raise InvalidInput(f"conflicting distances for pair ({clash[0]}, {clash[1]}): {rust_float(clash[2])} vs {rust_float(clash[3])}")
    return _space(spark, n, [(ALONE, u, v, d) for (u, v), d in sorted(met.items())], "sparse")


def from_point_frame(points: DataFrame, group: str, point: str, coords: str) -> MetricSpace:
    """One dense space a group of a frame of points; within a group points are numbered by `point`. Null or ragged or
    non-finite coordinates are an error."""
    rows = points.select(F.col(group).alias("group_id"), F.col(point).alias("point"), F.col(coords).cast("array<double>").alias("coords"))
    bad = F.col("coords").isNull() | F.exists("coords", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    checks = rows.groupBy("group_id").agg(F.count_if(bad).alias("bad"), F.min(F.size("coords")).alias("least"), F.max(F.size("coords")).alias("most"))
    wrong = F.when(F.expr("bad > 0 or least <> most"), F.struct("group_id", "bad"))
    seen = checks.agg(F.min("least").alias("least"), F.max("most").alias("most"), F.any_value(wrong, F.lit(True)).alias("faulty")).first()
    if seen.faulty:
        what = "a null or non-finite coordinate" if seen.faulty.bad else "points of different dimensions"
        raise InvalidInput(f"group {seen.faulty.group_id} has {what}")
    frame = rows.select("group_id", (F.row_number().over(Window.partitionBy("group_id").orderBy("point")) - 1).cast("long").alias("id"), "coords")
    return MetricSpace(frame.select("group_id", "id"), pairwise(frame), "dense", frame, seen.least == seen.most == 1)


def from_edge_frame(vertices: DataFrame, edges: DataFrame) -> MetricSpace:
    """Sparse spaces of a frame of vertices (group_id, id from 0 on) and one of weighted pairs (group_id, i, j, d):
    pairs may be repeated either way round with one distance."""
    edges = cut(edges)  # else the checks would compute them again
    bad = edges.where((F.col("i") == F.col("j")) | F.col("d").isNull() | F.isnan("d") | (F.col("d") < 0) | (F.col("d") == float("inf"))).limit(1).collect()
    if bad:
        r = bad[0]
        raise (InvalidInput(f"self-distance for vertex {r.i}") if r.i == r.j else InvalidDistance(f"distance must be finite and non-negative, got {r.d}"))
    pairs = edges.groupBy("group_id", F.greatest("i", "j").cast("long").alias("u"), F.least("i", "j").cast("long").alias("v"))
    pairs = cut(pairs.agg(F.min(F.col("d") + 0.0).alias("d"), F.max(F.col("d") + 0.0).alias("most")))
    discard(edges)
    clash = pairs.where("d <> most").limit(1).collect()
    if clash:
        r = clash[0]
        raise InvalidInput(f"conflicting distances for pair ({r.v}, {r.u}): {rust_float(r.d)} vs {rust_float(r.most)}")
    return MetricSpace(vertices, pairs.drop("most"), "sparse")


def uniform_cloud(n: int, dim: int, seed: int) -> list[list[float]]:
    """The deterministic cloud of benchmarks: uniform in the unit cube, by Python's Mersenne twister."""
    draw = random.Random(seed).random
    return [[draw() for _ in range(dim)] for _ in range(n)]
