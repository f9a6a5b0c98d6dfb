"""Functions of diagrams: frames of bars (group_id, dim, birth, death)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

INF = float("inf")


def canonical(bars: DataFrame) -> DataFrame:
    """By group, dimension, birth and death; infinity is last."""
    return bars.orderBy("group_id", "dim", "birth", "death")


def in_dim(bars: DataFrame, dim: int) -> DataFrame:
    return bars.where(F.col("dim") == dim)


def essential(bars: DataFrame) -> DataFrame:
    return bars.where(F.col("death") == INF)


def with_persistence(bars: DataFrame) -> DataFrame:
    """Bars with persistence (death - birth) and ratio (death / birth; null for a birth of 0)."""
    return bars.withColumns({"persistence": F.col("death") - F.col("birth"), "ratio": F.when(F.col("birth") > 0, F.col("death") / F.col("birth"))})


def most_persistent(bars: DataFrame, k: int) -> DataFrame:
    """The k longest finite bars of each group and dimension; ties by birth."""
    longest = Window.partitionBy("group_id", "dim").orderBy(F.desc("persistence"), "birth")
    ranked = with_persistence(bars.where(F.col("death") < INF)).withColumn("place", F.row_number().over(longest))
    return ranked.where(F.col("place") <= k).select("group_id", "dim", "birth", "death", "persistence", "place")


def betti_curve(bars: DataFrame, thresholds: list[float], max_dim: int) -> DataFrame:
    """group_id, t, dim and betti: bars with birth <= t < death, for each threshold and dimension, zeros included."""
    sums = {(k, d): F.count_if((F.col("dim") == d) & (F.col("birth") <= t) & (F.col("death") > t)).alias(f"_{k}_{d}") for k, t in enumerate(thresholds) for d in range(max_dim + 1)}
    cells = F.array(*[F.struct(F.lit(float(thresholds[k])).alias("t"), F.lit(d).alias("dim"), F.col(f"_{k}_{d}").alias("betti")) for k, d in sums])
    return bars.groupBy("group_id").agg(*sums.values()).select("group_id", F.inline(cells))


def same_diagrams(a: DataFrame, b: DataFrame) -> bool:
    """Whether two frames hold the same multiset of bars."""
    columns = ["group_id", "dim", "birth", "death"]
    a, b = a.select(columns), b.select(columns)
    return not a.exceptAll(b).limit(1).count() and not b.exceptAll(a).limit(1).count()


def close_diagrams(a: list[tuple], b: list[tuple], tolerance: float = 1e-5) -> bool:
    """Whether two lists of bars (dim, birth, death) match one to one, greedily, within the tolerance."""
    rest = sorted(b)
    near = lambda x, y: x == y or abs(x - y) <= tolerance
    for bar in sorted(a):
        match = next((k for k, other in enumerate(rest) if bar[0] == other[0] and near(bar[1], other[1]) and near(bar[2], other[2])), None)
        if match is None:
            return False
        del rest[match]
    return not rest
