"""Minimum spanning forests and H0 over frames: Boruvka's rounds, for spaces too large for one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.storage import cut


def _roots(parent: DataFrame) -> DataFrame:
    """(group_id, c, root) from pointers (group_id, c, p) that end in loops c = p: pointers double until they stay."""
    now = cut(parent)
    while True:
        up = now.select(F.col("group_id").alias("_g"), F.col("c").alias("_c"), F.col("p").alias("_p"))
        met = now.join(up, F.col("group_id").eqNullSafe(F.col("_g")) & (F.col("p") == F.col("_c")))
        after = cut(met.select("group_id", "c", F.col("_p").alias("p"), (F.col("p") != F.col("_p")).alias("moved")))
        if not after.where("moved").limit(1).count():
            return after.select("group_id", "c", F.col("p").alias("root"))
        now = after.drop("moved")


def spanning_forest(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """The edges (group_id, u, v, d, idx) of the minimum spanning forest under the order diameter, then larger index
    first. The number of rounds grows with the logarithm of a component's size."""
    ranked = edges.withColumn("idx", F.call_function("div", F.col("u") * (F.col("u") - 1), F.lit(2).cast("long")) + F.col("v"))
    own = cut(vertices.select("group_id", F.col("id").alias("x"), F.col("id").alias("c")))
    left = cut(ranked.withColumns({"cu": F.col("u"), "cv": F.col("v")}))
    forest = None
    while left.limit(1).count():
        ends = left.select("group_id", "u", "v", "d", "idx", F.inline(F.array(F.struct(F.col("cu").alias("c"), F.col("cv").alias("p")), F.struct(F.col("cv").alias("c"), F.col("cu").alias("p")))))
        best = ends.groupBy("group_id", "c").agg(F.min(F.struct("d", (-F.col("idx")).alias("_i"), "u", "v", "idx", "p")).alias("b"))
        best = cut(best.select("group_id", "c", "b.*"))
        chosen = best.select("group_id", "u", "v", "d", "idx").distinct()
        forest = chosen if forest is None else forest.unionByName(chosen)
        back = best.select(F.col("group_id").alias("_g"), F.col("c").alias("_c"), F.col("p").alias("_p"))
        # Two components that choose each other: the smaller one is the root.
        to = best.join(back, F.col("group_id").eqNullSafe(F.col("_g")) & (F.col("p") == F.col("_c")))
        roots = _roots(to.select("group_id", "c", F.when((F.col("_p") == F.col("c")) & (F.col("c") < F.col("p")), F.col("c")).otherwise(F.col("p")).alias("p")))
        name = roots.select(F.col("group_id").alias("_g"), F.col("c").alias("_c"), "root")
        left = left.join(name, F.col("group_id").eqNullSafe(F.col("_g")) & (F.col("cu") == F.col("_c"))).select("group_id", "u", "v", "d", "idx", F.col("root").alias("cu"), "cv")
        left = left.join(name, F.col("group_id").eqNullSafe(F.col("_g")) & (F.col("cv") == F.col("_c"))).select("group_id", "u", "v", "d", "idx", "cu", F.col("root").alias("cv"))
        left = cut(left.where("cu <> cv"))
        forest = cut(forest)
    return ranked.limit(0).select("group_id", "u", "v", "d", "idx") if forest is None else forest


def h0_bars(vertices: DataFrame, forest: DataFrame) -> DataFrame:
    """Bars of dimension 0: one a forest edge of positive length, and an essential one a component."""
    finite = forest.where("d > 0").select("group_id", F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.col("d").alias("death"))
    n = vertices.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"))
    m = forest.groupBy("group_id").agg(F.count(F.lit(1)).alias("m")).withColumnRenamed("group_id", "_g")
    left = n.join(m, F.col("group_id").eqNullSafe(F.col("_g")), "left").select("group_id", (F.col("n") - F.coalesce("m", F.lit(0))).alias("k"))
    essential = left.select("group_id", F.explode(F.sequence(F.lit(1).cast("long"), "k"))).select("group_id", F.lit(0).alias("dim"), F.lit(0.0).alias("birth"), F.lit(float("inf")).alias("death"))
    return finite.unionByName(essential)
