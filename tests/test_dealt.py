"""Groups of the kernel stay dealt to tasks, however few bytes they have."""

from pyspark.sql import functions as F

from skein.params import RipsParams
from skein.plans.rips import rips_persistence
from skein.sources.memory import from_edge_frame, from_point_frame


def tasks_with_rows(bars):
    return len({r.p for r in bars.withColumn("p", F.spark_partition_id()).collect()})


def test_small_groups_are_not_put_into_one_task(spark):
    points = spark.range(64).select((F.col("id") % 16).alias("g"), "id", F.array(F.col("id").cast("double"), F.lit(0.0)).alias("at"))
    assert tasks_with_rows(rips_persistence(from_point_frame(points, "g", "id", "at"), RipsParams(max_dim=0))) > 4
    vertices = spark.range(32).select((F.col("id") % 16).alias("group_id"), F.floor(F.col("id") / 16).alias("id"))
    edges = spark.range(16).select(F.col("id").alias("group_id"), F.lit(1).cast("long").alias("i"), F.lit(0).cast("long").alias("j"), F.lit(1.0).alias("d"))
    assert tasks_with_rows(rips_persistence(from_edge_frame(vertices, edges), RipsParams(max_dim=1))) > 4
