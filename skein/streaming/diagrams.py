"""An extension: diagrams of groups whose points arrive as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from skein.params import RipsParams
from skein.plans.rips import rips_persistence
from skein.sources.memory import from_point_frame


def diagrams_of_batches(points: DataFrame, group: str, point: str, coords: str, store: str, sink: Callable[[DataFrame, int], None], params: RipsParams | None = None) -> DataStreamWriter:
    """A writer that appends each batch's points to the Parquet table `store`, in a folder named by the batch (a
    batch that is run again replaces its own), and gives `sink` the new diagrams of the groups it touched."""

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{store}/batch={number}")
        touched = spark.read.parquet(f"{store}/batch={number}").select(group).distinct()
        known = spark.read.parquet(store).where(f"batch <= {number}").join(touched, group, "left_semi")
        sink(rips_persistence(from_point_frame(known, group, point, coords), params), number)

    return points.writeStream.foreachBatch(step)
