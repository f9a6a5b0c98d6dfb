"""Schemas of the frames that stages exchange. Every frame has group_id: one space, and one diagram, a group."""

from __future__ import annotations

from pyspark.sql import types as T

VERTICES = T.StructType([T.StructField("group_id", T.StringType()), T.StructField("id", T.LongType(), False)])
EDGES = T.StructType([*VERTICES.fields[:1], T.StructField("u", T.LongType(), False), T.StructField("v", T.LongType(), False), T.StructField("d", T.DoubleType(), False)])
BARS = T.StructType([*VERTICES.fields[:1], T.StructField("dim", T.IntegerType(), False), T.StructField("birth", T.DoubleType(), False), T.StructField("death", T.DoubleType(), False)])


def keyed(schema: T.StructType, kind: T.DataType) -> T.StructType:
    """The schema with a group_id of another type."""
    return T.StructType([T.StructField("group_id", kind), *schema.fields[1:]])
