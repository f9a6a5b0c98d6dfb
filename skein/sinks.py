"""Diagrams as text: interval lists by dimension, and CSV."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.params import rust_float

Bar = tuple[int, float, float]


@F.pandas_udf(T.StringType())
def float_text(values: pd.Series) -> pd.Series:
    """Doubles as the text formats write them."""
    return values.map(rust_float)


def interval_text(bars: list[Bar], max_dim: int) -> str:
    """A header for each dimension up to max_dim, bars or not, each followed by its bars."""
    out = []
    for dim in range(max_dim + 1):
        out.append(f"persistence intervals in dim {dim}:\n")
        out += [f" [{rust_float(b)}, )\n" if math.isinf(d) else f" [{rust_float(b)},{rust_float(d)})\n" for k, b, d in bars if k == dim]
    return "".join(out)


def csv_text(bars: list[Bar]) -> str:
    return "dim,birth,death\n" + "".join(f"{k},{rust_float(b)},{rust_float(d)}\n" for k, b, d in bars)


def csv_lines(bars: DataFrame) -> DataFrame:
    """group_id and line of each bar, for writing with any of Spark's writers."""
    return bars.select("group_id", F.concat_ws(",", F.col("dim").cast("string"), float_text("birth"), float_text("death")).alias("line"))


def interval_lines(bars: DataFrame) -> DataFrame:
    essential = F.concat(F.lit(" ["), float_text("birth"), F.lit(", )"))
    finite = F.concat(F.lit(" ["), float_text("birth"), F.lit(","), float_text("death"), F.lit(")"))
    return bars.select("group_id", "dim", F.when(F.col("death") == float("inf"), essential).otherwise(finite).alias("line"))


def collected(bars: DataFrame) -> list[Bar]:
    """The bars of one diagram as sorted tuples."""
    return sorted((r.dim, r.birth, r.death) for r in bars.select("dim", "birth", "death").collect())
