"""SQL table function: rips_bars(points, max_dim, threshold, modulus) gives dim, birth and death."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf

from skein.params import RipsParams, checked_dim
from skein.plans.kernel import point_bars
from skein.schema import BARS


def distance(a: list[float], b: list[float]) -> float:
    """The scaled two-norm of a - b, summed from the left as the column expression is."""
    gaps = [abs(x - y) for x, y in zip(a, b, strict=True)]
    m = max(gaps, default=0.0)
    if m == 0 or math.isinf(m):
        return m
    total = 0.0
    for g in gaps:
        total += (g / m) * (g / m)
    return m * math.sqrt(total)


@udtf(returnType=T.StructType(BARS.fields[1:]))
class RipsBars:
    def eval(self, points: list, max_dim: int = 1, threshold: float | None = None, modulus: int = 2):
        params = RipsParams(max_dim, threshold, modulus).validate()
        n = len(points or ())
        if n:
            top = checked_dim(n, params.max_dim, modulus)
            yield from sorted(point_bars(np.array(points, np.float64).reshape(n, -1), top, threshold, modulus))


def register(spark: SparkSession) -> None:
    spark.udtf.register("rips_bars", RipsBars)
