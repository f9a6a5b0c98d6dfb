"""Combinatorial numbers of simplices: binomials, rank and unrank."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def binomial(n: Column, k: int) -> Column:
    """C(n, k) of a column n and a literal k; every step of the product is whole. Beyond a long it is an error."""
    out = F.lit(1).cast("long")
    for j in range(1, k + 1):
        out = F.call_function("div", out * (n.cast("long") - (k - j)), F.lit(j).cast("long"))
    return F.when(n < k, F.lit(0).cast("long")).otherwise(out)


def rank(vertices: Column, size: int) -> Column:
    """The number of a simplex of `size` ascending vertices: the sum of C(v_i, i + 1)."""
    total = F.lit(0).cast("long")
    for i in range(size):
        total = total + binomial(F.element_at(vertices, i + 1), i + 1)
    return total


def unranked(index: int, size: int) -> list[int]:
    """The ascending vertices of a simplex of `size` vertices with this number."""
    out = []
    for k in range(size, 0, -1):
        low, high = k - 1, k
        while math.comb(high, k) <= index:
            low, high = high, 2 * high
        while high - low > 1:  # C(low, k) <= index < C(high, k)
            mid = (low + high) // 2
            low, high = (mid, high) if math.comb(mid, k) <= index else (low, mid)
        out.append(low)
        index -= math.comb(low, k)
    return out[::-1]


def unrank(index: Column, size: int) -> Column:
    """The ascending vertices of the simplex with this number, by an Arrow-backed function."""

    @F.pandas_udf(T.ArrayType(T.LongType()))
    def run(numbers: pd.Series) -> pd.Series:
        return pd.Series([unranked(int(i), size) for i in numbers])

    return run(index)
