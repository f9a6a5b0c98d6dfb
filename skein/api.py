"""Functions on Python values: lists in, sorted lists of bars (dim, birth, death) out."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import SparkSession

from skein.params import RipsParams
from skein.plans.rips import rips_persistence
from skein.sinks import Bar, collected
from skein.sources.memory import from_condensed, from_points, from_triplets, lower_from_upper


def session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.appName("skein").getOrCreate()


def rips_points(points: Sequence[Sequence[float]], max_dim: int = 1, threshold: float | None = None, modulus: int = 2, threads: int = 1) -> list[Bar]:
    """Bars of a point cloud under the Euclidean distance."""
    return collected(rips_persistence(from_points(session(), points), RipsParams(max_dim, threshold, modulus, threads)))


def rips_condensed(data: Sequence[float], max_dim: int = 1, threshold: float | None = None, modulus: int = 2, threads: int = 1) -> list[Bar]:
    """Bars of distances in the order of SciPy's pdist: d01, d02, ..., d12, ..."""
    return collected(rips_persistence(from_condensed(session(), lower_from_upper(data)), RipsParams(max_dim, threshold, modulus, threads)))


def rips_sparse(n: int, triplets: Sequence[tuple[int, int, float]], max_dim: int = 1, threshold: float | None = None, modulus: int = 2, threads: int = 1) -> list[Bar]:
    """Bars of n points of which only the listed pairs (i, j, distance) have edges."""
    return collected(rips_persistence(from_triplets(session(), n, triplets), RipsParams(max_dim, threshold, modulus, threads)))
