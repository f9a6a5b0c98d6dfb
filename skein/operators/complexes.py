"""The flag complex as joins: simplices are cliques of the edge graph, each found once, from its lower vertices up."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.operators.combinadic import rank


def vertex_simplices(vertices: DataFrame) -> DataFrame:
    return vertices.select("group_id", F.array("id").alias("verts"), F.lit(0.0).alias("diameter"))


def edge_simplices(edges: DataFrame) -> DataFrame:
    return edges.select("group_id", F.array("v", "u").alias("verts"), F.col("d").alias("diameter"))


def expand(simplices: DataFrame, edges: DataFrame, size: int) -> DataFrame:
    """Cliques of size + 1 vertices from those of `size`: one equality join for the new, highest vertex, on the last
    vertex, and one for each other vertex; the diameter grows along."""
    out = simplices
    step = edges.select(F.col("group_id").alias("_g"), F.col("v").alias("_v"), F.col("u").alias("_u"), F.col("d").alias("_d"))
    out = out.join(step, F.col("group_id").eqNullSafe(F.col("_g")) & (F.element_at("verts", -1) == F.col("_v")))
    out = out.select("group_id", "verts", F.greatest("diameter", "_d").alias("diameter"), F.col("_u").alias("new"))
    for i in range(size - 1):
        out = out.join(step, F.col("group_id").eqNullSafe(F.col("_g")) & (F.element_at("verts", i + 1) == F.col("_v")) & (F.col("new") == F.col("_u")))
        out = out.select("group_id", "verts", F.greatest("diameter", "_d").alias("diameter"), "new")
    return out.select("group_id", F.array_append("verts", F.col("new")).alias("verts"), "diameter")


def simplices(vertices: DataFrame, edges: DataFrame, dim: int) -> DataFrame:
    """All dim-simplices: group_id, verts (ascending), diameter, idx (their rank)."""
    out = vertex_simplices(vertices) if dim == 0 else edge_simplices(edges)
    for size in range(2, dim + 1):
        out = expand(out, edges, size)
    return out.withColumn("idx", rank(F.col("verts"), dim + 1))


def simplex_counts(vertices: DataFrame, edges: DataFrame, max_dim: int) -> DataFrame:
    """group_id, dim and n_simplices; groups without simplices of a dimension have no row for it."""
    parts = [simplices(vertices, edges, d).groupBy("group_id").agg(F.count(F.lit(1)).alias("n_simplices")).withColumn("dim", F.lit(d)) for d in range(max_dim + 1)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.select("group_id", "dim", "n_simplices")


def euler_curve(vertices: DataFrame, edges: DataFrame, max_dim: int, thresholds: list[float]) -> DataFrame:
    """group_id, t and euler: the alternating count of simplices up to max_dim with a diameter of t at most."""
    out = None
    for d in range(max_dim + 1):
        part = simplices(vertices, edges, d).select("group_id", "diameter", F.lit((-1) ** d).alias("sign"))
        out = part if out is None else out.unionByName(part)
    sums = [F.sum(F.when(F.col("diameter") <= t, F.col("sign")).otherwise(0)).alias(f"_{k}") for k, t in enumerate(thresholds)]
    pairs = F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(f"_{k}").alias("euler")) for k, t in enumerate(thresholds)])
    return out.groupBy("group_id").agg(*sums).select("group_id", F.inline(pairs))


def cofacets(simplices_of_dim: DataFrame, next_simplices: DataFrame, dim: int) -> DataFrame:
    """group_id, idx and diameter of each dim-simplex with idx and diameter of each simplex it is a facet of, and
    the position k of the added vertex (the sign is (-1) ** k)."""
    up = facets(next_simplices, dim + 1)
    own = simplices_of_dim.select(F.col("group_id").alias("_g"), "idx", "diameter")
    met = up.join(own, F.col("group_id").eqNullSafe(F.col("_g")) & (F.col("facet_idx") == F.col("idx")))
    return met.select("group_id", "idx", "diameter", F.col("simplex_idx").alias("cofacet_idx"), F.col("simplex_diameter").alias("cofacet_diameter"), "k")


def facets(simplices_of_dim: DataFrame, dim: int) -> DataFrame:
    """For each dim-simplex its facets: simplex_idx, simplex_diameter, k (position of the removed vertex), sign,
    facet (vertices) and facet_idx."""
    out = simplices_of_dim.select("group_id", F.col("idx").alias("simplex_idx"), F.col("diameter").alias("simplex_diameter"), "verts", F.explode(F.array(*map(F.lit, range(dim + 1)))).alias("k"))
    facet = F.filter("verts", lambda v, i: i != F.col("k"))
    out = out.withColumn("facet", facet)
    return out.select("group_id", "simplex_idx", "simplex_diameter", "k", F.when(F.col("k") % 2 == 1, -1).otherwise(1).alias("sign"), "facet", rank(F.col("facet"), dim).alias("facet_idx"))


def boundary_squared(simplices_of_dim: DataFrame, lower: DataFrame, dim: int) -> DataFrame:
    """Entries of the boundary of the boundary of dim-simplices (all coefficients are zero): group_id, simplex_idx,
    face_idx, coefficient. lower: the (dim - 1)-simplices."""
    a = facets(simplices_of_dim, dim).select("group_id", "simplex_idx", "facet_idx", F.col("sign").alias("s"))
    b = facets(lower, dim - 1).select(F.col("group_id").alias("_g"), F.col("simplex_idx").alias("_i"), F.col("facet_idx").alias("face_idx"), F.col("sign").alias("t"))
    met = a.join(b, F.col("group_id").eqNullSafe(F.col("_g")) & (F.col("facet_idx") == F.col("_i")))
    return met.groupBy("group_id", "simplex_idx", "face_idx").agg(F.sum(F.col("s") * F.col("t")).alias("coefficient"))


def apparent_pairs(faces: DataFrame) -> DataFrame:
    """Pairs (idx, cofacet_idx, diameter) of cofacets()'s rows where each is the other's first match of equal
    diameter: the simplex is the cofacet's facet of least index, the cofacet the simplex's cofacet of largest."""
    even = faces.where(F.col("diameter") == F.col("cofacet_diameter"))
    first = even.groupBy("group_id", "cofacet_idx").agg(F.min("idx").alias("idx"))
    last = even.groupBy("group_id", "idx", "diameter").agg(F.max("cofacet_idx").alias("cofacet_idx"))
    first = first.select(F.col("group_id").alias("_g"), F.col("cofacet_idx").alias("_c"), F.col("idx").alias("_i"))
    met = last.join(first, F.col("group_id").eqNullSafe(F.col("_g")) & (F.col("cofacet_idx") == F.col("_c")) & (F.col("idx") == F.col("_i")))
    return met.select("group_id", "idx", "cofacet_idx", "diameter")
