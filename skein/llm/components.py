"""Connected components of a graph given by its edges, distributed: alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm.common import cut, discard


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step on edges (a > b). Large: each vertex ties its larger neighbours to the smallest of its
    neighbourhood. Small: each vertex ties itself and its smaller neighbours to the smallest of them. A hub's
    neighbours are never gathered: the smallest one is an aggregate, joined back (a join that can split keys)."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("m"))
        out = edges.join(least, edges["b"] == least["v"]).select("a", F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), "m")
        tied = edges.join(least, edges["a"] == least["v"]).select(F.col("b").alias("a"), F.col("m").alias("b"))
        out = tied.where("a > b").unionByName(least.select(F.col("v").alias("a"), F.col("m").alias("b")))
    return out.distinct()


def components(edges: DataFrame) -> DataFrame:
    """(a, b): each vertex a that isn't the smallest of its component, with the smallest vertex b of it.

    edges: columns a and b of one ordered type; loops and repeated edges don't matter, null ends are ignored.
    The rounds grow with the logarithm of a component's size; each is written to the shared folder."""
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges, before = cut(edges, "edges"), None
    while True:
        after = edges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.hash("a", "b").cast("long")), F.lit(0))).first()
        if after == before:
            return edges
        last, before = edges, after
        edges = cut(_star(_star(edges, True), False), "edges")
        discard(last)
