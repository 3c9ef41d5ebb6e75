"""Connected components of a graph that no single task could hold."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexlake.storage import materialize


def _pull(edges: DataFrame, up: bool) -> DataFrame:
    """One star step over edges (a > b). up: bind a node's larger neighbours to the least of its neighbourhood; else its smaller ones.

    The least neighbour comes from an aggregation with partial sums and goes back by a join, so a node with very
    many neighbours is never gathered.
    """
    if up:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        out = edges.select(F.col("b").alias("u"), F.col("a").alias("v")).join(least, "u").select(F.col("v").alias("x"), F.col("m").alias("y"))
    else:
        least = edges.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
        joined = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).join(least, "u")
        out = joined.select(F.col("v").alias("x"), F.col("m").alias("y")).unionByName(least.select(F.col("u").alias("x"), F.col("m").alias("y")))
    return out.filter("x <> y").select(F.greatest("x", "y").alias("a"), F.least("x", "y").alias("b")).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for nodes of the undirected edges (a, b): component is the least node reachable.

    Alternating star steps turn each component into a star around its least node, in rounds that grow with the
    logarithm of a component's size. Each round is stored, so a lost executor costs no more than one. Repeated edges
    and loops do no harm; nodes without an edge to another are not listed.
    """
    edges = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now, seen = materialize(edges, "edges"), None
    while True:
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark[0] == 0 or mark == seen:
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
        seen = mark
        now = materialize(_pull(_pull(now, up=True), up=False), "edges")
