"""Connected components of edge tables that may hold hubs of any degree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.storage import persist_table


def _down(edges: DataFrame, a: str, b: str) -> DataFrame:
    """Distinct edges as (hi, lo), without loops."""
    pair = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo"))
    return pair.filter(F.col("hi") != F.col("lo")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Hangs each node and its smaller neighbours below the smallest of them."""
    least = persist_table(edges.groupBy("hi").agg(F.min("lo").alias("least")), "cc-least")
    moved = edges.join(least, "hi").filter(F.col("lo") != F.col("least"))
    return _down(moved.select(F.col("lo").alias("x"), F.col("least").alias("y")).unionByName(least.select(F.col("hi").alias("x"), F.col("least").alias("y"))), "x", "y")


def _large_star(edges: DataFrame) -> DataFrame:
    """Hangs the larger neighbours of each node below the smallest of its neighbourhood."""
    both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    least = persist_table(both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("least")), "cc-least")
    return _down(both.filter(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("x"), F.col("least").alias("y")), "x", "y")


def _is_stars(edges: DataFrame) -> bool:
    """Whether each node hangs below one node that itself hangs nowhere."""
    places = edges.select(F.col("hi").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above"))
    places = places.unionByName(edges.select(F.col("lo").alias("node"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    odd = places.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).filter((F.col("below") > 1) | ((F.col("below") > 0) & (F.col("above") > 0)))
    return odd.isEmpty()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of ``edges`` that isn't the smallest of its component.

    The component is named by its smallest node. Alternates large and small stars,
    whose number of rounds grows with the logarithm of the graph's size; each round is
    written to the shared folder. A node's neighbours are never gathered in one row or
    task: only minima are computed by node. Edges that repeat or loop are harmless,
    those with a null end are ignored, and an empty table gives none.
    """
    now = persist_table(_down(edges, a, b), "cc-edges")
    while not _is_stars(now):
        now = persist_table(_large_star(now), "cc-edges")
        now = persist_table(_small_star(now), "cc-edges")
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
