"""Connected components of an edge table, by alternating star contractions; nothing is collected."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import stage


def _hook(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Link the neighbours of each node to the smallest of them: to ``larger_only`` nodes, or the smaller ones with the node.

    Two rows of one become rows by a generator: a union would repeat all steps before it in the plan, and those of both
    steps of a round multiply.
    """
    def pair(a: str, b: str) -> Column:
        return F.struct(F.col(a).alias("a"), F.col(b).alias("b"))

    if larger_only:
        both = edges.select(F.inline(F.array(pair("a", "b"), pair("b", "a"))))
        low = both.groupBy("a").agg(F.min("b").alias("low")).withColumn("low", F.least("low", "a"))
        return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("low").alias("b"))
    low = edges.groupBy("a").agg(F.min("b").alias("low"))
    return edges.join(low, "a").select(F.inline(F.array(pair("b", "low"), pair("a", "low"))))


def _stars(edges: DataFrame) -> bool:
    """Whether every node has one smaller neighbour, without smaller ones of its own, or larger ones only: nothing is left to do."""
    def end(node: str, up: int) -> Column:
        return F.struct(F.col(node).alias("node"), F.lit(up).alias("up"), F.lit(1 - up).alias("down"))

    ends = edges.select(F.inline(F.array(end("a", 1), end("b", 0)))).groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not ends.filter("up + down > 1").agg(F.count(F.lit(1))).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """``node, component`` for every node of ``edges`` (``a``, ``b``), the component being its smallest node.

    Large-star and small-star steps in turn until the edges are one star per component: every round is joins and groupings
    over the edges, with a written table in between. Edges that are stars are found by one grouping, without a round.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()

    edges = stage(ordered(edges), "edges")
    while not _stars(edges):
        edges = stage(ordered(_hook(ordered(_hook(edges, True)), False)), "edges")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select("component", "component").distinct())
