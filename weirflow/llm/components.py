"""Connected components by alternating large-star and small-star contractions.

Edges stay in tables; each contraction is an aggregation and a join on a node, so a
node with very many neighbours is combined before the shuffle and its join is one that
adaptive execution can split. New links between nodes whose components are known are
contracted to links between components first, so that only these are solved again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirflow.shared import discard

from .common import written


def _large(e: DataFrame) -> DataFrame:
    both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(e: DataFrame) -> DataFrame:
    least = e.groupBy("u").agg(F.min("v").alias("m"))
    moved = e.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _state(e: DataFrame) -> tuple:
    return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``u, v`` with v the least node reachable from u, for each node with an edge but the least ones.

    ``edges`` are ``u > v`` without nulls; each may be given more than once.
    """
    e = written(edges.select("u", "v").filter("u > v").distinct(), "edges")
    now = _state(e)
    while now[0]:
        before, held = now, e
        e = written(_small(_large(e)), "stars")
        now = _state(e)
        discard(held)
        if now == before:
            break
    return e


def extended(comp: DataFrame, links: DataFrame) -> DataFrame:
    """The components ``u, v`` after ``links`` (``u, v`` as well) are added to those that ``comp`` describes."""
    of = lambda k: comp.select(F.col("u").alias(k), F.col("v").alias(f"_{k}"))
    named = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("_u", "u").alias("a"), F.coalesce("_v", "v").alias("b"))
    stars = components(named.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")))
    moved = comp.join(stars.select(F.col("u").alias("v"), F.col("v").alias("_v")), "v", "left").select("u", F.coalesce("_v", "v").alias("v"))
    out = written(moved.unionByName(stars), "components")
    discard(stars)
    return out
