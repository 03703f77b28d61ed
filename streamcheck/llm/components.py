"""Connected components of an edge table by alternating large and small stars.

Every round hangs each vertex's neighbours on the smallest of them; edges turn into stars
around the smallest id of their component in about log n rounds.  Minima are combined before
the shuffle and written as tables of their own, so that the joins back are plain equi-joins
whose hot keys (the centre of a large star) adaptive execution splits.  Each round's edges are a table in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from streamcheck.llm.shared import Scratch


def large_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), F.least("a", "m").alias("m"))
    least = scratch.write(least, name)
    return both.join(least, F.col("a") == F.col("k")).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()


def small_star(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """Edges are (a, b) with b < a."""
    least = scratch.write(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("k"), "m"), name)
    moved = edges.join(least, F.col("a") == F.col("k")).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.union(least.select(F.col("k").alias("a"), F.col("m").alias("b"))).distinct()


def are_stars(edges: DataFrame) -> bool:
    """Every vertex hangs on one centre, and no centre hangs on another."""
    if not edges.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        return False
    return edges.join(edges.select(F.col("b").alias("k")).distinct(), F.col("a") == F.col("k"), "left_semi").isEmpty()


def components(edges: DataFrame, scratch: Scratch, name: str, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): the smallest id reachable, for every vertex that is not itself the smallest.

    Vertices without a row are their own component.  ``edges`` may hold either direction,
    repeats, loops and nulls; loops and nulls link nothing.
    """
    a, b = F.col(a).cast("bigint"), F.col(b).cast("bigint")
    now = scratch.write(edges.where((a != b) & a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), f"{name}-0")
    rounds = 0
    while not are_stars(now):
        rounds += 1
        half = scratch.write(large_star(now, scratch, f"{name}-large"), f"{name}-half")
        now = scratch.write(small_star(half, scratch, f"{name}-small"), f"{name}-{rounds}")
        scratch.drop(f"{name}-{rounds - 1}")
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))
