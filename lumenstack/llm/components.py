"""Connected components of a table of links by alternating large and small stars.

Every round is two aggregations and two joins on node ids, written to the shared folder, so that a lost
executor costs at most one round. Hot nodes meet aggregations that combine before the shuffle, and joins
whose skewed partitions Spark may split. No links give an empty table; self links and null ends are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenstack.llm.common import forget, materialise


def connected_components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root): every node that is not the smallest of its component, with the smallest."""
    high, low = F.greatest(a, b).alias("a"), F.least(a, b).alias("b")
    edges = materialise(links.where(F.col(a) != F.col(b)).select(high, low).distinct())
    before = None
    while (now := _stamp(edges)) != before and now[0]:
        before, last = now, edges
        edges = materialise(_small_star(_large_star(last)))
        forget(last)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def _stamp(edges: DataFrame) -> tuple:
    """Count and order-free checksum."""
    wide = F.xxhash64("a", "b").cast("decimal(20,0)")
    return tuple(edges.agg(F.count("*"), F.sum(wide)).first())


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionAll(edges.select("b", "a"))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a != b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    others = edges.join(least, "a").where("b != m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return others.unionAll(least.select("a", F.col("m").alias("b"))).distinct()
