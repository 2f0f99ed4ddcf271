"""Connected components of an edge table, as rounds of joins and aggregates.

Alternating large-star and small-star steps (Kiveris et al., "Connected
Components in MapReduce and Beyond", 2014). Every step is a minimum with
map-side combine followed by a shuffle join, so a hub with a third of all edges
is pre-aggregated and its join partition is split by adaptive execution; no
neighbour list is ever gathered. Each round is written to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinlens.sources.scratch import drop, materialise


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(
        edges.select(F.col("b").alias("u"), F.col("a").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return (
        both.join(least, "u")
        .where("v > u")
        .select(F.col("v").alias("a"), F.col("m").alias("b"))
        .where("a <> b")
    )


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) of every vertex with an edge; component is its smallest vertex.

    ``edges`` has two columns ``a`` and ``b`` of one orderable type; direction,
    repeats, self-loops and null ends don't matter. Vertices without an edge to
    another vertex are left out. An empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    now, path = materialise(
        edges.where("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct(),
        "edges",
    )
    digest = [F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    seen = None
    for _ in range(max_rounds):
        after, new_path = materialise(_small_star(_large_star(now)), "stars")
        sums = tuple(after.agg(*digest).first())
        drop(spark, path)
        now, path = after, new_path
        if sums == seen or sums[0] == 0:
            return now.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(
                now.select(F.col("b").alias("id"), F.col("b").alias("component"))
            ).distinct()
        seen = sums
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
