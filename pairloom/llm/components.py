"""Connected components of a graph given by links, without gathering it anywhere."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import drop, saved_at

#: Rounds before giving up; each at least halves the height of a component's tree, so this is never reached.
MOST_ROUNDS = 60


def components(links: DataFrame) -> DataFrame:
    """(node, component) for each node of links(a, b): the smallest node reachable.

    Alternates large-star and small-star (Kiveris et al., 2014): every node hangs its neighbours on its smallest one.
    Each step is an aggregation to one row per node, with partial sums before the shuffle, and a join of the links
    with it whose large keys adaptive execution splits, so a node with very many links is never gathered in a task.
    Links that repeat or join a node with itself do no harm; null ends are ignored; without links there are no rows.
    Each round's table is deleted when the next one is written.
    """
    spark = links.sparkSession
    edges, at = saved_at(
        links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a is not null and b is not null and u <> v").distinct(), "links"
    )
    state = None
    for _ in range(MOST_ROUNDS):
        # large star: the neighbours above a node go to the smallest of it and its neighbours
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: a node and its neighbours below it go to the smallest of them
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(least, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges, after = saved_at(small.where("u <> v").distinct(), "star")
        drop(spark, at)
        at = after
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if state == now:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    tops = edges.select(F.col("v").alias("node")).distinct().join(edges.select(F.col("u").alias("node")), "node", "left_anti")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(tops.select("node", F.col("node").alias("component")))
