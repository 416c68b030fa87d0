"""Connected components of graphs that fit no single machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestream.scratch import forget, written


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", most_rounds: int = 60) -> DataFrame:
    """(id, component): every node that occurs in ``edges`` with the smallest id of its component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014): each links all neighbours of a node to
    the smallest node around it, and the edges become stars around the component minima in O(log^2 n) rounds.
    Neighbourhoods are never collected: a step is a minimum per node joined back to the edges, so a hub with a third
    of all edges costs one partial aggregate and a join that AQE may split. Loops and repeated edges are harmless,
    edges with a null end are left out.
    """
    u, v = F.greatest(src, dst), F.least(src, dst)
    ends = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull())
    nodes_alone = ends.filter(F.col(src) == F.col(dst)).select(F.col(src).alias("id")).distinct()
    e = written(ends.filter(F.col(src) != F.col(dst)).select(u.alias("u"), v.alias("v")).distinct())
    state = None
    for _ in range(most_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(lowest, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        kept = large.join(low, "u")
        small = kept.filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        before, e = e, written(small.distinct())
        forget(before)
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("v", "u").bitwiseAND(F.lit(0xFFFFFFFF)))).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    found = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    heads = e.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    linked = found.unionByName(heads)
    return linked.unionByName(nodes_alone.join(linked.select("id"), "id", "left_anti").withColumn("component", F.col("id")))
