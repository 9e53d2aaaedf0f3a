"""Connected components by randomised contraction, in DataFrame operations only.

Each round orders the nodes by a fresh hash, lets every node point at the smallest
among itself and its neighbours, and replaces the edges by those between the nodes
pointed at.  A constant share of the nodes disappears per round in expectation,
whatever the shape (a long chain too), so the rounds grow with the logarithm of the
nodes.  A hub costs nothing extra: its minimum is pre-aggregated per partition, and
the joins on it have a side of one row per node, which adaptive execution can split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import scratch


def _order(node: str, round_no: int) -> Column:
    return F.struct(F.xxhash64(F.lit(round_no), F.col(node)), F.col(node).alias("n"))


def connected_components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """``(node, component)`` for every end of an edge; ``component`` is one of its nodes.

    Edges with a null end, loops and repeated edges change nothing.  No edge: no row.
    """
    spark = edges.sparkSession
    one_way = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").distinct()
    both = one_way.unionByName(one_way.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    current, path = scratch.save(both, "edges")
    maps: list[DataFrame] = []
    steps: list[str] = []
    while not current.isEmpty():
        step = (
            current.groupBy("u").agg(F.min(_order("v", len(maps))).alias("best"))
            .select(F.col("u").alias("node"), F.least(_order("u", len(maps)), F.col("best"))["n"].alias("rep"))
        )
        step, step_path = scratch.save(step, "contraction")
        maps.append(step)
        steps.append(step_path)
        to = step.withColumnsRenamed({"node": "v", "rep": "rv"})
        following = (
            current.join(step.withColumnsRenamed({"node": "u", "rep": "ru"}), "u").select("ru", "v")
            .distinct().join(to, "v").where("ru <> rv").select(F.col("ru").alias("u"), F.col("rv").alias("v")).distinct()
        )
        following, next_path = scratch.save(following, "edges")
        scratch.drop(spark, path)
        current, path = following, next_path
    if not maps:
        return current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    whole = maps[-1]
    for earlier in reversed(maps[:-1]):
        whole = earlier.join(whole.select(F.col("node").alias("rep"), F.col("rep").alias("final")), "rep", "left").select(
            "node", F.coalesce("final", "rep").alias("rep")
        )
    whole, _ = scratch.save(whole.withColumnRenamed("rep", "component"), "components")
    scratch.drop(spark, path, *steps)
    return whole
