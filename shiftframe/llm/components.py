"""Connected components of an edge table, without collecting nodes, edges or groups.

Alternating large-star and small-star rounds (Kiveris et al., 2014) with every round written to the shared folder.
Neighbour minima are partial aggregates, and the join back to the edges is salted, so a node with any number of
edges is spread over many tasks. Null ends are ignored; self edges and repeated edges are harmless; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _common as c

SALTS = 16


def _star(pairs: DataFrame, larger: bool) -> DataFrame:
    """Link what each node u sees to the least node it sees. pairs: (u, v), from the side of u."""
    least = pairs.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    salted = least.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    of = pairs.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int")).join(salted, ["u", "salt"])
    if larger:
        return of.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    return of.where("v <= u").select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")


def components(edges: DataFrame, left: str, right: str, *, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the least node that is reachable. Nodes without an edge don't appear."""
    spark = edges.sparkSession
    a, b = F.col(left), F.col(right)
    own = edges.where(a.isNotNull() & b.isNotNull()).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    nodes, nodes_path = c.saved(own.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "cc-nodes")
    now, path = c.saved(own.where("a > b").distinct(), "cc-edges")
    before = None
    for _ in range(most_rounds):
        sums = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if sums == before or not sums[0]:
            break
        before = sums
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).union(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large, large_path = c.saved(_star(both, True).where("a > b").distinct(), "cc-large")
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False).where("a > b").distinct()
        now, small_path = c.saved(small, "cc-small")
        c.remove(spark, path, large_path)
        path = small_path
    else:
        raise RuntimeError("components did not settle")
    out = nodes.join(now, nodes["node"] == now["a"], "left").select("node", F.coalesce("b", "node").alias("component"))
    out, _ = c.saved(out, "cc")
    c.remove(spark, path, nodes_path)
    return out
