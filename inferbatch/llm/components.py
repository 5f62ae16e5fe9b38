"""Connected components by repeated contraction, for the near-duplicate operators.

Every round sends a node to the smallest of itself and its neighbours, in the order of a hash of the
node, and contracts the links. In hash order the nodes left shrink by a constant factor each round on
any graph, chains included. A hub with any number of links is combined before the shuffle (minimum
per node), and its links meet a table of one row per node, a join that Spark splits by size. Every
round is a written table, so a lost executor costs one round. Only "is a link left" reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inferbatch.session import discard, scratch_path, write_table


def _ordered(node: Column) -> Column:
    return F.struct(F.xxhash64(node).alias("h"), node.alias("v"))


def components(links: DataFrame) -> DataFrame:
    """Links (a, b) of bigint nodes to (id, component): the smallest node reachable from each.

    Nodes without a link to another node are not returned. Null ends, self links, repeated and
    reversed links are allowed and change nothing.
    """
    spark = links.sparkSession
    path = scratch_path(spark, "links")
    edges = write_table(links.select("a", "b").filter("a <> b").distinct(), path)
    roots = None
    while not edges.isEmpty():
        ends = edges.union(edges.select("b", "a"))
        smallest = F.least(_ordered(F.col("a")), F.min(_ordered(F.col("b"))))["v"]
        parents = write_table(
            ends.groupBy("a").agg(smallest.alias("p")), scratch_path(spark, "parents")
        )
        if roots is None:
            roots = parents.select(F.col("a").alias("id"), F.col("p").alias("root"))
        else:
            step = parents.select(F.col("a").alias("root"), "p")
            roots = roots.join(step, "root", "left").select("id", F.coalesce("p", "root").alias("root"))
        of_a = parents.select("a", F.col("p").alias("pa"))
        of_b = parents.select(F.col("a").alias("b"), F.col("p").alias("pb"))
        next_path = scratch_path(spark, "links")
        left = edges.join(of_a, "a").join(of_b, "b").filter("pa <> pb")
        next_edges = write_table(left.select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), next_path)
        discard(spark, path)
        edges, path = next_edges, next_path
    if roots is None:
        return edges.select(F.col("a").alias("id"), F.col("b").alias("component"))
    smallest_ids = roots.groupBy("root").agg(F.min("id").alias("component"))
    return write_table(roots.join(smallest_ids, "root").select("id", "component"), scratch_path(spark, "components"))
