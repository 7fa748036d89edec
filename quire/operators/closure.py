"""What a file costs with all that it imports: reachability over import edges, by rounds of joins, up to a number of hops."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import cut

HOPS = 5


def reached(edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """(root, node, hop) for every node that a root's imports (src, dst) reach in at most `hops` steps, by the fewest.

    A round follows only what the last one has newly reached, so cycles end. A root is reached by a cycle through it. Null ends and repeated edges are left out.
    """
    e = cut(edges.where("src is not null and dst is not null").select("src", "dst").distinct())
    ahead = e.select(F.col("src").alias("root"), F.col("dst").alias("node"), F.lit(1).alias("hop"))
    rounds = [ahead]
    for hop in range(2, hops + 1):
        ahead = ahead.select("root", F.col("node").alias("src")).join(e, "src").select("root", F.col("dst").alias("node")).distinct()
        before = reduce(DataFrame.unionByName, rounds).select("root", "node")
        ahead = cut(ahead.join(before, ["root", "node"], "left_anti").withColumn("hop", F.lit(hop)))
        if ahead.isEmpty():
            break
        rounds.append(ahead)
    return reduce(DataFrame.unionByName, rounds)


def effective_size(files: DataFrame, edges: DataFrame, hops: int = HOPS) -> DataFrame:
    """id, own, total, imports of files (id, own): their own size, that with every file that they reach, and how many these are.

    Imports of files that are not in the table are left out; a null size counts as 0. ids must be unique and not null.
    """
    own = files.where("id is not null").select("id", F.coalesce("own", F.lit(0)).alias("own"))
    there = edges.join(own.select(F.col("id").alias("dst")), "dst", "left_semi")
    cost = reached(there, hops).join(own.select(F.col("id").alias("node"), F.col("own").alias("size")), "node").groupBy(F.col("root").alias("id")).agg(F.sum("size").alias("more"), F.count("*").alias("imports"))
    return own.join(cost, "id", "left").select("id", "own", (F.col("own") + F.coalesce("more", F.lit(0))).alias("total"), F.coalesce("imports", F.lit(0)).alias("imports"))


def import_cost(files: DataFrame, edges: DataFrame, low: int, high: int, hops: int = HOPS) -> DataFrame:
    """id, own, total, priority of files within `low` themselves that pass it with their imports: P1 beyond `high`, else P2."""
    found = effective_size(files, edges, hops).where((F.col("own") <= low) & (F.col("total") > low) & (F.col("total") > F.col("own")))
    return found.select("id", "own", "total", F.when(F.col("total") > high, "P1").otherwise("P2").alias("priority"))
