"""Connected components of links between numbered nodes, by alternating stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadence.llm.common import Workspace


def connected(links: DataFrame, ws: Workspace, tag: str, rounds: int = 60) -> DataFrame:
    """``node, root``: for every node with a link, the smallest node of its component.

    Each round hangs a node's larger neighbours, then its smaller ones, on the
    smallest neighbour (large and small star), until nothing changes; rounds
    grow with the logarithm of the component's size. A node's neighbours
    are folded into a minimum before the shuffle, never listed.
    """
    edges = ws.put(links.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).where("u < v").distinct(), f"{tag}-edges0")
    before = None
    for k in range(1, rounds + 1):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).where("a < b").distinct()
        large = ws.put(large, f"{tag}-large{k}")
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(low, "b").select(F.col("m").alias("u"), F.explode(F.array("a", "b")).alias("v")).where("u < v").distinct()
        new = ws.put(small, f"{tag}-edges{k}")
        now = new.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        ws.drop(f"{tag}-edges{k - 1}", f"{tag}-large{k}")
        edges = new
        if (now["n"], now["s"]) == before:
            break
        before = (now["n"], now["s"])
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("v").alias("node"), F.col("u").alias("root")).union(edges.select(F.col("u").alias("node"), F.col("u").alias("root"))).distinct()
