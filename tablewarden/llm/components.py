"""Connected components of a graph given by its edges, as Spark jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewarden.llm.common import materialise

MAX_ROUNDS = 60


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of u moves to the smallest node among u and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """u and its smaller neighbours move to the smallest of them. edges run from the larger node to the smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select("a", F.col("m").alias("b")))


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for each node of edges(a, b) but the smallest ones.

    Alternates large-star and small-star until nothing changes. Minima are combined on the map side; the join back
    to a node with many neighbours is one that Spark can split. Each round is written to the shared folder. Loops
    and repeated edges do no harm; edges with a null end are ignored; no edges give no rows.
    """
    cur = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    cur = materialise(cur, "components")
    was = None
    for _ in range(MAX_ROUNDS):
        now = cur.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if now == was:
            return cur.select(F.col("a").alias("node"), F.col("b").alias("component"))
        was = now
        cur = materialise(_small_star(_large_star(cur).distinct()).distinct(), "components")
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
