"""Connected components by alternating large-star and small-star steps (Kiveris et al., SoCC 2014).

Each step is two joins and two aggregations over the edge table; no node list, edge list or label
table ever reaches the driver, a hub's neighbours are aggregated before they are shuffled, and what is
told to all edges of a hub is broadcast. Tasks follow the number of edges, not the session's shuffle partitions: the
rounds are many and their tables often small, and every task costs files and log entries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import checkpoint, shuffles_removed


#: A node with more than one of this many edges is a hub, so there are at most 2 * HUBS of them.
HUBS = 1000
#: A task of a round has about this many edges, but a round is shared out over at least so many tasks.
TASK_EDGES, TASKS = 100_000, 8


def _tasks(n: int) -> int:
    return max(TASKS, -(-n // TASK_EDGES))


def _with_least(rows: DataFrame, least: DataFrame, n: int) -> DataFrame:
    """rows (a, b) with m of least (a, m, d). The bounded number of hubs is broadcast, and their rows go by b, so no task gets all of one."""
    least = least.coalesce(_tasks(n))
    hubs = least.filter(F.col("d") > n / HUBS).select("a", F.col("m").alias("hub_m"))
    tagged = rows.join(F.broadcast(hubs), "a", "left").withColumn("hub", F.col("hub_m").isNotNull()).withColumn("k", F.when(F.col("hub"), F.col("b")).otherwise(F.col("a")))
    found = tagged.join(least.select(F.col("a").alias("k"), F.lit(False).alias("hub"), "m"), ["k", "hub"], "left")
    return found.coalesce(_tasks(n)).select("a", "b", F.coalesce("hub_m", "m").alias("m"))


def _large_star(edges: DataFrame, n: int) -> DataFrame:
    """Every larger neighbour of a node is linked to the least of the node and its neighbours."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"), F.count(F.lit(1)).alias("d"))
    return _with_least(both.filter("b > a"), least, n).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a != b").distinct().coalesce(_tasks(n))


def _small_star(edges: DataFrame, n: int) -> DataFrame:
    """A node and its smaller neighbours are linked to the least of them. Edges point from a to a smaller b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("d"))
    moved = _with_least(edges, least, n).select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.coalesce(_tasks(n)).select("a", F.col("m").alias("b"))).filter("a != b").distinct().coalesce(_tasks(n))


def _measure(edges: DataFrame) -> tuple[int, int]:
    """(number of edges, number of nodes that keep the edges from being stars around the least node of each component)."""
    ends = edges.select(F.col("a").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).unionByName(edges.select(F.col("b").alias("x"), F.lit(0).alias("down"), F.lit(1).alias("up")))
    nodes = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    with shuffles_removed(edges.sparkSession):
        row = nodes.agg(F.coalesce(F.sum("down"), F.lit(0)).alias("n"), F.count_if((F.col("down") > 1) | (F.col("down") + F.col("up") > 1)).alias("bad")).first()
    return row["n"], row["bad"]


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Rows (node, root) for every node that is not the least of its component.

    edges: two columns of one type, any direction, repeats and self-links allowed. Nodes that appear in
    no edge, and the roots themselves, have no row. An empty edge table gives an empty result.
    """
    now = edges.select(F.greatest(F.col(a), F.col(b)).alias("a"), F.least(F.col(a), F.col(b)).alias("b"))
    now = checkpoint(now.filter("a != b").distinct())
    n, bad = _measure(now)
    while bad:
        now = checkpoint(_small_star(checkpoint(_large_star(now.coalesce(_tasks(n)), n)), n))
        n, bad = _measure(now)
    return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
