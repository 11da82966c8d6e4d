"""Connected components over link tables of any size, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT_ROWS, checkpointed, join_classes

MAX_ROUNDS = 60


def _large_star(links: DataFrame, hot_rows: int) -> DataFrame:
    """Links every larger neighbour of a node to the node's smallest neighbour, itself included."""
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"), F.count("*").alias("n"))
    return join_classes(both.filter("b > a"), least, ["a"], hot_rows).select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame, hot_rows: int) -> DataFrame:
    """Links a node and its smaller neighbours to the smallest of them; links come with a > b."""
    least = links.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n"))
    smaller = join_classes(links, least, ["a"], hot_rows).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return smaller.unionAll(least.select("a", F.col("m").alias("b"))).distinct()


def components(links: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """node, root for every node of links(a, b): root is the smallest node of its component.

    A node's smallest neighbour is a grouped minimum, combined before the shuffle; hubs, nodes of very many links, get
    theirs by broadcast (join_classes), so that their links stay where they are. Each round is checkpointed in the
    shared folder. More than MAX_ROUNDS rounds, which no number of nodes that fits a cluster needs, are an error.
    """
    oriented = links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct()
    now = checkpointed(oriented)
    before = None
    for _ in range(MAX_ROUNDS):
        now = checkpointed(_small_star(checkpointed(_large_star(now, hot_rows)), hot_rows))
        state = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    else:
        raise ArithmeticError("components did not settle")
    roots = now.select("b").distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionAll(roots.select(F.col("b").alias("node"), F.col("b").alias("root")))
