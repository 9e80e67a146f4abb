"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import Store


def _hub(edges: DataFrame) -> DataFrame:
    """The smallest neighbour of each node ``a``, itself included."""
    return edges.groupBy("a").agg(F.min("b").alias("_m")).select("a", F.least("a", "_m").alias("m"))


def _large(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return both.where("b > a").join(_hub(both), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small(edges: DataFrame) -> DataFrame:
    down = edges.where("a > b")
    hub = _hub(down)
    tied = down.join(hub, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return tied.union(hub.select("a", F.col("m").alias("b"))).where("a > b").distinct()


def components(edges: DataFrame, store: Store, label: str) -> DataFrame:
    """(a, root) for each node that is not the smallest of its component.

    ``edges`` has two comparable columns a and b.  Each round joins every node to
    the smallest node it knows of; a round works on sums per node and a join,
    never on the neighbours of one node in one place, and is written to the
    shared folder.  Rounds grow with the logarithm of the longest chain.
    """
    mark = F.struct(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h"))
    now = store.keep(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                     .where("a > b").distinct(), f"{label}0")
    seen, turn = now.select(mark).head()[0], 0
    while True:
        turn += 1
        after = store.keep(_small(_large(now)), f"{label}{turn}")
        store.drop(f"{label}{turn - 1}")
        mark_now = after.select(mark).head()[0]
        if mark_now == seen:
            return after.select("a", F.col("b").alias("root"))
        now, seen = after, mark_now
