"""Connected components of a distributed edge list by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scoreloom.llm.common import written


def components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of the undirected ``edges(a, b)``; the root is some node of the component.

    A round hooks every node onto its smallest neighbour (an aggregate that is combined before the shuffle), follows the hooks a few
    steps, and replaces both ends of every edge by what they hook onto. The larger end of every edge hooks onto something smaller, so
    the edges run out. Rounds are written tables in the shared folder; edges and labels stay on the executors.
    """
    live = written(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    labels = written(
        live.select("a").union(live.select("b")).distinct().select(F.col("a").alias("node"), F.col("a").alias("root")), "labels",
    )
    while not live.isEmpty():
        both = live.select(F.col("a").alias("node"), F.col("b").alias("to")).union(live.select("b", "a"))
        hooks = written(
            both.groupBy("node").agg(F.least("node", F.min("to")).alias("up")).filter("up <> node"), "hooks",
        )
        for _ in range(2):
            hooks = written(_followed(hooks, "up", hooks), "hooks")
        labels = written(_followed(labels, "root", hooks), "labels")
        moved = _followed(_followed(live, "a", hooks), "b", hooks).filter("a <> b")
        live = written(moved.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    return labels


def _followed(df: DataFrame, column: str, hooks: DataFrame) -> DataFrame:
    """``df`` with ``column`` replaced by what it hooks onto; a hot value is split by the adaptive join."""
    to = hooks.select(F.col("node").alias("__node"), F.col("up").alias("__up"))
    return (
        df.join(to, F.col(column) == F.col("__node"), "left")
        .withColumn(column, F.coalesce("__up", column)).drop("__node", "__up")
    )
