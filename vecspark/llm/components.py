"""Connected components by minimum labels, for links that only executors see."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm._shared import release, saved


def components(links: DataFrame) -> DataFrame:
    """(node, label) of every node of `links` (a, b); label is its component's least node.

    Each round a node takes the least label among itself and its neighbours, then the
    label of that label. Minima are summed before the shuffle, so a node with very
    many links costs a row for each task. Only labels that move are looked up, each
    once, so a label of very many nodes meets a short table, which Spark sends to all
    or joins with the label's nodes split. The rounds are about the logarithm of the
    longest chain; every round is written to the shared folder.
    """
    both = saved(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).filter("a <> b").distinct(), "neighbours")
    least = both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label"))
    labels = saved(least, "labels")
    while True:
        seen = labels.select(F.col("node").alias("b"), F.col("label").alias("near"))
        least = both.join(seen, "b").groupBy("a").agg(F.min("near").alias("near"))
        taken = labels.join(least, labels["node"] == least["a"]).select("node", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = labels.filter("label <> node").select(F.col("node").alias("at"), F.col("label").alias("upper"))
        moves = labels.select(F.col("label").alias("at")).distinct().join(up, "at")
        jumped = taken.join(moves, taken["label"] == moves["at"], "left").select("node", "old", F.least("label", "upper").alias("label"))
        done = saved(jumped, "labels")
        release(labels)
        labels = done.select("node", "label")
        labels._vecspark_path = done._vecspark_path
        if done.filter("old <> label").isEmpty():
            release(both)
            return labels


def joined(labels: DataFrame, links: DataFrame) -> DataFrame:
    """Saved `labels` (node, label) after more links (a, b) between its nodes.

    Classes count as one node each, so only the links and the classes they join are
    worked on; the old labels are deleted.
    """
    if links.isEmpty():
        return labels
    of = lambda side: labels.select(F.col("node").alias(side), F.col("label").alias(f"l{side}"))
    top = components(links.join(of("a"), "a").join(of("b"), "b").select(F.col("la").alias("a"), F.col("lb").alias("b")))
    into = top.select(F.col("node").alias("label"), F.col("label").alias("into"))
    out = saved(labels.join(into, "label", "left").select("node", F.coalesce("into", "label").alias("label")), "labels")
    release(labels, top)
    return out
