"""Node placement and acknowledgement analytics of a replicated store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import vectors
from vecspark.operators import scan
from vecspark.operators.knn import blocks, top_k

LEVELS = ("one", "quorum", "all")
NODES = "node_id string, host string, port int, is_healthy boolean, shard_ids array<int>"


def replicas(ids: DataFrame, nodes: DataFrame, factor: int = 2) -> DataFrame:
    """(doc_id, replica, node_id): healthy nodes in id order from doc_id modulo their number.

    The node list is small by nature; it is broadcast as one array.
    """
    healthy = nodes.filter("is_healthy").agg(F.sort_array(F.collect_list("node_id")).alias("nodes"))
    h = F.size("nodes")
    pick = F.transform(F.sequence(F.lit(0), F.least(F.lit(factor), h) - 1), lambda i: F.struct(i.cast("int").alias("replica"), F.col("nodes")[F.pmod(F.col("doc_id") + i, h).cast("int")].alias("node_id")))
    return ids.select("doc_id").crossJoin(F.broadcast(healthy)).filter(h > 0).select("doc_id", F.inline(pick))


def consistency(acks: DataFrame, level: str = "quorum") -> DataFrame:
    """(doc_id, successes, replicas, ok) from acknowledgements (doc_id, success)."""
    if level not in LEVELS:
        raise ValueError(f"unknown consistency level {level!r}; known: {', '.join(LEVELS)}")
    n = F.count(F.lit(1))
    needed = {"one": F.lit(1), "quorum": F.floor(n / 2) + 1, "all": n}[level]
    got = F.count_if("success")
    return acks.groupBy("doc_id").agg(got.alias("successes"), n.alias("replicas"), (got >= needed).alias("ok"))


def gather(responses: DataFrame, k: int) -> DataFrame:
    """Answers of many nodes (query_id, node_id, doc_id, distance) merged: the best of each id, a missing distance last."""
    d = F.coalesce(F.col("distance").cast("double"), F.lit(float("inf")))
    one = responses.groupBy("query_id", "doc_id").agg(F.min(d).alias("distance"))
    w = Window.partitionBy("query_id").orderBy("distance", "doc_id")
    return one.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def search(placed: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest that each node of `placed` (doc_id, vector, node_id) answers, gathered."""
    vectors.distance(metric)
    out = None
    for q in blocks(queries):
        answers = scan.nearest(placed, q, k, metric, "node_id").withColumnRenamed("part", "node_id")
        got = gather(top_k(answers, ["query_id", "node_id"], k, F.col("distance"), F.col("doc_id")).drop("rank"), k)
        out = got if out is None else out.unionByName(got)
    return out


def add_node(nodes: DataFrame, new: DataFrame) -> DataFrame:
    """An id that is there already is replaced."""
    return remove_node(nodes, new).unionByName(new)


def remove_node(nodes: DataFrame, gone: DataFrame) -> DataFrame:
    return nodes.join(F.broadcast(gone.select("node_id")), "node_id", "left_anti").select(*nodes.columns)


def stats(nodes: DataFrame) -> DataFrame:
    """One row: total, healthy and unhealthy nodes, and shards placed."""
    return nodes.agg(F.count(F.lit(1)).alias("total_nodes"), F.count_if("is_healthy").alias("healthy"), F.count_if(~F.col("is_healthy")).alias("unhealthy"), F.sum(F.size("shard_ids")).cast("long").alias("shards"))


def health(nodes: DataFrame, beats: DataFrame, now: Column, timeout_s: int = 30) -> DataFrame:
    """nodes with is_healthy told by heartbeats (node_id, at): one within timeout_s of now.

    A node that never answered is not healthy; beats later than now count as answers.
    """
    last = beats.groupBy("node_id").agg(F.max("at").alias("_last_beat"))
    alive = F.coalesce(F.unix_micros(F.col("_last_beat").cast("timestamp")) >= F.unix_micros(now.cast("timestamp")) - timeout_s * 1_000_000, F.lit(False))
    return nodes.join(last, "node_id", "left").withColumn("is_healthy", alive).select(*nodes.columns)


def time_id(at: Column | None = None) -> Column:
    """Microseconds since the epoch of a time, by default the query's: ids that sort by time, not unique ones."""
    return F.unix_micros(F.current_timestamp() if at is None else at.cast("timestamp"))


def delete(corpus: DataFrame, ids: DataFrame, acks: DataFrame, level: str = "quorum") -> tuple[DataFrame, DataFrame]:
    """(corpus without the ids whose deletes were acknowledged, the acknowledgements of all ids).

    acks: (doc_id, success), one row a replica. An id without any acknowledgement stays.
    """
    said = consistency(acks.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"), level)
    return corpus.join(said.filter("ok"), "doc_id", "left_anti").select(*corpus.columns), said
