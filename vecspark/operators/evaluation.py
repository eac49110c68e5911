"""Recall and latency measures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall_at_k(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """(query_id, recall) over the first k of both; a query without truth has 0.

    found, truth: query_id, doc_id, rank.
    """
    t = truth.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("t"))
    f = found.filter(F.col("rank") <= k).select("query_id", "doc_id", F.lit(1).alias("f"))
    both = t.join(f, ["query_id", "doc_id"], "full").groupBy("query_id").agg(F.count(F.when(F.col("t").isNotNull() & F.col("f").isNotNull(), 1)).alias("hits"), F.count("t").alias("n"))
    return both.select("query_id", F.coalesce(F.try_divide("hits", "n"), F.lit(0.0)).alias("recall"))


def summary(found: DataFrame, truth: DataFrame, ks: tuple[int, ...] = (1, 10, 50, 100)) -> DataFrame:
    """(k, avg_recall, min_recall, max_recall), each as `recall_at_k` has it; found and truth are made once for all k."""
    t = truth.filter(F.col("rank") <= max(ks)).select("query_id", "doc_id", F.col("rank").alias("t"))
    f = found.filter(F.col("rank") <= max(ks)).select("query_id", "doc_id", F.col("rank").alias("f"))
    least = [(F.coalesce(F.col("t") <= k, F.lit(False)), F.coalesce(F.col("f") <= k, F.lit(False))) for k in ks]
    counts = [F.struct(F.count_if(t & f).alias("hits"), F.count_if(t).alias("n"), F.count_if(t | f).alias("any")).alias(f"k{i}") for i, (t, f) in enumerate(least)]
    both = t.join(f, ["query_id", "doc_id"], "full").groupBy("query_id").agg(*counts)
    recall = [F.when(F.col(f"k{i}.any") > 0, F.coalesce(F.try_divide(F.col(f"k{i}.hits"), F.col(f"k{i}.n")), F.lit(0.0))) for i in range(len(ks))]
    rows = [F.struct(F.lit(k).alias("k"), F.avg(r).alias("avg_recall"), F.min(r).alias("min_recall"), F.max(r).alias("max_recall")) for k, r in zip(ks, recall, strict=True)]
    return both.agg(F.array(*rows).alias("_each")).select(F.inline("_each"))


def latency(log: DataFrame, ms: Column, *by: str) -> DataFrame:
    """avg, exact interpolated percentiles, and queries a second (1000 / avg), overall or by group."""
    p = F.percentile(ms, F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    got = log.groupBy(*by).agg(F.count(ms).alias("n"), F.avg(ms).alias("avg_ms"), p.alias("p"))
    return got.select(*by, "n", "avg_ms", F.col("p")[0].alias("p50_ms"), F.col("p")[1].alias("p95_ms"), F.col("p")[2].alias("p99_ms"), F.try_divide(F.lit(1000.0), "avg_ms").alias("qps"))
