"""Exact nearest neighbours: a stated query set against all rows, in blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions import vectors
from vecspark.operators import scan

#: Query rows broadcast at once; more go block after block.
QUERY_BLOCK = 8_192


def top_k(df: DataFrame, by: str | list[str], k: int, *order: Column) -> DataFrame:
    """The first k rows of each group with their `rank` from 1.

    Spark limits each group before the shuffle, so a task sends k rows a group.
    """
    w = Window.partitionBy(by).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def blocks(queries: DataFrame, size: int = QUERY_BLOCK) -> list[DataFrame]:
    """The query rows in blocks of bounded size, each safe to broadcast."""
    n = queries.count()
    if n <= size:
        return [queries]
    parts = -(-2 * n // size)
    at = F.pmod(F.xxhash64("query_id"), F.lit(parts))
    return [queries.filter(at == i) for i in range(parts)]


def search_one(corpus: DataFrame, vector: Column, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest of one query vector: TakeOrderedAndProject, no shuffle of the corpus."""
    d = vectors.distance(metric)(F.col("vector"), vector)
    return corpus.select("doc_id", d.alias("distance")).orderBy("distance", "doc_id").limit(k)


def search(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "l2", exclude_self: bool = False) -> DataFrame:
    """(query_id, doc_id, distance, rank) of the k nearest of each query.

    corpus: doc_id, vector. queries: query_id, query_vector. Null vectors take no part.
    """
    corpus, queries = corpus.filter("vector IS NOT NULL"), queries.filter("query_vector IS NOT NULL")
    vectors.distance(metric)
    out = None
    for q in blocks(queries):
        near = top_k(scan.nearest(corpus, q, k, metric, other=exclude_self).drop("part"), "query_id", k, F.col("distance"), F.col("doc_id"))
        out = near if out is None else out.unionByName(near)
    return out


def similarities(corpus: DataFrame, queries: DataFrame, digits: int = 6) -> DataFrame:
    """(query_id, doc_id, score) of every pair: 1 / (1 + l2), to so many places."""
    out = None
    for q in blocks(queries):
        each = scan.similarities(corpus, q, digits)
        out = each if out is None else out.unionByName(each)
    return out
