"""Fusion of a dense and a sparse ranking."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vecspark.operators import bm25, knn
from vecspark.operators.knn import top_k

RRF_K = 60
METHODS = ("rrf", "linear", "linear_similarity", "max")


@dataclass(frozen=True)
class FusionParams:
    method: str = "rrf"
    dense_weight: float = 0.5
    sparse_weight: float = 0.5

    def __post_init__(self):
        if self.method not in METHODS:
            raise ValueError(f"unknown fusion method {self.method!r}; known: {', '.join(METHODS)}")


def min_max(df: DataFrame, column: str) -> DataFrame:
    """`column` scaled to 0..1 within each query; all equal gives 1."""
    w = Window.partitionBy("query_id")
    low, high = F.min(column).over(w), F.max(column).over(w)
    return df.withColumn(column, F.when(high == low, 1.0).otherwise((F.col(column) - low) / (high - low)))


def rrf(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, doc_id, score): sum of 1 / (k + rank) over both lists."""
    both = dense.select("query_id", "doc_id", "rank").unionByName(sparse.select("query_id", "doc_id", "rank"))
    return both.groupBy("query_id", "doc_id").agg(F.sum(1 / (F.lit(k) + F.col("rank"))).alias("score"))


def combined(dense: DataFrame, sparse: DataFrame, p: FusionParams) -> DataFrame:
    """(query_id, doc_id, score) of the union of both lists; a missing part counts 0.

    "linear" scales the distance itself, "linear_similarity" its negative.
    """
    value = F.col("distance") if p.method == "linear" else -F.col("distance")
    d = min_max(dense.select("query_id", "doc_id", value.alias("d")), "d")
    s = min_max(sparse.select("query_id", "doc_id", F.col("score").alias("s")), "s")
    d0, s0 = F.coalesce("d", F.lit(0.0)), F.coalesce("s", F.lit(0.0))
    score = F.greatest(d0, s0) if p.method == "max" else p.dense_weight * d0 + p.sparse_weight * s0
    return d.join(s, ["query_id", "doc_id"], "full").select("query_id", "doc_id", score.alias("score"))


def fuse(dense: DataFrame, sparse: DataFrame, k: int, p: FusionParams = FusionParams()) -> DataFrame:
    """The k best of the fused ranking, by score to 9 places and id."""
    found = rrf(dense, sparse) if p.method == "rrf" else combined(dense, sparse, p)
    return top_k(found, "query_id", k, F.round("score", 9).desc(), F.col("doc_id"))


def hybrid(corpus: DataFrame, queries: DataFrame, k: int = 10, dense_k: int | None = None, sparse_k: int | None = None, p: FusionParams = FusionParams(), metric: str = "cosine") -> DataFrame:
    """Dense and sparse search (2k each by default), fused, cut to k, then joined to the text.

    corpus: doc_id, text, vector. queries: query_id, query_text, query_vector.
    """
    dense = knn.search(corpus, queries, dense_k or 2 * k, metric)
    sparse = bm25.search(corpus, queries, sparse_k or 2 * k)
    return fuse(dense, sparse, k, p).join(corpus.select("doc_id", "text"), "doc_id")
