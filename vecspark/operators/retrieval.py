"""Retrieval: over-fetch, filter, threshold, rerank, cut, and context."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from vecspark.functions import vectors
from vecspark.functions.text import tokens
from vecspark.operators import fusion, knn
from vecspark.operators.knn import top_k

TOP_K = 5


def matches(metadata: Column, wanted: dict[str, str | None]) -> Column:
    """All keys present with equal values; a present null equals None; nothing wanted matches all."""
    out = F.lit(True)
    for key, value in wanted.items():
        out = out & F.coalesce(F.map_contains_key(metadata, F.lit(key)), F.lit(False)) & metadata[key].eqNullSafe(F.lit(value))
    return out


def lexical_overlap(query: Column, text: Column) -> Column:
    """Share of the query's different tokens that the text holds: the default reranker."""
    q = F.array_distinct(tokens(query))
    return F.when(F.size(q) > 0, F.size(F.array_intersect(q, tokens(text))) / F.size(q)).otherwise(0.0)


def model_scorer(make_predict: Callable, batch_size: int = 32) -> Callable[[Column, Column], Column]:
    """A scorer for rerank from a function that loads a pair model and returns a batch predictor.

    The predictor takes two arrays of texts (queries, documents) and returns their scores.
    """
    return predict_batch_udf(make_predict, return_type=DoubleType(), batch_size=batch_size)


def rerank(hits: DataFrame, queries: DataFrame, scorer: Callable[[Column, Column], Column] = lexical_overlap) -> DataFrame:
    """hits with `score` replaced by the scorer's, ranked anew."""
    again = hits.drop("rank").join(queries.select("query_id", "query_text"), "query_id").withColumn("score", scorer(F.col("query_text"), F.col("text"))).drop("query_text")
    return top_k(again, "query_id", 1 << 30, F.col("score").desc(), F.col("doc_id"))


def retrieve(corpus: DataFrame, queries: DataFrame, k: int | None = None, where: dict[str, str | None] | None = None, threshold: float | None = None, mode: str = "post", metric: str = "cosine", reranker: Callable | None = None) -> DataFrame:
    """(query_id, doc_id, text, score, metadata, rank): dense retrieval, 2k fetched before the filter.

    mode "post" filters what was fetched, so fewer than k may be left; "pre" filters
    the corpus, where the scan can use it.
    """
    if mode not in ("post", "pre"):
        raise ValueError(f"unknown filter mode {mode!r}")
    k = k or TOP_K
    wanted = matches(F.col("metadata"), where or {})
    pool = corpus.filter(wanted) if mode == "pre" else corpus
    near = knn.search(pool, queries, 2 * k, metric).select("query_id", "doc_id", vectors.similarity(F.col("distance")).alias("score"))
    hits = near.join(corpus.select("doc_id", "text", "metadata"), "doc_id")
    if mode == "post":
        hits = hits.filter(wanted)
    if threshold is not None:
        hits = hits.filter(F.col("score") >= threshold)
    if reranker is not None:
        hits = rerank(hits, queries, reranker).drop("rank")
    return top_k(hits, "query_id", k, F.round("score", 9).desc(), F.col("doc_id"))


def hybrid_retrieve(corpus: DataFrame, queries: DataFrame, k: int | None = None, alpha: float = 0.5, method: str = "linear_similarity") -> DataFrame:
    """Hybrid search with dense weight alpha; 2k are asked of the search, which reads lists of 4k."""
    k = k or TOP_K
    p = fusion.FusionParams(method, alpha, 1 - alpha)
    return top_k(fusion.hybrid(corpus, queries, 2 * k, p=p).drop("rank"), "query_id", k, F.round("score", 9).desc(), F.col("doc_id"))


def with_context(hits: DataFrame, chunks: DataFrame, window: int = 1) -> DataFrame:
    """Each hit (query_id, doc_id, chunk_id) with the joined text of the chunks around it.

    The range is unrolled to an equi-join on (doc_id, chunk_id).
    """
    near = hits.select("query_id", "doc_id", "chunk_id", F.explode(F.sequence(F.col("chunk_id") - window, F.col("chunk_id") + window)).alias("at"))
    c = chunks.select("doc_id", F.col("chunk_id").alias("at"), "text")
    joined = near.join(c, ["doc_id", "at"])
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda s: s["text"]), " ")
    return joined.groupBy("query_id", "doc_id", "chunk_id").agg(text.alias("context"))
