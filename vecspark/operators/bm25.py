"""BM25 over a document corpus; corpus statistics are always derived, never stored stale."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions.text import tokens
from vecspark.operators.knn import top_k


@dataclass(frozen=True)
class Bm25Params:
    k1: float = 1.5
    b: float = 0.75


def tokenized(corpus: DataFrame) -> DataFrame:
    """(doc_id, terms): the index that a store keeps for `scores_of` and `search_of`."""
    return corpus.select("doc_id", tokens(F.col("text")).alias("terms"))


def lengths(corpus: DataFrame) -> DataFrame:
    return tokenized(corpus).select("doc_id", F.coalesce(F.size("terms"), F.lit(0)).cast("long").alias("dl"))


def postings(corpus: DataFrame) -> DataFrame:
    """(doc_id, term, tf)."""
    return tokenized(corpus).select("doc_id", F.explode("terms").alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("tf"))


def doc_freqs(corpus: DataFrame) -> DataFrame:
    """(term, df): each document's distinct terms are found in its row, so only they are shuffled."""
    return tokenized(corpus).select(F.explode(F.array_distinct("terms")).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df"))


def corpus_stats(corpus: DataFrame) -> DataFrame:
    """One row: num_docs, avg_doc_length."""
    return _stats(lengths(corpus))


def _stats(lengths_: DataFrame) -> DataFrame:
    return lengths_.agg(F.count(F.lit(1)).alias("num_docs"), F.avg("dl").alias("avg_doc_length"))


def scores(corpus: DataFrame, queries: DataFrame, p: Bm25Params = Bm25Params()) -> DataFrame:
    """`scores_of` a corpus (doc_id, text) that is not tokenized yet."""
    return scores_of(tokenized(corpus), queries, p)


def scores_of(index: DataFrame, queries: DataFrame, p: Bm25Params = Bm25Params()) -> DataFrame:
    """(query_id, doc_id, score) of the documents that hold any query term.

    index: doc_id, terms, which both the statistics and the hits read. queries: query_id,
    query_text. Repeated query terms count repeatedly. A term's weight in a query is
    small, so document rows are reduced to the query terms before the second shuffle. The query terms follow the number of queries, so no broadcast is
    asked for: Spark sends them to all where its own size limit allows.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("query_text"))).alias("term")).groupBy("query_id", "term").agg(F.count(F.lit(1)).alias("qtf"))
    wanted = asked.select("term").distinct()
    docs = index.select("doc_id", F.size("terms").cast("double").alias("dl"), "terms")
    hits = docs.select("doc_id", "dl", F.explode("terms").alias("term")).join(wanted, "term").groupBy("doc_id", "term", "dl").agg(F.count(F.lit(1)).alias("tf"))
    df = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    stats = _stats(index.select(F.coalesce(F.size("terms"), F.lit(0)).alias("dl")))
    terms = asked.join(df, "term").crossJoin(F.broadcast(stats))
    idf = F.log((F.col("num_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf") * (p.k1 + 1) / (F.col("tf") + p.k1 * (1 - p.b + p.b * F.col("dl") / F.col("avg_doc_length")))
    return hits.join(terms, "term").groupBy("query_id", "doc_id").agg(F.sum(F.col("qtf") * idf * tf).alias("score"))


def search(corpus: DataFrame, queries: DataFrame, k: int, p: Bm25Params = Bm25Params()) -> DataFrame:
    """(query_id, doc_id, score, rank): positive scores only; equal scores (to 9 places) by id."""
    return search_of(tokenized(corpus), queries, k, p)


def search_of(index: DataFrame, queries: DataFrame, k: int, p: Bm25Params = Bm25Params()) -> DataFrame:
    """`search` in a stored index (doc_id, terms)."""
    hits = scores_of(index, queries, p).filter("score > 0")
    return top_k(hits, "query_id", k, F.round("score", 9).desc(), F.col("doc_id"))


def retrieve(corpus: DataFrame, queries: DataFrame, k: int = 5, p: Bm25Params = Bm25Params()) -> DataFrame:
    """search with the document's text."""
    return search(corpus, queries, k, p).join(corpus.select("doc_id", "text"), "doc_id")


def delete(corpus: DataFrame, ids: DataFrame) -> DataFrame:
    """The corpus without some documents; statistics follow, as they are derived."""
    return corpus.join(ids.select("doc_id"), "doc_id", "left_anti")
