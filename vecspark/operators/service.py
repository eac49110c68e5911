"""Request tables to response tables: the service surface without a server."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecspark.operators import fusion, knn, retrieval

VERSION = "1.0.0"
MAX_K = 1000


class NotReady(RuntimeError):
    """No corpus is attached."""


class Database:
    """A corpus (doc_id, text, vector, metadata) behind the service calls."""

    def __init__(self, corpus: DataFrame | None = None):
        self._corpus = corpus

    @property
    def corpus(self) -> DataFrame:
        if self._corpus is None:
            raise NotReady("the database has no corpus")
        return self._corpus

    def health(self) -> DataFrame:
        return self.corpus.agg(F.lit("healthy").alias("status"), F.lit(VERSION).alias("version"), F.count(F.lit(1)).alias("index_size"))

    def index(self, docs: DataFrame) -> Database:
        """With documents added; an id that is there already is replaced."""
        kept = self.corpus.join(docs.select("doc_id"), "doc_id", "left_anti").select(*self.corpus.columns)
        return Database(kept.unionByName(docs.select(*self.corpus.columns)))

    def delete(self, ids: DataFrame) -> tuple[Database, DataFrame]:
        """Without some documents, and the response (deleted_count, success)."""
        gone = self.corpus.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
        response = gone.agg(F.count(F.lit(1)).alias("deleted_count")).withColumn("success", F.col("deleted_count") > 0)
        return Database(self.corpus.join(ids.select("doc_id"), "doc_id", "left_anti").select(*self.corpus.columns)), response

    def document(self, doc_id: int) -> DataFrame:
        return self.corpus.filter(F.col("doc_id") == doc_id).select("doc_id", "text", key_values(F.col("metadata")).alias("metadata"), F.lit(0.0).alias("score"))

    def search(self, requests: DataFrame, k: int = 10, hybrid: bool = False, where: dict | None = None) -> DataFrame:
        """(query_id, doc_id, score, rank) of each request; k outside 1..1000 is refused; dense scores are distances."""
        if not 1 <= k <= MAX_K:
            raise ValueError(f"k must lie in 1..{MAX_K}")
        pool = self.corpus.filter(retrieval.matches(F.col("metadata"), where)) if where else self.corpus
        if hybrid:
            return fusion.hybrid(pool, requests, k).select("query_id", "doc_id", "score", "rank")
        return knn.search(pool, requests, k, "cosine").select("query_id", "doc_id", F.col("distance").alias("score"), "rank")

    def bulk_search(self, requests: DataFrame, dim: int, k: int = 10) -> DataFrame:
        """search, with a row (error set) for each request whose vector is missing or has another length."""
        bad = F.col("query_vector").isNull() | (F.size("query_vector") != dim)
        good = self.search(requests.filter(~bad), k).withColumn("error", F.lit(None).cast("string"))
        errors = requests.filter(bad).select("query_id", F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("int").alias("rank"), F.lit(f"query vector must have {dim} elements").alias("error"))
        return good.unionByName(errors)


def stats(log: DataFrame, ms: Column) -> DataFrame:
    """One row of a query log: queries, queries a second of busy time (at least a second), mean latency."""
    seconds = F.sum(ms) / 1000
    return log.agg(F.count(ms).alias("total_queries"), (F.count(ms) / F.greatest(F.lit(1.0), seconds)).alias("qps"), F.avg(ms).alias("avg_latency_ms"))


def key_values(metadata: Column) -> Column:
    """A metadata map as sorted (key, value) entries."""
    return F.sort_array(F.map_entries(metadata))


def parse_key_values(items: Column) -> Column:
    """A map from items `key=value`, split at the first "="; items without one are skipped, the last of a key stays."""
    good = F.filter(items, lambda x: F.contains(x, F.lit("=")))
    pair = lambda x: F.struct(F.substring_index(x, "=", 1).alias("key"), F.substr(x, F.instr(x, "=") + 1).alias("value"))
    entries = F.transform(good, pair)
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.greatest(F.size(entries), F.lit(1))), lambda o: o["key"] == e["key"]))
    return F.map_from_entries(last)
