"""Shard routing, scatter-gather search and rebalancing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecspark.functions import vectors
from vecspark.operators import scan
from vecspark.operators.knn import blocks, top_k

STRATEGIES = ("hash", "random", "round_robin", "range")


def by_hash(doc_id: Column, n: int) -> Column:
    """md5 of the id as text, as a 128-bit number, modulo n (from its two halves)."""
    digest = F.md5(doc_id.cast("string"))
    half = lambda at: F.conv(F.substring(digest, at, 16), 16, 10).cast("decimal(20,0)")
    return ((half(1) % n * (2**64 % n) + half(17) % n) % n).cast("int")


def by_range(doc_id: Column, boundaries: list[int]) -> Column:
    """The first i with id < boundaries[i]; beyond all, shard 0."""
    out = None
    for i, b in enumerate(boundaries):
        out = F.when(doc_id < b, i) if out is None else out.when(doc_id < b, i)
    return (out.otherwise(0) if out is not None else F.lit(0)).cast("int")


def positions(df: DataFrame, key: str) -> DataFrame:
    """df with `_at`, each row's position from 0 in order of `key`, by counts of key ranges: no task sees all rows.

    The ranges are fixed first, from some keys: those that repartitionByRange draws can
    differ between the rows and their counts.
    """
    n = df.count()
    pieces = min(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), n // 1_000)
    ends = []
    if pieces > 1:
        some = df.select(key).filter(F.col(key).isNotNull()).sample(min(1.0, 100 * pieces / n), 1).distinct().orderBy(key).collect()
        ends = [some[len(some) * i // pieces][0] for i in range(1, pieces)] if some else []
    at = sum((F.coalesce(F.col(key) >= F.lit(e), F.lit(False)).cast("int") for e in ends), F.lit(0))
    local = df.withColumn("_p", at).withColumn("_r", F.row_number().over(Window.partitionBy("_p").orderBy(key)))
    sizes = df.select(at.alias("_p")).groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_p", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return local.join(F.broadcast(before), "_p").withColumn("_at", F.col("_before") + F.col("_r") - 1).drop("_p", "_r", "_before")


def round_robin(df: DataFrame, n: int) -> DataFrame:
    """shard_id by position in id order."""
    return positions(df, "doc_id").withColumn("shard_id", (F.col("_at") % n).cast("int")).drop("_at")


def route(df: DataFrame, n: int, strategy: str = "hash", boundaries: list[int] | None = None, seed: int = 0) -> DataFrame:
    """df with its shard_id."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown sharding strategy {strategy!r}; known: {', '.join(STRATEGIES)}")
    if strategy == "round_robin":
        return round_robin(df, n)
    if strategy == "random":
        return df.withColumn("shard_id", F.floor(F.rand(seed) * n).cast("int"))
    return df.withColumn("shard_id", by_hash(F.col("doc_id"), n) if strategy == "hash" else by_range(F.col("doc_id"), boundaries or []))


def replicate(df: DataFrame, n: int, factor: int) -> DataFrame:
    """A row for each replica: shards primary, primary + 1, ... modulo n, at most n of them."""
    return df.withColumn("shard_id", F.explode(F.transform(F.sequence(F.lit(0), F.lit(min(factor, n) - 1)), lambda i: (F.col("shard_id") + i) % n)))


def search(sharded: DataFrame, queries: DataFrame, k: int, metric: str = "l2", shard: int | None = None) -> DataFrame:
    """Scatter-gather: k of each shard, one row of each id, then the k nearest; `shard` asks only one."""
    vectors.distance(metric)
    pool = sharded if shard is None else sharded.filter(F.col("shard_id") == shard)
    out = None
    for q in blocks(queries):
        answers = scan.nearest(pool, q, k, metric, "shard_id").withColumnRenamed("part", "shard_id")
        local = top_k(answers, ["query_id", "shard_id"], k, F.col("distance"), F.col("doc_id"))
        one = local.groupBy("query_id", "doc_id").agg(F.min("distance").alias("distance"))
        near = top_k(one, "query_id", k, F.col("distance"), F.col("doc_id"))
        out = near if out is None else out.unionByName(near)
    return out


def delete(sharded: DataFrame, ids: DataFrame) -> DataFrame:
    """Without some ids, in whatever shard they lie."""
    return sharded.join(ids.select("doc_id"), "doc_id", "left_anti").select(*sharded.columns)


def stats(sharded: DataFrame, n: int) -> DataFrame:
    """(shard_id, doc_count, share) of every shard, empty ones included."""
    counts = sharded.groupBy("shard_id").agg(F.count(F.lit(1)).alias("n"))
    total = sharded.agg(F.count(F.lit(1)).alias("total"))
    shards = sharded.sparkSession.range(n).select(F.col("id").cast("int").alias("shard_id"))
    return shards.join(counts, "shard_id", "left").crossJoin(F.broadcast(total)).select("shard_id", F.coalesce("n", F.lit(0)).alias("doc_count"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def rebalance(sharded: DataFrame, n: int) -> DataFrame:
    """One row of each id, routed anew by hash over n shards and laid out by shard."""
    one = sharded.dropDuplicates(["doc_id"]).drop("shard_id")
    return route(one, n).repartition("shard_id")


def generate_ids(df: DataFrame, existing: DataFrame) -> DataFrame:
    """Unique ids for new rows (ord, ...): max existing + position."""
    top = existing.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).alias("_top"))
    at = round_robin(df.withColumnRenamed("ord", "doc_id"), 1 << 31).withColumnRenamed("shard_id", "_at")
    return at.crossJoin(F.broadcast(top)).withColumn("new_id", F.col("_top") + 1 + F.col("_at")).drop("_top", "_at").withColumnRenamed("doc_id", "ord")


def save(sharded: DataFrame, path: str) -> None:
    """A folder for each shard, so that a reader of some shards opens no other."""
    sharded.repartition("shard_id", F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("shard_id").parquet(path)


def load(spark: SparkSession, path: str, shards: list[int] | None = None) -> DataFrame:
    """All shards, or the given ones by partition pruning."""
    rows = spark.read.parquet(path)
    return rows if shards is None else rows.filter(F.col("shard_id").isin(shards))
