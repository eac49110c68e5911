"""Text embedding: a deterministic hashing embedder, a model hook, and a cache table."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from vecspark.functions import vectors
from vecspark.functions.text import tokens

DIM = 64


@dataclass(frozen=True)
class EmbedParams:
    """What a model hook loads and how it is called."""

    model: str
    dim: int
    batch_size: int = 32
    max_tokens: int = 512
    normalize: bool = True


#: The public models that callers choose by kind of text, with their dimensions.
PRESETS = {
    "default": EmbedParams("all-MiniLM-L6-v2", 384),
    "multilingual": EmbedParams("sentence-transformers/paraphrase-multilingual-MiniLM-L12-v2", 384),
    "code": EmbedParams("microsoft/codebert-base", 768),
}


def preset(kind: str = "default", **changes) -> EmbedParams:
    if kind not in PRESETS:
        raise ValueError(f"unknown preset {kind!r}; known: {', '.join(PRESETS)}")
    return replace(PRESETS[kind], **changes)


def hashed(text: Column, dim: int = DIM, unit: bool = True) -> Column:
    """Signed feature hashing of the tokens (md5), L2-normalised; JVM-side."""
    t = tokens(text)
    bucket = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long") % dim
    sign = lambda x: F.when(F.conv(F.substring(F.md5(x), 9, 1), 16, 10).cast("int") < 8, 1.0).otherwise(-1.0)
    pairs = F.transform(t, lambda x: F.struct(bucket(x).alias("b"), sign(x).alias("s")))
    add = lambda v, p: F.transform(v, lambda x, i: F.when(i == p["b"], x + p["s"]).otherwise(x))
    v = F.aggregate(pairs, F.array_repeat(F.lit(0.0), dim), add)
    return F.coalesce(vectors.normalize(v, vectors.EPSILON), F.array_repeat(F.lit(0.0), dim)) if unit else v


def model_udf(make_predict: Callable, batch_size: int = 32):
    """An embedder from a function that loads a model and returns a batch predictor."""
    return predict_batch_udf(make_predict, return_type=ArrayType(FloatType()), batch_size=batch_size)


def preset_udf(load: Callable[[EmbedParams], Callable], p: EmbedParams = PRESETS["default"]):
    """model_udf of a preset: `load(p)` runs once a Python worker and returns a batch predictor."""
    return model_udf(lambda: load(p), p.batch_size)


def mean_pool(states: Column, mask: Column, unit: bool = False) -> Column:
    """The mean of the token vectors whose mask is 1; JVM-side.

    The divisor is at least 1e-9, so a text without tokens has a zero vector; a null array
    gives null, and so does one without any vector.
    """
    kept = F.zip_with(states, mask, lambda v, m: F.transform(v, lambda x: x * m))
    total = F.aggregate(F.slice(kept, 2, F.greatest(F.size(kept) - 1, F.lit(0))), F.get(kept, F.lit(0)), lambda a, v: F.zip_with(a, v, lambda x, y: x + y))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda a, x: a + x), F.lit(1e-9))
    v = F.transform(total, lambda x: x / n)
    return F.coalesce(vectors.normalize(v, vectors.EPSILON), v) if unit else v


def key(text: Column) -> Column:
    return F.sha2(text, 256)


def misses(texts: DataFrame, cache: DataFrame) -> DataFrame:
    """The different texts that the cache (key, vector, hits) does not hold."""
    return texts.select("text", key(F.col("text")).alias("key")).dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def lookup(texts: DataFrame, cache: DataFrame, embed: Callable[[Column], Column] = hashed, max_size: int = 10_000) -> tuple[DataFrame, DataFrame]:
    """(texts with vector, the new cache): misses are embedded, hits counted, least used evicted."""
    fresh = misses(texts, cache).select("key", embed(F.col("text")).alias("vector"), F.lit(0).cast("long").alias("hits"))
    used = texts.groupBy(key(F.col("text")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    full = cache.unionByName(fresh).join(used, "key", "left").select("key", "vector", (F.col("hits") + F.coalesce("n", F.lit(0))).alias("hits"))
    found = texts.withColumn("key", key(F.col("text"))).join(full.select("key", "vector"), "key").drop("key")
    return found, full.orderBy(F.desc("hits"), "key").limit(max_size)
