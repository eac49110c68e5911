"""Approximate nearest neighbours over balanced posting lists.

Centroids are trained by balanced k-means on a bounded sample of different vectors
(`sample`), and each gets a height, a last coordinate that vectors and queries do not
have, which grows until the lists of the sample are of like length: without it the
centroids near the middle would be nearest to most of a noisy table. Every vector then lies in the posting list of its nearest centroid and, if
it is a boundary vector, in those of every other centroid whose distance is within
`closure` of the nearest, up to `replicas` lists. A query finds its nearest centroids
with a best-first search over an in-memory neighbour graph of the centroids, and
keeps, by distance ratio, those not much farther than the nearest; where these hold fewer
than `least_rows` rows, as the list of an outlier that is its own centroid, the next
nearest lists are read too, all of them if need be, so that every query finds `k` rows
wherever there are as many. A list longer than
`list_rows` is split by a hash into parts that are searched apart, and so are the
queries of a list beyond `list_queries`, so a task's group is bounded whatever the list
and however many ask it; both meet by a shuffle on (list, part, block of queries), and
each query keeps its best of every part before the last shuffle.

There is a list for each `vectors_per_list` vectors up to `max_lists`, which is what the
driver can train and hold; beyond `max_lists` * `vectors_per_list` vectors lists grow
with the input, and a fixed share of queries then costs work in its square.

Equal vectors are searched once: of a vector that many rows hold only its least ids
can be among the nearest (ties go to the smaller id), so `k` + 1 of them travel, and
the answer is that over all rows. Distances are Euclidean, of the original vectors in
double precision.

Defined cases: rows whose vector is null, empty, zero, of another length than the
most common one, or has null or non-finite components, and rows with a null id, take
no part; repeated rows (the same id and vector) are one candidate; fewer candidates
than `k` are all returned; an empty table gives an empty result; other input columns
are ignored.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.llm._shared import arrow_map, saved

RESULT = "query_id long, rank int, vec_id long, score double"


@dataclass(frozen=True)
class AnnParams:
    """`probe_ratio` and `probes` bound the lists a query reads beyond `least_rows`; the rest is the build."""

    k: int = 10
    sample: int = 20_000
    sample_per_list: int = 8
    vectors_per_list: int = 200
    max_lists: int = 16_384
    closure: float = 1.12
    replicas: int = 4
    probe_ratio: float = 1.35
    probes: int = 64
    least_rows: int = 1_000
    beam: int = 96
    list_rows: int = 2_000
    list_queries: int = 2_000
    iterations: int = 8
    seed: int = 3


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances by the product form: for choosing, not for scores."""
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T, 0)


def nearest(d: np.ndarray, n: int) -> np.ndarray:
    """Places of the least `n` of each row, in order."""
    at = np.argpartition(d, n - 1, 1)[:, :n] if n < d.shape[1] else np.broadcast_to(np.arange(d.shape[1]), d.shape)
    return np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), 1, kind="stable"), 1)


def balanced_kmeans(x: np.ndarray, k: int, iterations: int, seed: int) -> np.ndarray:
    """Centroids whose lists are of like length: a penalty grows with a list's share."""
    r = np.random.default_rng(seed)
    c = x[r.choice(len(x), k, replace=False)].copy()
    scale = distances(x[:2000], c).min(1).mean() / max(len(x) / k, 1)
    load = np.zeros(k)
    for step in range(iterations):
        at = np.concatenate([(distances(x[i : i + 4096], c) + 0.1 * scale * np.maximum(load - len(x) / k, 0)).argmin(1) for i in range(0, len(x), 4096)])
        load = np.bincount(at, minlength=k).astype(np.float64)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        full = load > 0
        c[full] = sums[full] / load[full, None]
        if not full.all():  # an empty list moves into the longest ones
            c[~full] = x[r.choice(np.flatnonzero(np.isin(at, np.argsort(-load)[: max(1, k // 8)])), (~full).sum())]
    return c


def heights(x: np.ndarray, c: np.ndarray, steps: int = 20, rate: float = 0.05) -> np.ndarray:
    """What to add to squared distances so that lists are of like length: step by step, those of long lists grow."""
    h, scale = np.zeros(len(c)), distances(x[:2000], c).min(1).mean()
    for step in range(steps):
        at = np.concatenate([(distances(x[i : i + 4096], c) + h).argmin(1) for i in range(0, len(x), 4096)])
        load = np.bincount(at, minlength=len(c)) * len(c) / len(x)
        h += rate * scale * np.clip(load - 1, -1, 2) / (1 + step / 8)
        h -= h.min()
    return h


def lifted(x: np.ndarray) -> np.ndarray:
    """Vectors on the ground, under the heights that centroids have as a last coordinate."""
    return np.hstack([x, np.zeros((len(x), 1))])


class CentroidGraph:
    """Neighbour graph of the centroids, searched best first from fixed entries."""

    def __init__(self, centroids: np.ndarray, degree: int = 24, seed: int = 3):
        self.c = centroids
        k = len(centroids)
        near = np.concatenate([nearest(distances(centroids[i : i + 512], centroids), degree + 1)[:, 1:] for i in range(0, k, 512)])
        links: list[set[int]] = [set(map(int, n)) for n in near]
        for i, n in enumerate(near):
            for j in n[: degree // 2]:
                links[int(j)].add(i)
        r = np.random.default_rng(seed)
        for i in range(k):  # long links keep the graph in one part
            links[i].update(int(j) for j in r.integers(0, k, 2))
            links[i].add((i + 1) % k)
            links[i].discard(i)
        self.links = [np.array(sorted(s), np.int64) for s in links]
        self.entries = np.unique(np.linspace(0, k - 1, min(k, 16)).astype(np.int64))

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The nearest `beam` centroids found, with their distances, nearest first."""
        dist = lambda at: np.sqrt(((self.c[at] - q) ** 2).sum(1))
        seen = set(map(int, self.entries))
        open_ = [(float(d), int(i)) for d, i in zip(dist(self.entries), self.entries)]
        heapq.heapify(open_)
        best = [(-d, i) for d, i in open_]
        heapq.heapify(best)
        while open_:
            d, i = heapq.heappop(open_)
            if len(best) >= beam and d > -best[0][0]:
                break
            new = np.array([j for j in self.links[i] if j not in seen], np.int64)
            if not len(new):
                continue
            seen.update(map(int, new))
            for e, j in zip(dist(new), new):
                if len(best) < beam or e < -best[0][0]:
                    heapq.heappush(open_, (float(e), int(j)))
                    heapq.heappush(best, (-float(e), int(j)))
                    if len(best) > beam:
                        heapq.heappop(best)
        found = sorted((-d, i) for d, i in best)
        return np.array([i for _, i in found]), np.array([d for d, _ in found])


def valid(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, v): the rows that take part, once each."""
    v = F.col(vec_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.filter(finite & F.exists("v", lambda x: x != 0))
    lengths = rows.groupBy(F.size("v").alias("n")).agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("k"), "n").limit(1).collect()
    return rows.filter(F.size("v") == (lengths[0].n if lengths else 0))


def distinct_vectors(rows: DataFrame, keep: int) -> DataFrame:
    """(vk, v, ids): each different vector and the least `keep` ids of its rows."""
    k = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("vk", F.unhex(F.md5(F.to_json("v"))))
    order = Window.partitionBy("vk").orderBy("id")
    # The group limit runs before the shuffle too: a vector of very many rows sends few.
    few = k.withColumn("r", F.dense_rank().over(order)).filter(F.col("r") <= keep)
    return few.groupBy("vk").agg(F.first("v").alias("v"), F.sort_array(F.collect_set("id")).alias("ids"))


def train(vectors: DataFrame, n: int, p: AnnParams) -> CentroidGraph:
    """Centroids from at most `sample`, or `sample_per_list` for each list, different vectors, those of least hash."""
    k = int(np.clip(n // p.vectors_per_list, 1, p.max_lists))
    rows = vectors.select("v", F.xxhash64("vk").alias("h")).orderBy("h").limit(max(p.sample, p.sample_per_list * k)).select("v").toArrow()
    x = _matrix(rows.column(0).combine_chunks())
    k = min(k, len(x))
    c = balanced_kmeans(x, k, p.iterations, p.seed)
    return CentroidGraph(np.hstack([c, np.sqrt(heights(x, c))[:, None]]), seed=p.seed)


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def postings(vectors: DataFrame, graph, p: AnnParams) -> DataFrame:
    """(list, vk, v, ids): each vector in its nearest list and its boundary lists."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, c = lifted(_matrix(batch.column(1))), graph.value.c
        r = min(p.replicas, len(c))
        rows, lists = [], []
        for a in range(0, len(x), 2048):
            d = np.sqrt(distances(x[a : a + 2048], c))
            near = np.argpartition(d, r - 1, 1)[:, :r]
            dn = np.take_along_axis(d, near, 1)
            i, j = np.nonzero(dn <= dn.min(1, keepdims=True) * p.closure)
            rows.append(i + a)
            lists.append(near[i, j])
        at = pa.array(np.concatenate(rows))
        return pa.record_batch([pa.array(np.concatenate(lists).astype(np.int32)), *(batch.column(i).take(at) for i in range(3))], names=["list", "vk", "v", "ids"])

    return arrow_map(vectors.select("vk", "v", "ids"), run, "list int, vk binary, v array<double>, ids array<long>")


def chosen(graph: CentroidGraph, sizes: np.ndarray, q: np.ndarray, p: AnnParams) -> np.ndarray:
    """The lists that a query reads: those that pruning leaves, and more until they hold enough rows.

    A vector is in at most `replicas` lists, so `replicas` * (k + 1) rows hold k + 1 vectors.
    """
    near, d = graph.search(q, p.beam)
    least = max(p.least_rows, p.replicas * (p.k + 1))
    if sizes[near].sum() < least:
        near = np.argsort(((graph.c - q) ** 2).sum(1), kind="stable")
        d = np.sqrt(((graph.c[near] - q) ** 2).sum(1))
    by_ratio = min(int((d <= d[0] * p.probe_ratio).sum()), p.probes)
    by_rows = int(np.searchsorted(np.cumsum(sizes[near]), least)) + 1
    return near[: max(by_ratio, by_rows)]


def probes(queries: DataFrame, graph, sizes, p: AnnParams) -> DataFrame:
    """(list, qk, q): the lists that each query reads."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows, lists = [], []
        for i, q in enumerate(lifted(_matrix(batch.column(1)))):
            take = chosen(graph.value, sizes.value, q, p)
            rows += [i] * len(take)
            lists += take.tolist()
        at = pa.array(rows, pa.int64())
        return pa.record_batch([pa.array(lists, pa.int32()), batch.column(0).take(at), batch.column(1).take(at)], names=["list", "qk", "q"])

    return arrow_map(queries.select("vk", "v"), run, "list int, qk binary, q array<double>")


FOUND = "qk binary, vk binary, ids array<long>, score double"


def scan_part(left: pd.DataFrame, right: pd.DataFrame, k: int) -> pd.DataFrame:
    """The nearest `k` + 1 vectors of one part for each of its queries."""
    if not len(left) or not len(right):
        return pd.DataFrame({c: pd.Series(dtype=object) for c in ("qk", "vk", "ids")} | {"score": pd.Series(dtype=float)})
    x = np.stack(left["v"].to_numpy())
    least = np.array([i[0] for i in left["ids"]])
    qk, at, score = [], [], []
    for key, q in zip(right["qk"], right["q"]):
        d = np.sqrt(((x - q) ** 2).sum(1))
        best = np.lexsort((least, d))[: k + 1]
        qk += [key] * len(best)
        at += best.tolist()
        score += d[best].tolist()
    took = left.iloc[at]
    return pd.DataFrame({"qk": qk, "vk": took["vk"].to_numpy(), "ids": took["ids"].to_numpy(), "score": score})


def counted(most: dict[int, int]) -> Column:
    """The number of each list in `most`, 1 for others; there are at most `max_lists`."""
    if not most:
        return F.lit(1)
    return F.coalesce(F.create_map(*(F.lit(x) for kv in most.items() for x in kv))[F.col("list")], F.lit(1))


def search(df: DataFrame, query_of: str, params: AnnParams | None = None, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """RESULT columns: the nearest rows of each row for which the SQL condition `query_of` on `id` holds."""
    p = params or AnnParams()
    rows = valid(df, id_col, vec_col)
    spark = df.sparkSession
    vectors = saved(distinct_vectors(rows, p.k + 1), "vectors")
    n = vectors.count()
    if not n:
        return spark.createDataFrame([], RESULT)
    graph = spark.sparkContext.broadcast(train(vectors, n, p))
    lists = saved(postings(vectors, graph, p), "postings")
    length = np.zeros(len(graph.value.c), np.int64)  # at most `max_lists`
    for r in lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).collect():
        length[r.list] = r.n
    long_ = {int(i): int(-(-length[i] // p.list_rows)) for i in np.flatnonzero(length > p.list_rows)}
    n_parts = counted(long_)
    # Each query vector once: its rows share the answer.
    asking = rows.filter(query_of).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumn("vk", F.unhex(F.md5(F.to_json("v"))))
    queries = asking.groupBy("vk").agg(F.first("v").alias("v"))
    asked_lists = saved(probes(queries, graph, spark.sparkContext.broadcast(length), p), "probes")
    many = {r.list: -(-r.n // p.list_queries) for r in asked_lists.groupBy("list").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > p.list_queries).collect()}
    n_blocks = counted(many)
    every = lambda n: F.explode(F.sequence(F.lit(0), (n - 1).cast("int")))
    left = lists.withColumn("part", F.pmod(F.xxhash64("vk"), n_parts).cast("int")).withColumn("block", every(n_blocks))
    right = asked_lists.withColumn("block", F.pmod(F.xxhash64("qk"), n_blocks).cast("int")).withColumn("part", every(n_parts))

    def run(_: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return scan_part(a, b, p.k)

    found = left.groupBy("list", "part", "block").cogroup(right.groupBy("list", "part", "block")).applyInPandas(run, FOUND)
    order = Window.partitionBy("qk").orderBy("score", F.col("ids")[0], "vk")
    best = found.dropDuplicates(["qk", "vk"]).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= p.k + 1)
    rows_of = best.select("qk", "score", F.explode("ids").alias("vec_id"))
    first = Window.partitionBy("qk").orderBy("score", "vec_id")
    answers = rows_of.withColumn("r", F.row_number().over(first)).filter(F.col("r") <= p.k + 1).groupBy("qk").agg(F.sort_array(F.collect_list(F.struct("score", "vec_id"))).alias("near"))
    asked = asking.select(F.col("id").alias("query_id"), "vk").distinct()
    # A query's own row is among the first k + 1, or does not matter.
    own = F.slice(F.filter("near", lambda x: x["vec_id"] != F.col("query_id")), 1, p.k)
    got = asked.join(answers, asked["vk"] == answers["qk"]).select("query_id", F.posexplode(own).alias("pos", "hit"))
    return got.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"))
