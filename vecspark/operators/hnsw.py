"""Navigable small-world graphs, one for each shard of a corpus.

A shard is built in one task over a bounded number of vectors, node after node, and the
number of shards follows the corpus. Levels come from a hash of the
id, so a graph does not depend on the run.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.functions import vectors
from vecspark.operators import evaluation, scan
from vecspark.operators.knn import blocks, top_k

NODES = "shard int, doc_id long, level int, vector array<double>, links array<array<long>>"
HITS = "query_id long, doc_id long, distance double"
#: Nodes of a shard that look for their neighbours at once.
LINKED = 512


@dataclass(frozen=True)
class HnswParams:
    m: int = 16
    ef_construction: int = 200
    ef_search: int = 50
    metric: str = "l2"
    shard_rows: int = 20_000
    seed: int = 7

    def __post_init__(self):
        vectors.distance(self.metric)


def _distances(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    if metric in ("l2", "euclidean"):
        return np.sqrt(((x - q) ** 2).sum(1))
    d = -(x @ q)
    if metric == "dot":
        return d
    return 1 + d / np.maximum(np.sqrt((x * x).sum(1) * (q @ q)), 1e-300)


def _order(x: np.ndarray, q: np.ndarray, metric: str) -> np.ndarray:
    """What sorts the rows x about as their distances to each of q do."""
    d = q @ x.T
    if metric in ("l2", "euclidean"):
        return (x * x).sum(1) - 2 * d
    return -d if metric == "dot" else -d / np.maximum(np.sqrt((x * x).sum(1)), 1e-150)


class Graph:
    """The graph of one shard: vectors, levels, and neighbour lists by layer."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, levels: np.ndarray, links: list[list[list[int]]] | None, p: HnswParams):
        self.ids, self.x, self.levels, self.p = ids, x, levels, p
        self.links = links if links is not None else [[[] for _ in range(int(v) + 1)] for v in levels]
        self.entry = int(np.argmax(levels)) if links is not None and len(levels) else -1

    def beam(self, q: np.ndarray, entries: list[int], ef: int, layer: int) -> list[tuple[float, int]]:
        """The ef nearest nodes of a layer that best-first search reaches, nearest first."""
        d = _distances(self.x[entries], q, self.p.metric)
        open_ = list(zip(d.tolist(), entries))
        heapq.heapify(open_)
        kept = [(-a, -b) for a, b in open_]
        heapq.heapify(kept)
        seen = set(entries)
        while open_:
            near, node = heapq.heappop(open_)
            if len(kept) >= ef and near > -kept[0][0]:
                break
            new = [j for j in self.links[node][layer] if j not in seen]
            if not new:
                continue
            seen.update(new)
            for a, j in zip(_distances(self.x[new], q, self.p.metric).tolist(), new):
                if len(kept) < ef or (-a, -j) > kept[0]:
                    heapq.heappush(open_, (a, j))
                    heapq.heappush(kept, (-a, -j))
                    if len(kept) > ef:
                        heapq.heappop(kept)
        return sorted((-a, -b) for a, b in kept)

    def link(self, start: int) -> None:
        """Link the nodes from `start` on, in order, to the nearest of those before them, in every layer that both have.

        Candidates come by matrix products, so a shard costs the square of its bounded rows.
        """
        x, p = self.x, self.p
        for layer in range(int(self.levels.max(initial=-1)) + 1):
            at, most = np.flatnonzero(self.levels >= layer), p.m * (2 if layer == 0 else 1)
            far = {int(i): dict(zip(self.links[i][layer], _distances(x[self.links[i][layer]], x[i], p.metric).tolist())) for i in at}
            for a in range(int(np.searchsorted(at, start)), len(at), LINKED):
                new = at[a : a + LINKED]
                old = at[: a + len(new)]
                near = _order(x[old], x[new], p.metric)
                near[np.arange(len(new))[:, None] + a <= np.arange(len(old))] = np.inf
                n = min(p.ef_construction, len(old))
                some = np.argpartition(near, n - 1, axis=1)[:, :n]
                for r, i in enumerate(new.tolist()):
                    js = old[some[r][some[r] < a + r]]
                    d = _distances(x[js], x[i], p.metric)
                    first = np.lexsort((js, d))[: p.m]
                    for j, dj in zip(js[first].tolist(), d[first].tolist()):
                        far[i][j] = far[j][i] = dj
                        if len(far[j]) > most:
                            gone = max(far[j], key=lambda t, of=far[j]: (of[t], t))
                            del far[j][gone], far[gone][j]
            for i, to in far.items():
                self.links[i][layer] = list(to)
        self.entry = int(np.argmax(self.levels)) if len(self.levels) else -1
        self.join()

    def join(self) -> None:
        """Link what the lowest layer's links leave apart, as copies beyond a full list, each to the nearest node with room."""
        n = len(self.ids)
        inside, room = np.zeros(n, bool), np.full(n, self.p.m)

        def reach(i: int) -> None:
            inside[i], open_ = True, [i]
            while open_:
                for j in self.links[open_.pop()][0]:
                    if not inside[j]:
                        inside[j] = True
                        open_.append(j)

        if n:
            reach(self.entry)
        for i in range(n):
            if not inside[i]:
                js = np.flatnonzero(inside & (room > 0))
                j = int(js[np.argmin(_distances(self.x[js], self.x[i], self.p.metric))])
                self.links[i][0].append(j)
                self.links[j][0].append(i)
                room[j] -= 1
                reach(i)

    def search(self, q: np.ndarray, k: int, ef: int) -> list[tuple[float, int]]:
        if self.entry < 0:
            return []
        at = [self.entry]
        for layer in range(int(self.levels[self.entry]), 0, -1):
            at = [self.beam(q, at, 1, layer)[0][1]]
        return self.beam(q, at, max(ef, k), 0)[:k]


def with_shards(corpus: DataFrame, p: HnswParams) -> DataFrame:
    """The corpus with its shard and level, both by hash of the id; at most 16 levels."""
    shards = max(1, math.ceil(corpus.count() / p.shard_rows))
    u = (F.pmod(F.xxhash64(F.lit(p.seed), "doc_id"), F.lit(1 << 40)) + 1) / float((1 << 40) + 1)
    level = F.least(F.lit(16), F.floor(-F.log2(u))).cast("int")
    shard = F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")
    return corpus.select(shard.alias("shard"), "doc_id", level.alias("level"), vectors.doubles(F.col("vector")).alias("vector"))


def _extend(old: pd.DataFrame, new: pd.DataFrame, p: HnswParams) -> pd.DataFrame:
    """The node table of one shard with new rows (shard, doc_id, level, vector) linked in, in id order."""
    new = new.sort_values("doc_id", ignore_index=True)
    new["links"] = [[[] for _ in range(int(v) + 1)] for v in new["level"]]
    pdf = pd.concat([old, new], ignore_index=True) if len(old) else new
    ids = pdf["doc_id"].to_numpy()
    g = Graph(ids, np.stack(pdf["vector"].to_numpy()), pdf["level"].to_numpy(), _places(ids, pdf["links"]), p)
    g.link(len(old))
    links = [[[int(ids[j]) for j in layer] for layer in node] for node in g.links]
    return pdf.assign(links=links)[["shard", "doc_id", "level", "vector", "links"]]


def _places(ids: np.ndarray, links) -> list[list[list[int]]]:
    """Links by id as links by place; those to ids that are not there go."""
    at = {int(d): i for i, d in enumerate(ids)}
    return [[[at[j] for j in layer if j in at] for layer in node] for node in links]


def build(corpus: DataFrame, p: HnswParams = HnswParams()) -> DataFrame:
    """Node table NODES: links[layer] are the ids of a node's neighbours in the layer."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return _extend(pdf.iloc[:0], pdf, p)

    return with_shards(corpus, p).groupBy("shard").applyInPandas(run, NODES)


def insert(nodes: DataFrame, new: DataFrame, p: HnswParams = HnswParams()) -> DataFrame:
    """A stored node table with new vectors (doc_id, vector); ids that are there are replaced.

    While the shards have room for p.shard_rows each, new vectors join them by hash of the
    id, and shards that get none are not rebuilt. Beyond that they form shards of their own,
    so no task's graph grows with the table. A search asks all shards, so either is found.
    """
    old = delete(nodes, new)
    size = old.agg(F.count(F.lit(1)), F.max("shard")).first()
    shards = 0 if size[1] is None else size[1] + 1
    if size[0] + new.count() > shards * p.shard_rows:
        return old.unionByName(build(new, p).withColumn("shard", F.col("shard") + shards))
    placed = with_shards(new, p).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    touched = placed.select("shard").distinct()

    def run(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        return _extend(a, b, p)

    grown = old.join(touched, "shard", "left_semi").groupBy("shard").cogroup(placed.groupBy("shard")).applyInPandas(run, NODES)
    return old.join(touched, "shard", "left_anti").select(*old.columns).unionByName(grown)


def search(nodes: DataFrame, queries: DataFrame, k: int, ef: int | None = None, p: HnswParams = HnswParams()) -> DataFrame:
    """(query_id, doc_id, distance, rank): every shard's beam search, then the global k nearest.

    Each query goes to each shard and follows its nodes into the shard's task, so a graph
    is made once however many ask, and queries pass it batch by batch. Save a built table
    first: its greatest shard is looked up before the search. Null vectors take no part.
    """
    last = nodes.agg(F.max("shard")).first()[0]
    if last is None:
        return queries.sparkSession.createDataFrame([], HITS + ", rank int")
    each = F.explode(F.sequence(F.lit(0), F.lit(last))).alias("shard")
    asked = queries.filter("query_vector IS NOT NULL").select(each, F.lit(1).alias("kind"), F.col("query_id").cast("long").alias("id"), F.lit(None).cast("int").alias("level"), vectors.doubles(F.col("query_vector")).alias("vector"), F.lit(None).cast("array<array<long>>").alias("links"))
    both = nodes.select("shard", F.lit(0).alias("kind"), F.col("doc_id").alias("id"), "level", "vector", "links").unionByName(asked)
    sorted_ = both.repartitionById(last + 1, F.col("shard")).sortWithinPartitions("shard", "kind", "id")
    found = sorted_.mapInPandas(_searcher(k, ef or p.ef_search, p), HITS)
    return top_k(found, "query_id", k, F.col("distance"), F.col("doc_id"))


def reaching(nodes: DataFrame, queries: DataFrame, truth: DataFrame, k: int, recall: float, ef: int, p: HnswParams = HnswParams()) -> DataFrame:
    """`search`, whose beam grows fourfold for the queries with less than `recall` of their truth, until it takes in a shard."""
    asked = queries
    size = nodes.groupBy("shard").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]
    out = search(nodes, asked, k, ef, p).persist()
    while ef < size:
        short = evaluation.recall_at_k(out, truth, k).filter(F.col("recall") < recall).select("query_id").persist()
        if short.isEmpty():
            break
        ef *= 4
        asked = queries.join(short, "query_id", "left_semi")
        out = out.join(short, "query_id", "left_anti").select(*out.columns).unionByName(search(nodes, asked, k, ef, p)).persist()
    return out


def checked(found: DataFrame, nodes: DataFrame, queries: DataFrame, k: int, p: HnswParams = HnswParams()) -> DataFrame:
    """What `search` found, held against all nodes: nearer ones that the beams missed come in, distances are exact.

    A pass over every node for each query, block by block, whose cost is that of exact search.
    """
    queries = queries.filter("query_vector IS NOT NULL")
    both = found.select("query_id", "doc_id", F.lit(None).cast("double").alias("exact"), "distance")
    for q in blocks(queries):
        near = scan.nearest(nodes, q, k, p.metric).select("query_id", "doc_id", F.col("distance").alias("exact"), F.lit(None).cast("double").alias("distance"))
        both = both.unionByName(near)
    one = both.groupBy("query_id", "doc_id").agg(F.coalesce(F.min("exact"), F.min("distance")).alias("distance"))
    return top_k(one, "query_id", k, F.col("distance"), F.col("doc_id"))


def _searcher(k: int, ef: int, p: HnswParams):
    """The search over rows sorted by shard, in each the nodes before the queries."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, parts, g = None, [], None
        for batch in batches:
            for at, rows in batch.groupby("shard", sort=False):
                if at != shard:
                    shard, parts, g = at, [], None
                asks = rows["kind"].to_numpy() == 1
                if not asks.all():
                    parts.append(rows[~asks])
                if not asks.any() or (g is None and not parts):
                    continue
                if g is None:
                    of = pd.concat(parts, ignore_index=True)
                    ids = of["id"].to_numpy()
                    g, parts = Graph(ids, np.stack(of["vector"].to_numpy()), of["level"].to_numpy().astype(np.int64), _places(ids, of["links"]), p), []
                hits = [(qid, int(g.ids[j]), d) for qid, v in zip(rows["id"][asks], rows["vector"][asks]) for d, j in g.search(np.asarray(v, np.float64), k, ef)]
                if hits:
                    yield pd.DataFrame(hits, columns=["query_id", "doc_id", "distance"])

    return run


def delete(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """Nodes without the deleted ones, and without links to them.

    The links to deleted nodes are found by a join on the link's end, so the deleted ids
    may be very many; a node's links are bounded.
    """
    left = nodes.join(ids.select("doc_id"), "doc_id", "left_anti").select(*nodes.columns)
    ends = left.select("shard", "doc_id", F.explode(F.array_distinct(F.flatten("links"))).alias("end"))
    dead = ends.join(ids.select(F.col("doc_id").alias("end")).distinct(), "end").groupBy("doc_id").agg(F.collect_set("end").alias("dead"))
    pruned = F.transform("links", lambda layer: F.when(F.col("dead").isNull(), layer).otherwise(F.array_except(layer, F.col("dead"))))
    return left.join(dead, "doc_id", "left").withColumn("links", pruned).select(*nodes.columns)
