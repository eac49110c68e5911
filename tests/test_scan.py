"""Blocked search against the plain expressions, pair by pair."""

import math
from functools import reduce

import numpy as np
import pytest
from pyspark.sql import functions as F

from vecspark.functions import vectors
from vecspark.operators import knn, scan

CORPUS, ASKED = "doc_id long, vector array<double>", "query_id long, query_vector array<double>"


def rows_of():
    rng = np.random.default_rng(5)
    v = rng.normal(size=(40, 6)).tolist()
    odd = [[0.0] * 6, [None, *v[0][1:]], [1.0, 2.0], [], [math.nan, *v[1][1:]], [math.inf, *v[2][1:]], [1e-200] * 6, [1e160] * 6, [3e5, *v[3][1:]]]
    return [(i, x) for i, x in enumerate([*v, *v[:20], *odd, *odd, None])]


def plain(corpus, queries, k, metric, other):
    pairs = corpus.filter("vector IS NOT NULL").crossJoin(F.broadcast(queries.filter("query_vector IS NOT NULL")))
    pairs = pairs.filter("doc_id <> query_id") if other else pairs
    d = vectors.distance(metric)(F.col("query_vector"), F.col("vector"))
    return knn.top_k(pairs.select("query_id", "doc_id", d.alias("distance")), "query_id", k, F.col("distance"), F.col("doc_id"))


def told(df):
    return sorted((r.query_id, r["rank"], r.doc_id, repr(r.distance)) for r in df.collect())


@pytest.mark.parametrize("metric", ["cosine", "cosine_eps", "cosine_batch", "l2", "dot"])
def test_every_pair_counts_as_its_expression_says(spark, metric, monkeypatch):
    monkeypatch.setattr(scan, "CHUNK_BYTES", 100)
    rows = rows_of()
    if metric == "cosine":  # a zero vector has a null distance here to anything, in the expression not to one of infinite norm
        rows = [(i, v) for i, v in rows if not v or None in v or max(map(abs, v)) < 1e100]
    corpus, queries = spark.createDataFrame(rows, CORPUS).repartition(3), spark.createDataFrame(rows[::2], ASKED)
    for k, other in ((3, False), (30, True), (200, False)):
        assert told(knn.search(corpus, queries, k, metric, other)) == told(plain(corpus, queries, k, metric, other))


def test_exact_search_joins_blocks_and_not_pairs(spark):
    """no expression is evaluated for each pair of rows."""
    rows = [(i, [float(i), 1.0]) for i in range(40)]
    found = knn.search(spark.createDataFrame(rows, CORPUS), spark.createDataFrame(rows, ASKED), 3, "cosine")
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_scatter_gather_joins_blocks_and_not_pairs(spark):
    """each shard answers from blocks; copies on two shards count once."""
    from vecspark.operators import sharding

    rows = [(i, [float(i % 7), float(i)]) for i in range(60)]
    corpus, queries = spark.createDataFrame(rows, CORPUS), spark.createDataFrame(rows[::5], ASKED)
    found = sharding.search(sharding.replicate(sharding.route(corpus, 7), 7, 2), queries, 5)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert told(found) == told(plain(corpus, queries, 5, "l2", False))


def test_nodes_answer_blocks_and_not_pairs(spark):
    """nodes send their k nearest; an id on two nodes counts once."""
    from vecspark.operators import cluster

    rows = [(i, [float(i % 7), float(i)]) for i in range(60)]
    corpus, queries = spark.createDataFrame(rows, CORPUS), spark.createDataFrame(rows[::5], ASKED)
    placed = corpus.withColumn("node_id", F.explode(F.array(F.col("doc_id") % 3, F.col("doc_id") % 3 + 1)))
    found = cluster.search(placed, queries, 5)
    assert "zip_with" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert told(found) == told(plain(corpus, queries, 5, "l2", False))


def codes_of(spark, n=50):
    from vecspark.operators import pq

    p, rng = pq.PqParams(6, 3, 2), np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(1).tolist()) for i in range(n)]
    e = spark.createDataFrame(rows, CORPUS)
    books = pq.codebook_from(e, p, 4)
    asked = spark.createDataFrame(rows[::5], ASKED)
    table = {(r.query_id, r.m, r.code): r.distance for r in pq.distance_table(asked, books, p).collect()}
    codes = pq.encode(e, books, p)
    want = []
    for q, _ in rows[::5]:
        d = sorted((math.sqrt(reduce(lambda s, t: s + t * t, (table[q, m, c] for m, c in enumerate(r.codes)), 0.0)), r.doc_id) for r in codes.collect())
        want += [(q, i + 1, doc, repr(x)) for i, (x, doc) in enumerate(d[:7])]
    return p, codes, asked, books, sorted(want)


def test_codes_are_compared_by_blocks(spark):
    """64 codes and 50 rows, so that equal codes tie and go by id."""
    from vecspark.operators import pq

    p, codes, asked, books, want = codes_of(spark)
    found = pq.search(codes, asked, books, p, 7)
    assert "element_at" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert told(found) == want


def test_stored_codes_are_compared_by_blocks(spark, tmp_path):
    """of tables read back."""
    from vecspark.operators import pq
    from vecspark.sources import store

    p, codes, asked, books, want = codes_of(spark)
    s = store.Store(spark, f"file://{tmp_path}/pq")
    s.save({"codes": codes, "codebook": books})
    found = pq.search(s.load("codes"), asked, s.load("codebook"), p, 7)
    assert "element_at" not in found._jdf.queryExecution().optimizedPlan().toString()
    assert told(found) == want


def test_codes_are_saved_without_a_shuffle_and_searched_in_small_packs(spark, tmp_path, monkeypatch):
    """the codebook is read once, vectors are encoded where they are, and a pack of codes is as large as the vectors it stands for."""
    from vecspark.operators import pq
    from vecspark.sources import store

    p, codes, asked, books, want = codes_of(spark)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan(codes) and plan(codes).count("MapInArrow") == 1
    assert "Exchange" not in plan(books)
    packs, made = scan.packed, []

    def seen(*a, **b):
        made.append(packs(*a, **b))
        return made[-1]

    monkeypatch.setattr(scan, "packed", seen)
    monkeypatch.setattr(scan, "CHUNK_BYTES", 8 * 6 * 10)
    s = store.Store(spark, f"file://{tmp_path}/pq")
    s.save({"codes": codes.coalesce(1), "codebook": books})
    assert told(pq.search(s.load("codes"), asked, s.load("codebook"), p, 7)) == want
    assert sorted(len(r.ids) // 8 for r in made[-1].collect()) == [10] * 5


def test_codes_are_those_of_the_expression(spark):
    """encoded by matrix products: ties, copies, odd rows and odd centroids too."""
    from vecspark.operators import pq

    p, rows = pq.PqParams(6, 3, 3), rows_of()
    e = spark.createDataFrame(rows, CORPUS).repartition(3)
    whole = [v for _, v in rows[:5]]
    for more in ([], [whole[0], [2 * x - y for x, y in zip(whole[1], whole[2], strict=True)]], [[0.0] * 6, [math.inf] * 6], [[math.nan] * 6, [1e160] * 6]):
        learnt = [(m, c, v[2 * m : 2 * m + 2]) for m in range(3) for c, v in enumerate([*whole, *more])]
        books = spark.createDataFrame(learnt, "m int, code int, centroid array<double>")
        at = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: F.get(F.col("vector"), i))
        d = vectors.euclidean(F.coalesce(F.col("sub"), F.array(F.lit(math.nan))), F.col("centroid"))
        d = F.when(d.isNull(), math.nan).otherwise(d)
        each = pq.subvectors(e.select("doc_id", at.alias("vector")), p, "doc_id").join(books, "m").groupBy("doc_id", "m").agg(F.min(F.struct(d.alias("d"), "code"))["code"].alias("code"))
        want = {r.doc_id: [x.code for x in sorted(r.c)] for r in each.groupBy("doc_id").agg(F.collect_list(F.struct("m", "code")).alias("c")).collect()}
        assert {r.doc_id: r.codes for r in pq.encode(e, books, p).collect()} == want


def test_ties_and_odd_rows_of_codes(spark, monkeypatch):
    """candidates come by matrix products, distances as the subspaces' own add up."""
    from vecspark.operators import pq

    monkeypatch.setattr(scan, "CHUNK_BYTES", 400)
    rng = np.random.default_rng(8)
    p, books = pq.PqParams(4, 2, 2), [(m, c, v) for m in range(2) for c, v in enumerate([[0.0, 0.0], [3.0, 4.0], [4.0, 3.0], [math.inf, 1.0] if m else [1e160, 1.0]])]
    book = spark.createDataFrame(books, "m int, code int, centroid array<double>")
    rows = [(i, c.tolist()) for i, c in enumerate(rng.integers(0, 4, size=(200, 2)))]
    asks = [(0, [0.0] * 4), (1, [1.5, 2.0, 2.0, 1.5]), (2, rng.normal(size=4).tolist()), (3, [math.nan, 0.0, 0.0, 0.0]), (4, [1e160, 1.0, 0.0, 0.0]), (5, [1e-200] * 4)]
    asked = spark.createDataFrame(asks, ASKED)
    table = {(r.query_id, r.m, r.code): r.distance for r in pq.distance_table(asked, book, p).collect()}
    want = []
    for q, _ in asks:
        d = [(math.sqrt(reduce(lambda s, t: s + t * t, (table[q, m, c] for m, c in enumerate(codes)), 0.0)), i) for i, codes in rows]
        want += [(q, n + 1, i, repr(x)) for n, (x, i) in enumerate(sorted(d, key=lambda t: (math.isnan(t[0]), 0.0 if math.isnan(t[0]) else t[0], t[1]))[:60])]
    codes = spark.createDataFrame(rows, "doc_id long, codes array<int>").repartition(3)
    assert told(pq.search(codes, asked, book, p, 60)) == sorted(want)


def cells_of(spark):
    from vecspark.operators import ivf

    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(80)]
    e, asked = spark.createDataFrame([*rows, *((i + 80, v) for i, v in rows[:30])], CORPUS), spark.createDataFrame(rows[::8], ASKED)
    cells = spark.createDataFrame([(i, v) for i, v in rows[:5]], "cell_id int, centroid array<double>")
    return e, asked, cells, ivf.assign(e, cells)


def probed(index, asked, cells, k, n):
    """By the expression, pair by pair."""
    from vecspark.operators import ivf

    near = ivf.nearest_cells(asked, cells, "query_id", "query_vector", n).select("query_id", "cell_id")
    d = vectors.cosine_eps(F.col("query_vector"), F.col("vector"))
    return knn.top_k(index.join(asked.join(near, "query_id"), "cell_id").select("query_id", "doc_id", d.alias("distance")), "query_id", k, F.col("distance"), F.col("doc_id"))


def test_cells_are_read_by_blocks(spark):
    """the rows of a cell meet its queries in packs."""
    from vecspark.operators import ivf

    _, asked, cells, index = cells_of(spark)
    found = ivf.search(index, cells, asked, 10, 2)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert told(found) == told(probed(index, asked, cells, 10, 2))


def test_all_cells_probed_by_blocks_are_exact(spark):
    """every cell of five, and so every row once."""
    from vecspark.operators import ivf

    e, asked, cells, index = cells_of(spark)
    found = ivf.search(index, cells, asked, 50, 5)
    assert "MapInArrow" in found._jdf.queryExecution().executedPlan().toString()
    assert told(found) == told(plain(e, asked, 50, "cosine_eps", False))


def test_summary_of_block_searches(spark):
    """the same measures as by the expressions."""
    from vecspark.operators import evaluation, ivf

    e, asked, cells, index = cells_of(spark)
    got = evaluation.summary(ivf.search(index, cells, asked, 20, 2), knn.search(e, asked, 20, "cosine_eps"), (1, 10, 20))
    assert "MapInArrow" in got._jdf.queryExecution().executedPlan().toString()
    want = evaluation.summary(probed(index, asked, cells, 20, 2), plain(e, asked, 20, "cosine_eps", False), (1, 10, 20))
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_scores_of_all_pairs_come_by_blocks(spark):
    """every pair, with the expression's score; unlike ones null."""
    rows = [(i, v) for i, v in rows_of() if v is not None]
    corpus, queries = spark.createDataFrame(rows, CORPUS), spark.createDataFrame(rows[::3], ASKED)
    got = knn.similarities(corpus, queries)
    assert "zip_with" not in got._jdf.queryExecution().optimizedPlan().toString()
    score = F.round(vectors.similarity(vectors.euclidean(F.col("query_vector"), F.col("vector"))), 6)
    want = corpus.crossJoin(F.broadcast(queries)).select("query_id", "doc_id", score.alias("score"))
    said = lambda df: sorted((r.query_id, r.doc_id, "None" if r.score is None or r.score != r.score else repr(r.score)) for r in df.collect())
    assert said(got) == said(want)


def test_batch_gets_every_id_once(spark):
    """rows and their counts agree on the ranges, however either is coalesced."""
    from vecspark.operators import ivf

    cells = spark.createDataFrame([(0, [1.0] * 64)], "cell_id int, centroid array<double>")
    rows = spark.range(0, 16_000, 1, 4).select(F.col("id").alias("doc_id"), F.transform(F.sequence(F.lit(1), F.lit(64)), lambda x: F.sqrt(x + F.col("id"))).alias("vector"))
    new = rows.select((F.col("doc_id") * 3).alias("ord"), "vector")
    sizes = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "1m", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "256k"}
    for key, size in sizes.items():
        spark.conf.set(key, size)
    try:
        grown = ivf.add_batch(ivf.assign(rows, cells), new, cells).select("doc_id")
        ids = [r.doc_id for r in grown.collect()]
    finally:
        for key in sizes:
            spark.conf.unset(key)
    assert sorted(ids) == list(range(32_000))
    assert "RepartitionByExpression" not in grown._jdf.queryExecution().optimizedPlan().toString()


def test_large_codebooks_need_no_map_for_each_pair(spark):
    """8 bits, learnt from the vectors; fewer vectors than codes."""
    from vecspark.operators import pq

    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    e, asked, p = spark.createDataFrame(rows, CORPUS), spark.createDataFrame(rows[::30], ASKED), pq.PqParams(4, 2, 8)
    books = pq.train(e, p)
    found = pq.search(pq.encode(e, books, p), asked, books, p, 5)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "element_at" not in plan and "map_from_entries" not in plan
    assert all(r.doc_id == r.query_id for r in found.filter("rank = 1").collect())


def test_exact_check_brings_what_a_beam_misses(spark):
    """so thin a graph misses neighbours; copies go by id."""
    from vecspark.operators import hnsw

    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    rows += [(i + 200, v) for i, v in rows[:50]]
    e, asked, p = spark.createDataFrame(rows, CORPUS), spark.createDataFrame(rows[::9], ASKED), hnsw.HnswParams(m=2, ef_construction=2)
    nodes = hnsw.build(e, p)
    found, want = hnsw.search(nodes, asked, 5, 1, p), told(plain(e, asked, 5, "l2", False))
    assert told(found) != want
    assert told(hnsw.checked(found, nodes, asked, 5, p)) == want


def test_beams_grow_until_nine_of_ten_are_found(spark):
    """a thin graph with many copies misses neighbours, but every node can be reached, so wider beams find them."""
    from vecspark.operators import evaluation, hnsw

    rng = np.random.default_rng(7)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(200)]
    rows += [(i + 200, rows[3][1]) for i in range(60)]
    e, asked, p = spark.createDataFrame(rows, CORPUS), spark.createDataFrame(rows[::6], ASKED), hnsw.HnswParams(m=2, ef_construction=2, shard_rows=150)
    nodes, truth = hnsw.build(e, p), knn.search(e, asked, 10, "l2")
    assert hnsw.search(nodes, asked.limit(1), 260, 260, p).count() == 260
    reached = lambda found: evaluation.recall_at_k(found, truth, 10).filter("recall >= 0.9").count()
    assert reached(hnsw.search(nodes, asked, 10, 10, p)) < asked.count()
    found = hnsw.reaching(nodes, asked, truth, 10, 0.9, 10, p)
    assert reached(found) == asked.count()
    assert found.groupBy("query_id").count().filter("count <> 10").count() == 0


def test_summary_searches_once_for_all_depths(spark):
    """one plan of found and one of truth, however many k; a depth without rows is null, a query without truth 0."""
    from vecspark.operators import evaluation

    ranked = "query_id long, doc_id long, rank int"
    truth = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (2, 5, 1), (2, 6, 2)], ranked)
    found = spark.createDataFrame([(1, 2, 1), (1, 1, 2), (2, 5, 1), (2, 9, 2), (3, 7, 1)], ranked)
    got = evaluation.summary(found, truth, (0, 1, 2))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join FullOuter") == 1
    assert sorted(tuple(r) for r in got.collect()) == [(0, None, None, None), (1, pytest.approx(1 / 3), 0.0, 1.0), (2, 0.5, 0.0, 1.0)]


def test_cells_of_a_task_share_their_nearest(spark, monkeypatch):
    """a task answers k a query over all cells that it reads, not k for each of them."""
    from vecspark.operators import ivf

    e, asked, cells, index = cells_of(spark)
    pairs = asked.crossJoin(cells.select("cell_id"))
    one = index.coalesce(1)
    monkeypatch.setattr(scan, "dealt", lambda packs: packs)
    hits = lambda merged: scan.nearest(one, pairs, 7, "cosine_eps", "cell_id", "cell_id", merged=merged)
    near = lambda m: knn.top_k(hits(m).drop("part"), "query_id", 7, F.col("distance"), F.col("doc_id"))
    assert told(near(True)) == told(near(False)) == told(plain(e, asked, 7, "cosine_eps", False))
    assert hits(True).count() < hits(False).count()
    odd = spark.createDataFrame([(i, v) for i, v in rows_of() if v is not None], CORPUS).withColumn("cell", F.pmod("doc_id", F.lit(3)))
    few = odd.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query_vector")).filter("doc_id % 4 = 0").crossJoin(odd.select("cell").distinct())
    nearest = lambda m: told(knn.top_k(scan.nearest(odd, few, 5, "l2", "cell", "cell", merged=m), "query_id", 5, F.col("distance"), F.col("doc_id")))
    assert nearest(True) == nearest(False)


@pytest.mark.parametrize("metric", ["cosine", "cosine_eps", "cosine_batch", "l2", "dot"])
def test_cells_are_those_of_the_expression(spark, metric):
    """cells assigned in numpy, odd rows and odd centroids too."""
    from vecspark.operators import ivf

    rows = [(i, v) for i, v in rows_of() if metric != "cosine" or not v or None in v or max(map(abs, v)) < 1e100]
    e = spark.createDataFrame(rows, CORPUS).withColumn("tag", F.create_map(F.lit("a"), F.col("doc_id").cast("string")))
    measure = vectors.distance(metric)
    whole = [(9, rows[0][1]), (3, rows[1][1]), (4, rows[1][1]), (7, rows[2][1])]
    for centres in (whole, [*whole, (5, [0.0] * 6)], [*whole, (6, [1.0, 2.0]), (8, None)]):
        cells = spark.createDataFrame(centres, "cell_id int, centroid array<double>")
        near = F.min(F.struct(measure(F.col("vector"), F.col("centroid")).alias("d"), "cell_id"))["cell_id"]
        want = {r.doc_id: r.c for r in e.crossJoin(cells).groupBy("doc_id").agg(near.alias("c")).collect()}
        got = ivf.assign(e, cells, metric)
        assert got.columns == ["doc_id", "vector", "tag", "cell_id"] and got.schema["cell_id"].dataType == cells.schema["cell_id"].dataType
        assert {r.doc_id: r.cell_id for r in got.collect()} == want
        assert [r.tag for r in got.collect()] == [{"a": str(r.doc_id)} for r in got.collect()]
    assert ivf.assign(e, cells.limit(0), metric).filter("cell_id IS NULL").count() == len(rows)


def test_training_adds_up_the_sums_of_tasks(spark, monkeypatch):
    """a row a subspace from each task; the driver and the tasks add them up alike."""
    from vecspark.operators import pq

    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 4)) + 8 * rng.integers(0, 3, size=(300, 1))
    e = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], CORPUS).repartition(3)
    books = [x[:4, :2].copy(), x[:3, 2:].copy()]
    packs = scan.packed(e, None, "doc_id", "vector")
    rows = packs.mapInArrow(pq._sums(books), pq.SUMS).collect()
    assert len(rows) == 2 * packs.rdd.getNumPartitions()
    for m, b in enumerate(books):
        sub = x[:, 2 * m : 2 * m + 2]
        at = ((sub[:, None] - b) ** 2).sum(2).argmin(1)
        assert sum(np.frombuffer(r.n, np.int64) for r in rows if r.m == m).tolist() == np.bincount(at, minlength=len(b)).tolist()
        got = sum(np.frombuffer(r.s).reshape(b.shape) for r in rows if r.m == m)
        assert np.allclose(got, [sub[at == c].sum(0) for c in range(len(b))])
    p = pq.PqParams(4, 2, 2)
    sizes = lambda: sorted((r.m, r.code, *np.round(r.centroid, 6)) for r in pq.train(e, p).collect())
    one = sizes()
    monkeypatch.setattr(pq, "GATHERED", 0)
    assert sizes() == one and len(one) == 8
