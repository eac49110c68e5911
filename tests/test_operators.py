"""Rules that no registered query shows: refusals, empty inputs, round trips, plans."""

import pytest
from pyspark.sql import functions as F

from vecspark.functions import vectors
from vecspark.operators import bm25, chunking, cluster, fusion, hnsw, ivf, knn, pq, retrieval, service, sharding
from vecspark.sources import store

CORPUS = "doc_id long, vector array<double>"


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.createDataFrame([(i, [float(i % 5), float(i), 1.0]) for i in range(30)], CORPUS)


@pytest.fixture(scope="module")
def queries(spark):
    return spark.createDataFrame([(0, [0.0, 0.0, 1.0]), (1, [1.0, 7.5, 1.0])], "query_id long, query_vector array<double>")


@pytest.mark.parametrize(
    "bad",
    [
        lambda: vectors.distance("manhattan"),
        lambda: hnsw.HnswParams(metric="manhattan"),
        lambda: pq.PqParams(10, 3),
        lambda: fusion.FusionParams("median"),
        lambda: chunking.ChunkParams("page"),
        lambda: store.read(None, "x", "hdf5"),
    ],
)
def test_unknown_choices_are_refused(bad):
    with pytest.raises(ValueError):
        bad()


def test_refusals_need_no_job(corpus, queries):
    with pytest.raises(ValueError):
        sharding.route(corpus, 3, "alphabet")
    with pytest.raises(ValueError):
        cluster.consistency(corpus, "most")
    with pytest.raises(ValueError):
        retrieval.retrieve(corpus, queries, mode="during")
    with pytest.raises(ValueError):
        service.Database(corpus).search(queries, 1001)
    with pytest.raises(service.NotReady):
        service.Database().health()


def test_blocks_do_not_change_the_answer(corpus, queries, monkeypatch):
    whole = knn.search(corpus, queries, 4).orderBy("query_id", "rank").collect()
    monkeypatch.setattr(knn, "QUERY_BLOCK", 1)
    monkeypatch.setattr(knn.blocks, "__defaults__", (1,))
    assert knn.search(corpus, queries, 4).orderBy("query_id", "rank").collect() == whole


def test_top_k_is_limited_before_the_shuffle(corpus, queries):
    plan = knn.search(corpus, queries, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2 and "BroadcastNestedLoopJoin" in plan


def test_one_query_has_no_shuffle(corpus):
    plan = knn.search_one(corpus, F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)), 3)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in plan and "Exchange" not in plan


def test_zero_vectors(spark):
    v = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = v.select(vectors.cosine(F.col("a"), F.col("b")).alias("c"), vectors.cosine_eps(F.col("a"), F.col("b")).alias("e"), vectors.normalize(F.col("a")).alias("n")).first()
    assert r.c is None and r.e == 1.0 and r.n == [None, None]


def test_empty_corpus(spark, queries):
    none = spark.createDataFrame([], CORPUS)
    assert knn.search(none, queries, 3).count() == 0
    assert hnsw.search(hnsw.build(none), queries, 3).count() == 0
    assert bm25.search(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(0, "a")], "query_id long, query_text string"), 3).count() == 0


def test_graph_finds_and_forgets(corpus, queries):
    nodes = hnsw.build(corpus, hnsw.HnswParams(m=4, ef_construction=16, shard_rows=10))
    exact = knn.search(corpus, queries, 3).select("query_id", "doc_id").collect()
    assert {tuple(r) for r in hnsw.search(nodes, queries, 3).select("query_id", "doc_id").collect()} == {tuple(r) for r in exact}
    gone = corpus.filter("doc_id = 0")
    assert 0 not in {r.doc_id for r in hnsw.search(hnsw.delete(nodes, gone), queries, 3).collect()}


def test_graph_takes_nodes_and_queries_batch_by_batch(spark, corpus):
    p = hnsw.HnswParams(m=4, ef_construction=16, shard_rows=10)
    asked = corpus.select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query_vector"))
    none = spark.createDataFrame([(99, None)], "query_id long, query_vector array<double>")
    nodes = hnsw.build(corpus, p)
    exact = knn.search(corpus, asked, 4).collect()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = hnsw.search(nodes, asked.unionByName(none), 4, 40, p).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert nodes.select("shard").distinct().count() > 1
    assert {(r.query_id, r["rank"], r.doc_id) for r in got} == {(r.query_id, r["rank"], r.doc_id) for r in exact}


def test_stored_bm25_index_gives_the_same_hits(spark):
    corpus_ = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None), (4, "")], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "a c"), (1, "b b"), (2, "")], "query_id long, query_text string")
    assert bm25.search_of(bm25.tokenized(corpus_), asked, 3).collect() == bm25.search(corpus_, asked, 3).collect() != []


def test_all_cells_are_exact(corpus, queries):
    centroids = corpus.filter("doc_id in (3, 14, 25)").select(F.col("doc_id").cast("int").alias("cell_id"), F.col("vector").alias("centroid"))
    index = ivf.assign(corpus, centroids, "l2")
    got = ivf.search(index, centroids, queries, 5, 3, "l2").select("query_id", "doc_id", "rank").collect()
    assert set(got) == set(knn.search(corpus, queries, 5).select("query_id", "doc_id", "rank").collect())


def test_metadata_rules(spark):
    rows = spark.sql("SELECT 1 AS i, map('a', '1', 'b', CAST(NULL AS STRING)) AS m UNION ALL SELECT 2, map('a', '2') UNION ALL SELECT 3, CAST(NULL AS MAP<STRING, STRING>)")
    at = lambda w: sorted(r.i for r in rows.filter(retrieval.matches(F.col("m"), w)).collect())
    assert at({}) == [1, 2, 3] and at({"a": "1"}) == [1] and at({"b": None}) == [1] and at({"c": None}) == []


@pytest.mark.parametrize("text", ["", "   ", "x" * 2000, "a b " * 700, "One. Two! Three? " * 100, "no end", "\n\n".join(["p" * 300] * 5)])
@pytest.mark.parametrize("strategy", ["fixed", "sentence", "paragraph"])
def test_chunks_end_and_cover(text, strategy):
    p = chunking.ChunkParams(strategy)
    chunks = chunking.chunk_text(text, p)
    assert [c["chunk_id"] for c in chunks] == list(range(len(chunks)))
    assert bool(chunks) == bool(text.strip())
    if strategy == "fixed":
        assert all(len(c["text"]) <= p.size for c in chunks)


def test_store(spark, tmp_path):
    s = store.Store(spark, f"file://{tmp_path}/base", max_versions=2)
    versions = [s.save({"t": spark.range(n)}) for n in (1, 2, 3)]
    assert [r["version"] for r in s.manifest()] == versions[1:] and s.load("t").count() == 3
    s.snapshot("two", versions[1])
    assert s.delete(versions[1]) and not s.delete("none") and s.load("t", s.restore("two")).count() == 2
    assert s.size().first().files > 0 and s.versions().count() == 2
    with pytest.raises(FileNotFoundError):
        s.load("t", versions[0])


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_graph_grows_by_insert(spark):
    import numpy as np

    from vecspark.operators import hnsw, knn

    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    schema = "doc_id long, vector array<double>"
    all_, asked = spark.createDataFrame(rows, schema), spark.createDataFrame([(i, v) for i, v in rows if i % 20 == 0], "query_id long, query_vector array<double>")
    for p in (hnsw.HnswParams(), hnsw.HnswParams(shard_rows=150)):
        first = hnsw.build(spark.createDataFrame(rows[:300], schema), p)
        grown = hnsw.insert(first, spark.createDataFrame(rows[250:], schema), p)
        got = grown.select("doc_id", "shard").collect()
        assert sorted(r.doc_id for r in got) == list(range(400))
        found = {(r.query_id, r.rank): r.doc_id for r in hnsw.search(grown, asked, 5, 400, p).collect()}
        assert found == {(r.query_id, r["rank"]): r.doc_id for r in knn.search(all_, asked, 5, "l2").collect()}
    empty = hnsw.build(spark.createDataFrame([], schema))
    assert hnsw.insert(empty, all_).count() == 400
    assert hnsw.insert(first, spark.createDataFrame([], schema)).count() == 300


def test_mean_pool_of_awkward_masks(spark):
    from vecspark.operators import embedding

    rows = [(1, [[1.0, 2.0], [3.0, 4.0]], [1, 1]), (2, [[1.0, 2.0], [3.0, 4.0]], [0, 1]), (3, [[1.0, 2.0]], [0]), (4, [], []), (5, None, None)]
    df = spark.createDataFrame(rows, "id int, s array<array<double>>, m array<int>")
    got = {r.id: r.v for r in df.select("id", embedding.mean_pool(df.s, df.m).alias("v")).collect()}
    assert got == {1: [2.0, 3.0], 2: [3.0, 4.0], 3: [0.0, 0.0], 4: None, 5: None}
    unit = df.filter("id = 2").select(embedding.mean_pool(df.s, df.m, unit=True).alias("v")).first().v
    assert [round(x, 6) for x in unit] == [0.6, 0.8]


def test_presets():
    import pytest

    from vecspark.operators import embedding

    assert embedding.preset("code").dim == 768
    assert embedding.preset(batch_size=8).batch_size == 8
    with pytest.raises(ValueError):
        embedding.preset("music")


def test_health_and_acknowledged_delete(spark):
    import datetime

    from pyspark.sql import functions as F
    from vecspark.operators import cluster

    nodes = spark.createDataFrame([("a", "h", 1, False, [0]), ("b", "h", 2, True, [1]), ("c", "h", 3, True, [2])], cluster.NODES)
    now = datetime.datetime(2024, 1, 1, 0, 1, 0)
    beats = spark.createDataFrame([("a", now - datetime.timedelta(seconds=30)), ("a", now - datetime.timedelta(seconds=90)), ("b", now - datetime.timedelta(seconds=31))], "node_id string, at timestamp")
    got = {r.node_id: r.is_healthy for r in cluster.health(nodes, beats, F.lit(now)).collect()}
    assert got == {"a": True, "b": False, "c": False}
    corpus, ids = spark.createDataFrame([(1,), (2,), (3,)], "doc_id long"), spark.createDataFrame([(1,), (2,)], "doc_id long")
    acks = spark.createDataFrame([(1, True), (1, True), (1, False), (3, True)], "doc_id long, success boolean")
    left, said = cluster.delete(corpus, ids, acks)
    assert sorted(r.doc_id for r in left.collect()) == [2, 3]
    assert [(r.doc_id, r.successes) for r in said.collect()] == [(1, 2)]


def test_entry_takes_leftovers_for_no_package(tmp_path, monkeypatch):
    import __spark_entry__

    (tmp_path / "leftover" / "__pycache__").mkdir(parents=True)
    monkeypatch.syspath_prepend(str(tmp_path))
    assert not __spark_entry__._there("leftover")
    assert not __spark_entry__._there("nowhere_at_all")
    assert __spark_entry__._there("vecspark.plans")
