"""Indexes against each other: throughput of building, recall against latency, concurrent searches.

    BENCH_SF_DIR=/root/testdata/sf0.1 python bench_index.py

One JSON line. "index": vectors a second by kind of index and share of the corpus;
"sweep": recall of the ten nearest and milliseconds a query by search parameter;
"concurrent": searches a second by number of threads that submit them.
"""

from __future__ import annotations

import json
import os
import sys
import time
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

HERE = os.path.dirname(os.path.abspath(__file__))
os.environ["PYTHONPATH"] = os.pathsep.join(filter(None, [HERE, os.environ.get("PYTHONPATH", "")]))
sys.path.insert(0, HERE)

from vecspark.functions import vectors  # noqa: E402
from vecspark.operators import evaluation, hnsw, ivf, knn, pq  # noqa: E402
from vecspark.plans.registry import scratch_base  # noqa: E402
from vecspark.sources.store import Store  # noqa: E402

K = 10


def seconds(f) -> float:
    began = time.time()
    f()
    return time.time() - began


def run(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def kept(df: DataFrame, name: str) -> DataFrame:
    """A table saved and read back, so that searches do not build it again."""
    s = Store(df.sparkSession, scratch_base(df.sparkSession, name))
    s.save({name: df})
    return s.load(name)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g")).config("spark.scheduler.mode", "FAIR").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    e = kept(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("doc_id"), vectors.doubles(F.col("embedding")).alias("vector")), "corpus")
    asked = kept(e.filter("doc_id % 20 = 0").select(F.col("doc_id").alias("query_id"), F.col("vector").alias("query_vector")), "asked")
    n_asked, p = asked.count(), pq.PqParams(64, 8, 4)
    cells, books = kept(ivf.train(e), "cells"), kept(pq.train(e, p), "books")
    builds = {"ivf": lambda c: ivf.assign(c, cells), "pq": lambda c: pq.encode(c, books, p), "hnsw": lambda c: hnsw.build(c)}
    index: dict[str, dict[str, float]] = {}
    for kind, build in builds.items():
        for share in (4, 2, 1):
            part = e.filter(F.pmod(F.xxhash64("doc_id"), F.lit(share)) == 0)
            n = part.count()
            index.setdefault(kind, {})[str(n)] = round(n / seconds(lambda part=part, build=build: run(build(part))), 1)

    assigned, codes, nodes = kept(ivf.assign(e, cells), "ivf"), kept(pq.encode(e, books, p), "pq"), kept(hnsw.build(e), "hnsw")
    searches = {"exact": lambda: knn.search(e, asked, K, "l2")}
    searches |= {f"ivf n_probe={x}": lambda x=x: ivf.search(assigned, cells, asked, K, x) for x in (1, 5, 10, 20)}
    searches |= {"pq": lambda: pq.search(codes, asked, books, p, K)}
    searches |= {f"hnsw ef={x}": lambda x=x: hnsw.search(nodes, asked, K, x) for x in (10, 50, 100, 200)}
    truth = {m: kept(knn.search(e, asked, K, m), "truth") for m in ("l2", "cosine_eps")}
    sweep = {}
    for name, search in searches.items():
        took = min(seconds(lambda s=search: run(s())) for _ in range(2))
        true = truth["cosine_eps" if name.startswith("ivf") else "l2"]
        recall = evaluation.recall_at_k(search(), true, K).agg(F.avg("recall")).first()[0]
        sweep[name] = {"recall": round(recall, 4), "ms_a_query": round(1000 * took / n_asked, 3)}

    concurrent = {}
    for threads in (1, 2, 4, 8):
        with ThreadPoolExecutor(threads) as pool:
            took = seconds(lambda pool=pool: list(pool.map(lambda _: run(searches["exact"]()), range(16))))
        concurrent[str(threads)] = round(16 / took, 2)
    print(json.dumps({"metric": "index_benchmarks", "corpus": e.count(), "queries": n_asked, "index": index, "sweep": sweep, "concurrent": concurrent, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
