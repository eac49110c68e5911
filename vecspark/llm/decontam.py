"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are the windows of the benchmark items: 13 consecutive words, or all
words of a shorter item. A scan looks at the block of two words that ends where the
shortest pattern would end. The shift table says how far the block lies from the end
of any pattern's prefix of that length, so most blocks, being in no pattern, skip
almost a whole pattern length. A block that ends a prefix has shift 0: the bucket of
its hash and that of the first two words lists the candidates, and the words
themselves are compared. Windows of short items are scanned apart, so that they do
not shorten the skips of the others.

The tables are flat: the items' words follow each other in one list, a pattern is its
place in it, the shift table is a byte for each hash, and buckets are two arrays of
numbers. They take some ten times the text's bytes. The benchmark is cut into shards of a
bounded number of bytes. One shard travels in a broadcast and the documents are only
mapped; more are Parquet files in the shared folder, each with a pass of its own over
the documents, so that a worker builds each shard's tables once, and the documents
that have hits meet them by a key of their id and text.

Defined cases: null or wordless texts have no words, are hit by nothing and are not
contaminated; an item without words has no window; an item whose id is null can hit
words but is not listed; repeated rows and items count each for itself (equal items
are listed each); empty tables give empty or all-clean results; other input columns
are ignored by `report` and kept by `clean`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecspark.llm._shared import arrow_map, filesystem, raw, release, row_key, saved, scratch, unused
from vecspark.llm._shared import remove as remove_folder

#: Every byte that is in no word becomes a blank, A-Z become a-z.
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 32 for c in range(256))
WINDOW = 13
#: Bytes of benchmark text that one shard of pattern tables holds; checked before a broadcast.
SHARD_BYTES = 16_000_000
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words(text: bytes) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the lower-cased text, in UTF-8."""
    return text.translate(_TABLE).split()


class WuManber:
    """Tables for patterns that are places in one list of words, of at least `shortest` words each.

    starts, lengths: where each pattern is; items: the number of the item it is of.
    """

    def __init__(self, text: list[bytes], starts: np.ndarray, lengths: np.ndarray, items: np.ndarray):
        self.text, self.items = text, items
        self.m = m = int(lengths.min())
        self.block = b = min(2, m)
        self.default = m - b + 1
        blocks = zip(text, text[1:]) if b == 2 else text
        h = np.fromiter(map(hash, blocks), np.int64, len(text) - b + 1).view(np.uint64)
        self.mask = (1 << max(8, int(8 * len(text)).bit_length())) - 1
        shift = np.full(self.mask + 1, self.default, np.uint8)
        for end in range(b, m + 1):  # the least shift comes last
            shift[h[starts + end - b] & np.uint64(self.mask)] = m - end
        self.shift = shift.tobytes()
        self.bucket_mask = (1 << max(4, int(len(starts)).bit_length())) - 1
        key = ((h[starts] * np.uint64(31) + h[starts + m - b]) & np.uint64(self.bucket_mask)).astype(np.int64)
        order = np.argsort(key, kind="stable").astype(np.int32)
        self.first = memoryview(np.concatenate([[0], np.cumsum(np.bincount(key, minlength=self.bucket_mask + 1))]).astype(np.int32))
        self.order, self.starts, self.lengths = memoryview(order), memoryview(starts.astype(np.int32)), memoryview(lengths.astype(np.int32))

    def find(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """(start, pattern number) of every occurrence."""
        shift, mask, m, n, two = self.shift, self.mask, self.m, len(text), self.block == 2
        first, order, words_ = self.first, self.order, self.text
        end = m
        while end <= n:
            h = hash((text[end - 2], text[end - 1]) if two else text[end - 1])
            step = shift[h & mask]
            if step:
                end += step
                continue
            start = end - m
            at = (31 * hash((text[start], text[start + 1]) if two else text[start]) + h) & self.bucket_mask
            for c in order[first[at] : first[at + 1]]:
                p, k = self.starts[c], self.lengths[c]
                if words_[p] == text[start] and words_[p : p + k] == text[start : start + k]:
                    yield start, c
            end += 1


def compile_tables(items: list[tuple[str | None, bytes]]) -> list[WuManber]:
    """Tables of the full windows, of one-word items and of the other shorter ones."""
    same: dict[bytes, bytes] = {}
    text: list[bytes] = []
    sizes = []
    for _, t in items:
        w = words(t)
        text += [same.setdefault(x, x) for x in w]
        sizes.append(len(w))
    n = np.array(sizes, np.int64)
    begin = np.cumsum(n) - n
    out = []
    for which, longest in ((n >= WINDOW, WINDOW), (n == 1, 1), ((n > 1) & (n < WINDOW), WINDOW)):
        at = np.flatnonzero(which)
        if not len(at):
            continue
        count = np.maximum(n[at] - longest + 1, 1)
        starts = np.repeat(begin[at] - np.cumsum(count) + count, count) + np.arange(count.sum())
        out.append(WuManber(text, starts, np.repeat(np.minimum(n[at], longest), count), np.repeat(at, count)))
    return out


class Shard:
    """The tables of one shard: from its items, or from its file in the shared folder."""

    def __init__(self, items: list[tuple[str | None, bytes]] | None, file: str | None = None):
        self.items, self.file, self.built = items, file, None

    def tables(self) -> tuple[list[WuManber], list[str | None]]:
        """Tables and the items' names; built once in a worker."""
        if self.built is None:
            items = self.items
            if items is None:
                fs, path = filesystem(self.file)
                t = pq.read_table(path, filesystem=fs)
                items = list(zip(t.column(0).to_pylist(), raw(t.column(1).combine_chunks())))
            self.built = compile_tables(items), [i for i, _ in items]
        return self.built

    def __getstate__(self):
        return {"items": self.items, "file": self.file, "built": None}


def shards(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> tuple[list[Shard], str | None]:
    """Cut the benchmark up; only one of at most `shard_bytes` is collected. Also the folder of more."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= shard_bytes:
        return [Shard([(r.item, r.text.encode()) for r in items.collect()])], None
    folder = scratch(benchmark.sparkSession, "benchmark")
    items.repartition(-(-2 * size // shard_bytes)).write.parquet(folder)
    fs, plain = filesystem(folder)
    scheme = folder.split("://")[0] + "://" if "://" in folder and not folder.startswith("file:") else "file://" if folder.startswith("file:") else ""
    return [Shard(None, scheme + x.path) for x in sorted(fs.get_file_info(pafs.FileSelector(plain)), key=lambda x: x.path) if x.path.endswith(".parquet")], folder


def scan(shard: Shard, text: list[bytes]) -> tuple[list[tuple[int, int]], set]:
    """The word ranges of every occurrence in a text, and the items that occur."""
    hit, found = [], set()
    tables, names = shard.tables()
    for t in tables:
        for start, c in t.find(text):
            hit.append((start, start + t.lengths[c]))
            found.add(names[t.items[c]])
    return hit, found


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Disjoint spans in order."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
SPANS_SQL = "array<struct<start: int, end: int>>"


def _spans(hits: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in h] for h in hits], SPANS)


def _row(texts: list[list[bytes]], spans: list[list[tuple[int, int]]], found: list[set]) -> list[pa.Array]:
    """The columns of RESULT after doc_id, and the spans."""
    names = [sorted(x - {None}) for x in found]
    n, n_hit = [len(w) for w in texts], [sum(b - a for a, b in s) for s in spans]
    return [
        pa.array(n, pa.int64()),
        pa.array(n_hit, pa.int64()),
        pa.array([len(x) for x in names], pa.int64()),
        pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
        pa.array([h > 0 and 20 * h >= k for h, k in zip(n_hit, n)], pa.bool_()),
        _spans(spans),
    ]


NAMES = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans"]


def hits(rows: DataFrame, parts: list[Shard]) -> DataFrame:
    """Saved (k, hits, items): the raw occurrences in each row of `rows` (k, text) that has any; a pass for each shard."""
    spark = rows.sparkSession

    def of(shard: Shard) -> DataFrame:
        there = spark.sparkContext.broadcast(shard)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            got = [scan(there.value, words(t)) for t in raw(batch.column(1))]
            out = pa.record_batch([batch.column(0), _spans([h for h, _ in got]), pa.array([list(x) for _, x in got], pa.list_(pa.string()))], names=["k", "hits", "items"])
            return out.filter(pa.array([bool(h) for h, _ in got], pa.bool_()))

        return arrow_map(rows, run, f"k binary, hits {SPANS_SQL}, items array<string>")

    each = reduce(DataFrame.unionByName, map(of, parts))
    merged = each.groupBy("k").agg(F.array_distinct(F.flatten(F.collect_set("hits"))).alias("hits"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("items"))
    return saved(merged, "hits")


def report(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """One row for each document: RESULT columns and `spans`, the hit word ranges."""
    parts, folder = shards(benchmark, shard_bytes=shard_bytes)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    if len(parts) == 1:
        there = docs.sparkSession.sparkContext.broadcast(parts[0])

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [words(t) for t in raw(batch.column(1))]
            got = [scan(there.value, w) for w in texts]
            return pa.record_batch([batch.column(0), *_row(texts, [covered(h) for h, _ in got], [x for _, x in got])], names=["doc_id", *NAMES])

        return arrow_map(rows, run, RESULT + f", spans {SPANS_SQL}")

    key = row_key(F.col("id"), F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    found = hits(rows.select(key.alias("k"), "text"), parts)
    remove_folder(folder)

    def join(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [list(repeat(b"", n)) for n in batch.column(1).to_pylist()]
        spans = [covered([(x["start"], x["end"]) for x in h or ()]) for h in batch.column(2).to_pylist()]
        return pa.record_batch([batch.column(0), *_row(texts, spans, [set(x or ()) for x in batch.column(3).to_pylist()])], names=["doc_id", *NAMES])

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.record_batch([batch.column(0), batch.column(1), pa.array([len(words(t)) for t in raw(batch.column(2))], pa.int32())], names=["id", "k", "n"])

    sized = arrow_map(rows.select("id", key.alias("k"), "text"), count, "id long, k binary, n int")
    return arrow_map(sized.join(found, "k", "left").select("id", "n", "hits", "items"), join, RESULT + f", spans {SPANS_SQL}")


def leaks(n_words: int, hit: list[tuple[int, int]]) -> bool:
    """Whether a document with these occurrences must go.

    One whole window of 13 words is enough, however long the document. Items of fewer
    words, which may be common phrases, count only where they cover a twentieth of it.
    """
    return any(b - a >= WINDOW for a, b in hit) or bool(hit) and 20 * sum(b - a for a, b in covered(hit)) >= n_words


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """`docs`, with all its columns, without the documents that leak a benchmark item (`leaks`)."""
    parts, folder = shards(benchmark, shard_bytes=shard_bytes)
    at = docs.columns.index(text_col)
    if len(parts) == 1:
        there = docs.sparkSession.sparkContext.broadcast(parts[0])

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [words(t) for t in raw(batch.column(at))]
            return batch.filter(pa.array([not leaks(len(w), scan(there.value, w)[0]) for w in texts], pa.bool_()))

        return arrow_map(docs, run, docs.schema)

    key = unused(docs, "key")
    digest = F.unhex(F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    found = hits(docs.select(digest.alias("k"), F.col(text_col).cast("string").alias("text")), parts)
    remove_folder(folder)
    texts = docs.select(digest.alias("k"), F.col(text_col).cast("string").alias("text")).join(found, "k", "left_semi").dropDuplicates(["k"]).join(found.select("k", "hits"), "k")

    def judge(batch: pa.RecordBatch) -> pa.RecordBatch:
        gone = [leaks(len(words(t)), [(x["start"], x["end"]) for x in h]) for t, h in zip(raw(batch.column(1)), batch.column(2).to_pylist())]
        return batch.select([0]).filter(pa.array(gone, pa.bool_()))

    gone = saved(arrow_map(texts.select("k", "text", "hits"), judge, "k binary").withColumnRenamed("k", key), "leaks")
    release(found)
    return docs.withColumn(key, digest).join(gone, key, "left_anti").select(*docs.columns)


#: The same report in SQL: windows joined to windows by their words.
SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item, least(len(w), 13) AS k, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i + least(len(w), 13) - 1], ' '))) AS g FROM b WHERE len(w) > 0),
s AS (SELECT DISTINCT k FROM p),
o AS (SELECT d.rid, s.k, unnest(range(1, len(d.w) - s.k + 2)) AS i, unnest(list_transform(range(1, len(d.w) - s.k + 2), lambda i: array_to_string(d.w[i:i + s.k - 1], ' '))) AS g FROM d, s WHERE len(d.w) >= s.k),
m AS (SELECT o.rid, o.i, o.k, p.item FROM o JOIN p ON o.g = p.g AND o.k = p.k),
h AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT rid, i, k FROM m)) GROUP BY rid),
t AS (SELECT rid, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(t.items, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN h USING (rid) LEFT JOIN t USING (rid)
"""
