"""WARC archives, and a globally ordered capture index by external merge.

Writing: pages meet their payload's digest (SHA-256) by a shuffle on it, in which the
least page id of each digest is known; every partition streams its records to an
archive of gzip members, one a record, and sorts its captures, by URL key and time,
into a run file beside it. Only payloads of `revisit_bytes` or more are revisited.

Index: the runs are merged k ways by a loser tree. A bounded sample of the runs' keys
(`SAMPLE`) cuts the key range into parts. A run ends in an index of two levels, so a
merge task reads, of each run, a short root, the piece of the index that its range
needs and the blocks themselves; parts follow each other in global order, and a task's
memory is a block of each run. Where there are more runs than `FAN_IN`, passes before
merge groups of that many, each pass cut into as many ranges as give every task about a
part's entries, so no pass has few tasks.

Reading: the entries of the index, grouped by archive and in file order, are read back
at their offsets, and the payload is measured again. What a revisit's header says of
its payload is held against the response it refers to.

Files are named by partition and attempt, and only files that a finished task reports
are used, so lost executors leave nothing that counts.

Defined cases: null html is an empty payload; a null url has the empty key; of rows
that repeat both page_id and payload each is written, as the same kind of record under
the same record id; a row with a null id revisits an equal payload that has one; a
payload whose rows all have null ids is a response each; an empty table gives no
archive and an empty result; other input columns are ignored.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm._shared import arrow_map, filesystem, pieces, raw, remove, saved, scratch

RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
INDEX = "part int, pos long, urlkey string, stamp string, page_id long, file string, offset long, length long"
#: A shorter payload is never a revisit.
REVISIT_BYTES = 100
#: Runs merged at once, entries of a block of a run, and blocks of a piece of its index.
FAN_IN, BLOCK, INDEXED = 64, 512, 256
#: Most keys that the driver takes to cut the key range, and so most parts.
SAMPLE = 20_000
_EPOCH = 1_577_836_800  # 2020-01-01: pages have no time, so captures are a second apart by page id


def url_key(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, path and query, no scheme, www or fragment."""
    if not url:
        return ""
    rest = url.split("://", 1)[-1].split("#", 1)[0]
    host, slash, path = rest.partition("/")
    host = host.lower().split("@")[-1]
    labels = host.split(":")[0].split(".")
    return ",".join(reversed(labels[1:] if labels[0] == "www" and len(labels) > 2 else labels)) + ")/" + path


def stamp(page_id: int | None) -> tuple[str, str]:
    """Capture time as 14 digits and as a WARC date."""
    import datetime

    t = datetime.datetime(1970, 1, 1) + datetime.timedelta(seconds=_EPOCH + (page_id or 0) % 10**9)
    return t.strftime("%Y%m%d%H%M%S"), t.strftime("%Y-%m-%dT%H:%M:%SZ")


def record(page_id: int | None, url: str, digest: str, payload: bytes, refers_to: int | None, date: str, size: int) -> bytes:
    """One gzip member: a response with its payload, or a revisit with the HTTP head alone."""
    name = f"{'null' if page_id is None else page_id}:{digest[:16]}"
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {url}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}:{digest[:16]}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    c = zlib.compressobj(1, zlib.DEFLATED, 31)
    return c.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + c.flush()


def parse(member: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """WARC headers, HTTP headers and payload of one member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class LoserTree:
    """k-way merge of sorted iterators: an inner node keeps the loser, so the next least item costs one path of comparisons."""

    def __init__(self, runs: list[Iterator]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.heads = [next(r, None) for r in runs]
        self.tree = [-1] * self.k
        for i in range(len(runs)):
            self._play(i)

    def _less(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        if x is None or y is None:
            return y is None and (x is not None or a < b)
        return (x, a) < (y, b)

    def _play(self, i: int) -> None:
        """Send run i up; it stays where it loses, and an empty place takes it."""
        at = (i + self.k) // 2
        while at:
            if self.tree[at] < 0:
                self.tree[at] = i
                return
            if self._less(self.tree[at], i):
                self.tree[at], i = i, self.tree[at]
            at //= 2
        self.tree[0] = i

    def __iter__(self) -> Iterator:
        while self.runs and self.heads[self.tree[0]] is not None:
            i = self.tree[0]
            yield self.heads[i]
            self.heads[i] = next(self.runs[i], None)
            self._play(i)


def write_run(uri: str, entries: Iterator[list]) -> int:
    """A run file: gzip members of BLOCK entries, then their first keys with offsets in pieces, then the pieces'; its entries."""
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    blocks, root, offset, n = [], [], 0, 0
    with fs.open_output_stream(path, compression=None) as out:

        def put(lines: list, index: list) -> None:
            nonlocal offset
            block = gzip.compress("\n".join(map(json.dumps, lines)).encode(), 1, mtime=0)
            index.append([lines[0][:3] if index is blocks else lines[0][0], offset, len(block)])
            out.write(block)
            offset += len(block)

        lines: list = []
        for entry in entries:
            lines.append(entry)
            n += 1
            if len(lines) == BLOCK:
                put(lines, blocks)
                lines = []
        if lines:
            put(lines, blocks)
        for i in range(0, len(blocks), INDEXED):
            put(blocks[i : i + INDEXED], root)
        tail = json.dumps(root).encode()
        out.write(tail + len(tail).to_bytes(8, "little"))
    return n


class Run:
    """An open run file: its root, and its index piece by piece."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        self.file.seek(size - 8)
        n = int.from_bytes(self.file.read(8), "little")
        self.file.seek(size - 8 - n)
        self.root = json.loads(self.file.read(n))

    def _lines(self, place: list) -> list:
        self.file.seek(place[1])
        return [json.loads(x) for x in gzip.decompress(self.file.read(place[2])).split(b"\n")]

    def blocks(self, low: list | None = None) -> Iterator[list]:
        """[first key, offset, length] of the blocks, from the one that `low` may be in."""
        at = max(0, bisect.bisect_left([r[0] for r in self.root], low) - 1) if low is not None else 0
        for place in self.root[at:]:
            some = self._lines(place)
            skip = max(0, bisect.bisect_left([b[0] for b in some], low) - 1) if low is not None else 0
            yield from some[skip:]

    def entries(self, low: list | None, high: list | None) -> Iterator[list]:
        """Entries with low <= key < high; keys are [urlkey, stamp, page id]."""
        with self.file:
            for place in self.blocks(low):
                if high is not None and place[0] >= high:
                    return
                for entry in self._lines(place):
                    if (low is None or entry[:3] >= low) and (high is None or entry[:3] < high):
                        yield entry


def read_run(uri: str, low: list | None, high: list | None) -> Iterator[list]:
    return Run(uri).entries(low, high)


RUNS = "file string, run string, entries long"


def write(pages: DataFrame, folder: str, revisit_bytes: int = REVISIT_BYTES) -> list[tuple[str, str, int]]:
    """Write archives and runs; the finished (archive, run, entries), one for each partition."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    p = p.withColumn("digest", F.sha2(F.col("html"), 256)).withColumn("long", F.octet_length("html") >= revisit_bytes)
    # A short payload is nobody's copy: its key is its own, so no shuffle puts them together.
    key = F.when(F.col("long"), F.unhex("digest")).otherwise(F.unhex(F.md5(F.concat_ws("/", F.lit("s"), "page_id", "url"))))
    p = p.withColumn("key", key)
    first = p.filter("long").groupBy("key").agg(F.min("page_id").alias("first")).withColumnRenamed("key", "k")
    rows = p.join(first, p["key"] == first["k"], "left").select("page_id", "url", "html", "digest", F.when(F.col("page_id").isNull() | (F.col("page_id") > F.col("first")), F.col("first")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = (x for b in batches for x in pieces(b))
        batch = next((b for b in batches if b.num_rows), None)
        if batch is None:
            return
        at = TaskContext.get()
        name = f"{folder}/part-{at.partitionId():06d}-{at.taskAttemptId()}"
        fs, path = filesystem(name + ".warc.gz")
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        entries, offset = [], 0
        with fs.open_output_stream(path, compression=None) as out:
            while batch is not None:
                columns = [batch.column(0).to_pylist(), batch.column(1).to_pylist(), raw(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist()]
                for page, url, payload, digest, refers in zip(*columns):
                    clean = " ".join(url.split())
                    digits, date = stamp(page)
                    member = record(page, clean, digest, payload, refers, date, len(payload))
                    out.write(member)
                    entries.append([url_key(clean), digits, -1 if page is None else page, name + ".warc.gz", offset, len(member)])
                    offset += len(member)
                batch = next((b for b in batches if b.num_rows), None)
        entries.sort()
        n = write_run(name + ".run", iter(entries))
        yield pa.record_batch([pa.array([name + ".warc.gz"]), pa.array([name + ".run"]), pa.array([n], pa.int64())], names=["file", "run", "entries"])

    return [tuple(r) for r in rows.mapInArrow(run, RUNS).collect()]


def _cuts(spark: SparkSession, runs: list[tuple[str, str, int]], part_entries: int) -> list:
    """Keys that cut the range into parts, between None and None."""
    total = sum(n for *_, n in runs)
    parts = max(1, min(SAMPLE, -(-total // part_entries)))
    if parts == 1:
        return [None, None]
    share = min(1.0, SAMPLE / max(1, total // BLOCK))

    def sample(batch: pa.RecordBatch) -> pa.RecordBatch:
        keys = []
        for uri in batch.column(0).to_pylist():
            opened = Run(uri)
            with opened.file:
                # Of each block the hash of its key decides, so small runs count by their share too.
                keys += [k for k in (json.dumps(b[0]) for b in opened.blocks()) if zlib.crc32(k.encode()) < share * 2**32]
        return pa.record_batch([pa.array(keys, pa.string())], names=["key"])

    some = spark.createDataFrame([(r,) for _, r, _ in runs], "run string")
    keys = sorted(json.loads(r.key) for r in arrow_map(some, sample, "key string").collect())
    cuts = [keys[i * len(keys) // parts] for i in range(1, parts)] if keys else []
    return [None, *(c for i, c in enumerate(cuts) if not i or c != cuts[i - 1]), None]


def _pass(spark: SparkSession, folder: str, ranges: list[tuple[int, int, list[str]]], cuts: list) -> list[tuple[int, int, list[str]]]:
    """Merge groups of FAN_IN runs of each range; (first part, end, runs) of the shorter ranges that come of it."""
    tasks, out = [], []
    for at, (first, end, runs) in enumerate(ranges):
        groups = -(-len(runs) // FAN_IN)
        for low in range(first, end, groups):
            out.append((low, min(low + groups, end), []))
            tasks += [(len(out) - 1, at, g, low, min(low + groups, end)) for g in range(groups)]
    there = spark.sparkContext.broadcast((ranges, cuts))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old, keys = there.value
        names = []
        for at, group, low, high in zip(*(batch.column(i).to_pylist() for i in range(1, 5))):
            task = TaskContext.get()
            names.append(f"{folder}/merged-{task.partitionId():06d}-{task.taskAttemptId()}-{len(names)}.run")
            runs = old[at][2][group * FAN_IN : (group + 1) * FAN_IN]
            write_run(names[-1], iter(LoserTree([read_run(r, keys[low], keys[high]) for r in runs])))
        return pa.record_batch([batch.column(0), pa.array(names, pa.string())], names=["to", "run"])

    df = spark.createDataFrame(tasks, "to int, at int, g int, low int, high int").repartition(len(tasks))
    for r in arrow_map(df, run, "to int, run string").collect():
        out[r.to][2].append(r.run)
    return [(low, high, sorted(runs)) for low, high, runs in out]


def merge(spark: SparkSession, folder: str, runs: list[tuple[str, str, int]], part_entries: int = 50_000) -> DataFrame:
    """The capture histories in global order: INDEX columns, ordered by (part, pos)."""
    if not runs:
        return spark.createDataFrame([], INDEX)
    cuts = _cuts(spark, runs, part_entries)
    ranges = [(0, len(cuts) - 1, sorted(r for _, r, _ in runs))]
    while any(len(r) > FAN_IN for *_, r in ranges):
        ranges = _pass(spark, folder, ranges, cuts)
    of_part = [r for first, end, r in ranges for _ in range(first, end)]
    there = spark.sparkContext.broadcast((of_part, cuts))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for part in batch.column(0).to_pylist():
            of, keys = there.value
            tree = LoserTree([read_run(r, keys[part], keys[part + 1]) for r in of[part]])
            rows: list[list] = []
            for pos, entry in enumerate(tree):
                rows.append([part, pos, *entry])
                if len(rows) == 20_000:
                    yield _index_batch(rows)
                    rows = []
            if rows:
                yield _index_batch(rows)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(batch)

    todo = spark.range(len(cuts) - 1, numPartitions=len(cuts) - 1).select(F.col("id").cast("int"))
    return todo.mapInArrow(each, INDEX)


def _index_batch(rows: list[list]) -> pa.RecordBatch:
    part, pos, key, time, page, file, offset, length = zip(*rows)
    page = [None if x < 0 else x for x in page]
    kinds = (pa.int32(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
    return pa.record_batch([pa.array(c, t) for c, t in zip((part, pos, key, time, page, file, offset, length), kinds)], names=["part", "pos", "urlkey", "stamp", "page_id", "file", "offset", "length"])


def read(index: DataFrame) -> DataFrame:
    """Every indexed capture, read back from its archive: RESULT columns and `urlkey`, `stamp`, `part`, `pos`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, file = None, None
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for uri, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if uri != name:
                    fs, path = filesystem(uri)
                    name, file = uri, io.BufferedReader(fs.open_input_file(path), 1 << 20)
                file.seek(offset)
                head, http, payload = parse(file.read(length))
                page = head["WARC-Record-ID"][10:-1].split(":")[0]
                kind = head["WARC-Type"]
                size = int(http["Content-Length"])
                digest = head["WARC-Payload-Digest"].split(":", 1)[1]
                if kind == "response":
                    size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                refers = int(head["WARC-Refers-To"][10:-1].split(":")[0]) if kind == "revisit" else None
                for column, value in zip(out, (None if page == "null" else int(page), size, digest, kind, refers)):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array(c, t) for c, t in zip(out, kinds)]
            yield pa.record_batch([*columns, *(batch.column(i) for i in range(3, 7))], names=["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "urlkey", "stamp", "part", "pos"])

    rows = index.select("file", "offset", "length", "urlkey", "stamp", "part", "pos")
    return rows.repartition("file").sortWithinPartitions("file", "offset").mapInArrow(run, RESULT + ", urlkey string, stamp string, part int, pos long")


def unsupported(rows: DataFrame) -> DataFrame:
    """The revisits' (refers_to, digest, bytes) for which no response reads so."""
    what = ["payload_digest", "payload_bytes"]
    said = rows.filter("record_type = 'revisit'").select("refers_to", *what).distinct()
    is_ = rows.filter("record_type = 'response'").select(F.col("page_id").alias("refers_to"), *what).distinct()
    return said.join(is_, ["refers_to", *what], "left_anti")


def write_and_read(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archive every page, merge the runs into capture histories and read all captures back, as a saved frame."""
    spark = pages.sparkSession
    folder, own = folder or scratch(spark, "warc"), folder is None
    rows = saved(read(merge(spark, folder, write(pages, folder))), "captures")
    if not unsupported(rows).isEmpty():
        raise ValueError(f"{folder}: a revisit says what no response holds")
    if own:
        remove(folder)
    return rows


SQL = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN p.n >= 100 AND (p.page_id > f.first OR p.page_id IS NULL AND f.first IS NOT NULL) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.n >= 100 AND (p.page_id > f.first OR p.page_id IS NULL AND f.first IS NOT NULL) THEN f.first END AS refers_to
FROM p LEFT JOIN f USING (d)
"""
