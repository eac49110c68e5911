"""Token-id shards with a minimal perfect hash index.

Documents are range-partitioned and sorted by id. Each partition becomes one shard
file: a header, the raw little-endian ids of its documents one after the other, and
an index. The index is a minimal perfect hash of the document keys in levels of bit
arrays (a key that collides in a level moves to the next); each word of a level stands
beside the number of bits before it, so one read of 16 bytes a level gives a key's
slot. The slot holds a stored fingerprint of the key and the document's place in the
payload. Opening a shard reads its header, and a lookup two levels on average, a slot
and the ids, whatever the number of documents. The manifest has the least and greatest
id of each shard, which maps a key to its shards.

The document ids stand behind the index for readers of a whole shard; keyed access
does not read them.

The writer names files by partition and attempt and returns a manifest; a file of a
lost or repeated attempt is in no manifest. All access is through Arrow file systems,
so the folder can be in any store the cluster shares.

Defined cases: null and empty texts have only the end id; null ids sort first; rows
that repeat an id are kept, and told apart in the index by their occurrence number;
an empty table gives an empty manifest; other input columns are ignored.
"""

from __future__ import annotations

import bisect
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm._shared import enter, filesystem, pieces, scratch
from vecspark.llm._tokens import crc, encoder, tokenizer_path
from vecspark.llm._words import MIX, mix64

MAGIC = b"VSTOKEN2"
#: magic, bytes an id, documents, ids, hash levels; the levels' words follow
HEADER = struct.Struct("<8sIQQI")
SLOT = np.dtype([("print", "<u4"), ("start", "<u8"), ("count", "<u4")])
RANKED = np.dtype([("rank", "<u8"), ("bits", "<u8")])
#: Bits of a level for each key that is left.
GAMMA = 2.0
MANIFEST = "shard int, file string, docs long, tokens long, least long, greatest long"
RESULT = "doc_id long, start long, n_tokens long, ids_crc32 long"


def key_hash(ids: np.ndarray, nulls: np.ndarray, occurrence: np.ndarray) -> np.ndarray:
    """64-bit hash of (id or null, occurrence)."""
    h = mix64(np.where(nulls, 0, ids).astype(np.int64).view(np.uint64))
    return mix64(h * MIX + occurrence.astype(np.uint64) * np.uint64(2) + nulls.astype(np.uint64))


def _level(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix64(h + np.uint64((level + 1) * int(MIX) & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bits)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash over 64-bit key hashes."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        ones = [np.concatenate([[0], np.cumsum(np.bitwise_count(x.view(np.uint64)), dtype=np.int64)]) for x in levels]
        base = np.cumsum([0, *(o[-1] for o in ones)])
        self.ranks = [o + b for o, b in zip(ones, base)]

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        if len(np.unique(h)) != len(h):
            raise ValueError("two keys have one hash")
        levels = []
        while len(h):
            bits = -(-max(64, int(GAMMA * len(h))) // 64) * 64
            at = _level(h, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            h = h[~alone[at]]
        return cls(levels)

    def slots(self, h: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some keys that were not built in."""
        out, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for level, (bits, rank) in enumerate(zip(self.levels, self.ranks)):
            at = _level(h[open_], level, len(bits) * 8)
            words = bits.view(np.uint64)
            word, bit = words[at >> 6], (at & 63).astype(np.uint64)
            hit = (word >> bit) & np.uint64(1) == 1
            below = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (rank[at >> 6] + np.bitwise_count(below))[hit]
            open_ = open_[~hit]
            if not len(open_):
                break
        return out


def fingerprint(h: np.ndarray) -> np.ndarray:
    return (mix64(h ^ MIX) >> np.uint64(32)).astype(np.uint32)


def occurrences(ids: np.ndarray, nulls: np.ndarray) -> np.ndarray:
    """Number of each row among rows of its id, in ascending id order."""
    if not len(ids):
        return np.zeros(0, np.int64)
    new = np.concatenate([[True], (ids[1:] != ids[:-1]) | (nulls[1:] != nulls[:-1])])
    at = np.arange(len(ids))
    return at - np.maximum.accumulate(np.where(new, at, 0))


class Shard:
    """A shard file opened for keyed access."""

    def __init__(self, uri: str):
        fs, path = filesystem(uri)
        self.file = fs.open_input_file(path)
        magic, self.width, self.docs, self.tokens, levels = HEADER.unpack(self.file.read(HEADER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is no token shard")
        self.sizes = np.frombuffer(self.file.read(8 * levels), "<u8").astype(np.int64)
        self.payload = HEADER.size + 8 * levels
        self.slots = self.payload + self.tokens * self.width
        self.levels = self.slots + self.docs * SLOT.itemsize
        self.keys = self.levels + int(self.sizes.sum()) * RANKED.itemsize

    def _take(self, at: int, kind, n: int) -> np.ndarray:
        self.file.seek(at)
        return np.frombuffer(self.file.read(np.dtype(kind).itemsize * n), kind)

    def slot(self, h: np.ndarray) -> int:
        """Slot of one key hash, by a read a level; -1 for some keys that were not built in."""
        base = self.levels
        for level, words in enumerate(self.sizes.tolist()):
            at = int(_level(h, level, words * 64)[0])
            word = self._take(base + (at >> 6) * RANKED.itemsize, RANKED, 1)[0]
            bits, bit = int(word["bits"]), at & 63
            if bits >> bit & 1:
                return int(word["rank"]) + (bits & ((1 << bit) - 1)).bit_count()
            base += words * RANKED.itemsize
        return -1

    def ids(self, place: np.void) -> np.ndarray:
        """The ids at the place that a slot names."""
        return self._take(self.payload + int(place["start"]) * self.width, f"<u{self.width}", int(place["count"]))

    def get(self, doc_id: int | None, occurrence: int = 0) -> np.ndarray | None:
        """Ids of one document, or None."""
        h = key_hash(np.array([doc_id or 0]), np.array([doc_id is None]), np.array([occurrence]))
        slot = self.slot(h)
        if slot < 0:
            return None
        place = self._take(self.slots + slot * SLOT.itemsize, SLOT, 1)[0]
        return self.ids(place) if place["print"] == fingerprint(h)[0] else None

    def documents(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all documents in order: id, whether it is null, and place, found through the index."""
        ids, nulls = self._take(self.keys, "<i8", self.docs), self._take(self.keys + 8 * self.docs, "u1", self.docs).astype(bool)
        words = self._take(self.levels, RANKED, int(self.sizes.sum()))["bits"]
        mph = PerfectHash([np.ascontiguousarray(x).view(np.uint8) for x in np.split(words, np.cumsum(self.sizes)[:-1])])
        h = key_hash(ids, nulls, occurrences(ids, nulls))
        slots, places = mph.slots(h), self._take(self.slots, SLOT, self.docs)
        if (slots < 0).any() or (places["print"][slots] != fingerprint(h)).any():
            raise ValueError("a key of the shard is not in its index")
        return ids, nulls, places[slots]


def rows_of(manifest: list[tuple], doc_id: int | None) -> list[np.ndarray]:
    """Ids of every row of a document id: its shards by the manifest, its places by their index."""
    key = lambda x: (x is not None, x or 0)  # noqa: E731  null ids are first
    at = bisect.bisect_left(manifest, key(doc_id), key=lambda m: key(m[4]))
    out = []
    while at < len(manifest) and key(manifest[at][3]) <= key(doc_id):
        shard, n = Shard(manifest[at][0]), 0
        while (ids := shard.get(doc_id, n)) is not None:
            out.append(ids)
            n += 1
        at += 1
    return out


def write_shard(uri: str, width: int, batches: Iterator[tuple[list, list[np.ndarray]]]) -> tuple[int, int]:
    """Stream documents (ids in ascending order) to a shard; its documents and ids.

    The payload's size is known only at the end: it goes to a side file first and is
    copied behind the header, a block at a time.
    """
    fs, path = filesystem(uri)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    doc_ids: list = []
    counts: list[int] = []
    with fs.open_output_stream(path + ".payload") as side:
        for ids, tokens in batches:
            doc_ids += ids
            counts += map(len, tokens)
            side.write(np.concatenate(tokens).astype(f"<u{width}").tobytes())
    n, count = len(doc_ids), np.array(counts, np.int64)
    nulls = np.array([d is None for d in doc_ids], bool)
    ids = np.array([d or 0 for d in doc_ids], np.int64)
    h = key_hash(ids, nulls, occurrences(ids, nulls))
    mph = PerfectHash.build(h)
    slot = mph.slots(h)
    places = np.zeros(n, SLOT)
    places["print"][slot], places["start"][slot], places["count"][slot] = fingerprint(h), np.cumsum(count) - count, count
    levels = []
    for bits, rank in zip(mph.levels, mph.ranks):
        words = np.zeros(len(rank) - 1, RANKED)
        words["rank"], words["bits"] = rank[:-1], bits.view(np.uint64)
        levels.append(words)
    total = int(count.sum())
    with fs.open_output_stream(path) as out:
        out.write(HEADER.pack(MAGIC, width, n, total, len(levels)))
        out.write(np.array([len(x) for x in levels], "<u8").tobytes())
        with fs.open_input_file(path + ".payload") as side:
            while block := side.read(1 << 22):
                out.write(block)
        for part in (places, *levels, ids.astype("<i8"), nulls.astype("u1")):
            out.write(part.tobytes())
    fs.delete_file(path + ".payload")
    return n, total


def write(df: DataFrame, folder: str, tokenizer: str | None = None, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> list[tuple]:
    """Write every document; the manifest in id order: (file, documents, ids, least id, greatest id).

    It has a row for each shard, so its size follows the number of partitions.
    """
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enter("token shards")
        enc = encoder(path)
        width = 2 if max(enc.size, end_id + 1) <= 1 << 16 else 4
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return

        ends = [first.column(0)[0].as_py()]

        def parts() -> Iterator[tuple[list, list[np.ndarray]]]:
            for batch in (x for some in ([first], batches) for b in some if b.num_rows for x in pieces(b)):
                ends[1:] = [batch.column(0)[-1].as_py()]
                texts = ["" if t is None else t for t in batch.column(1).to_pylist()]
                yield batch.column(0).to_pylist(), [np.append(x, end_id) for x in enc.encode_many(texts)]

        at = TaskContext.get()
        file = f"{folder}/shard-{at.partitionId():06d}-{at.taskAttemptId()}.ids"
        n, total = write_shard(file, width, parts())
        yield pa.record_batch([pa.array([at.partitionId()], pa.int32()), pa.array([file]), pa.array([n]), pa.array([total]), *(pa.array([x], pa.int64()) for x in ends)], names=["shard", "file", "docs", "tokens", "least", "greatest"])

    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    ranged = docs.repartitionByRange(F.col("id").asc_nulls_first(), tie).sortWithinPartitions(F.col("id").asc_nulls_first(), tie)
    rows = ranged.mapInArrow(run, MANIFEST).collect()
    return [(r.file, r.docs, r.tokens, r.least, r.greatest) for r in sorted(rows, key=lambda r: r.shard)]


def read(spark: SparkSession, manifest: list[tuple]) -> DataFrame:
    """Every document, looked up by its key through the index: RESULT columns."""
    rows, base = [], 0
    for file, docs, tokens, *_ in manifest:
        rows.append((file, base, docs, tokens))
        base += tokens

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for file, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            shard = Shard(file)
            ids, nulls, places = shard.documents()
            for a in range(0, len(ids), 20_000):
                cut = slice(a, a + 20_000)
                yield pa.record_batch(
                    [
                        pa.array(ids[cut], pa.int64(), mask=nulls[cut]),
                        pa.array(base + places["start"][cut].astype(np.int64)),
                        pa.array(places["count"][cut].astype(np.int64)),
                        pa.array([crc(shard.ids(x)) for x in places[cut]], pa.int64()),
                    ],
                    names=["doc_id", "start", "n_tokens", "ids_crc32"],
                )

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from run(batch)

    if not rows:
        return spark.createDataFrame([], RESULT)
    return spark.createDataFrame(rows, "file string, base long, docs long, tokens long").mapInArrow(each, RESULT)


def write_and_read(df: DataFrame, tokenizer: str | None = None, folder: str | None = None) -> DataFrame:
    """Write the shards to a folder of the shared store and read them back."""
    folder = folder or scratch(df.sparkSession, "token-ids")
    return read(df.sparkSession, write(df, folder, tokenizer))
