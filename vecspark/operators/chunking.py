"""Chunking of document texts.

The strategies carry state from one chunk to the next, so they run in an Arrow map
over (id, text), one row in and an array of chunks out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK = "chunk_id int, text string, start_char int, end_char int"
_SENTENCE = re.compile(r"[.!?]+\s+")


@dataclass(frozen=True)
class ChunkParams:
    strategy: str = "fixed"
    size: int = 512
    overlap: int = 50
    separator: str = "\n\n"

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown chunking strategy {self.strategy!r}; known: {', '.join(STRATEGIES)}")


def fixed(text: str, p: ChunkParams) -> Iterator[tuple[str, int, int]]:
    """Windows of `size` characters that end at their last blank; it always advances and stops at the end."""
    start, n = 0, len(text)
    while start < n:
        end = min(start + p.size, n)
        if end < n and (blank := text.rfind(" ", start, end)) > start:
            end = blank
        if piece := text[start:end].strip():
            yield piece, start, end
        if end >= n:
            return
        start = end - p.overlap if end - p.overlap > start else end


def _packed(parts: list[str], p: ChunkParams, glue: str, joined: int, keep_last: bool) -> Iterator[tuple[str, int, int]]:
    """Greedy packing; offsets count part lengths (and `joined` for each part that is added to another)."""
    held: list[str] = []
    size = at = 0
    for part in parts:
        if held and size + len(part) > p.size:
            yield glue.join(held), at - size, at
            held = [held[-1]] if keep_last and p.overlap > 0 and len(held) > 1 else []
            size = sum(map(len, held))
        extra = joined if held and not keep_last else 0
        held.append(part)
        size += len(part) + extra
        at += len(part) + extra
    if held:
        yield glue.join(held), at - size, at


def sentence(text: str, p: ChunkParams) -> Iterator[tuple[str, int, int]]:
    """Sentences packed up to `size`; a chunk of several hands its last one on."""
    return _packed([s for s in map(str.strip, _SENTENCE.split(text)) if s], p, " ", 0, True)


def paragraph(text: str, p: ChunkParams) -> Iterator[tuple[str, int, int]]:
    """Paragraphs packed up to `size`, joined by the separator."""
    return _packed([s for s in map(str.strip, text.split(p.separator)) if s], p, p.separator, len(p.separator), False)


#: "semantic" cuts as "sentence" does.
STRATEGIES = {"fixed": fixed, "sentence": sentence, "paragraph": paragraph, "semantic": sentence}


def chunk_text(text: str, p: ChunkParams) -> list[dict]:
    return [{"chunk_id": i, "text": t, "start_char": a, "end_char": b} for i, (t, a, b) in enumerate(STRATEGIES[p.strategy](text, p))]


def chunk(docs: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """(doc_id, chunk_id, text, start_char, end_char) of each document; null text has none."""
    kind = pa.list_(pa.struct([("chunk_id", pa.int32()), ("text", pa.string()), ("start_char", pa.int32()), ("end_char", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = pa.array([chunk_text(t or "", p) for t in batch.column(1).to_pylist()], kind)
            yield pa.record_batch([batch.column(0), chunks], names=["doc_id", "chunks"])

    cut = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, chunks array<struct<{CHUNK.replace(' ', ': ').replace(',: ', ', ')}>>")
    return cut.select("doc_id", F.inline("chunks"))


def with_metadata(docs: DataFrame, p: ChunkParams = ChunkParams()) -> DataFrame:
    """Chunks with their document's metadata map, chunk_id and total_chunks added."""
    total = F.count(F.lit(1)).over(Window.partitionBy("doc_id"))
    meta = docs.select("doc_id", F.col("metadata").alias("own"))
    added = F.create_map(F.lit("chunk_id"), F.col("chunk_id").cast("string"), F.lit("total_chunks"), total.cast("string"))
    return chunk(docs, p).join(meta, "doc_id").withColumn("metadata", F.map_concat("own", added)).drop("own")
