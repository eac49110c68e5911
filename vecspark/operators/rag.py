"""Question answering over retrieved chunks: context, prompt, sources, answer."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecspark.functions.text import strip
from vecspark.operators import chunking, embedding, retrieval

SYSTEM = "You are a helpful assistant. Answer the question from the context, and cite sources as [Source N]."
ANSWER = "No language model is configured."


def constant_answer(prompt: Column) -> Column:
    """The default generator: one fixed answer, whatever the prompt."""
    return F.when(prompt.isNotNull(), F.lit(ANSWER))


@dataclass(frozen=True)
class RagParams:
    top_k: int = 5
    max_context: int = 2048
    source_chars: int = 200
    include_sources: bool = True
    chunks: chunking.ChunkParams = field(default_factory=lambda: chunking.ChunkParams("sentence"))


def context(hits: DataFrame, max_context: int = 2048) -> DataFrame:
    """(query_id, context, n_sources): `[Source i]: text` blocks up to the first that would exceed the limit.

    The running length only grows, so a prefix is what a stop at that block leaves.
    """
    part = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("]: "), F.col("text"))
    w = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    kept = hits.select("query_id", "rank", part.alias("part")).withColumn("run", F.sum(F.char_length("part")).over(w)).filter(F.col("run") <= max_context)
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "part"))), lambda s: s["part"]), "\n\n")
    return kept.groupBy("query_id").agg(joined.alias("context"), F.count(F.lit(1)).alias("n_sources"))


def prompt(query: Column, context_: Column, system: str = SYSTEM) -> Column:
    return F.concat(F.lit(f"{system}\n\nContext:\n"), F.coalesce(context_, F.lit("")), F.lit("\n\nQuestion: "), query, F.lit("\n\nAnswer:"))


def cot_prompt(query: Column, context_: Column) -> Column:
    return F.concat(F.lit("Think step by step, then give the result after \"Answer:\".\n\nContext:\n"), F.coalesce(context_, F.lit("")), F.lit("\n\nQuestion: "), query, F.lit("\n\nReasoning:"))


def split_answer(text: Column) -> tuple[Column, Column]:
    """(reasoning, answer) at the first "Answer:"; without one all is the answer."""
    parts = F.split(text, "Answer:", 2)
    has = F.size(parts) > 1
    return F.when(has, strip(parts[0])), F.when(has, strip(F.try_element_at(parts, F.lit(2)))).otherwise(text)


def sources(hits: DataFrame, chars: int = 200) -> DataFrame:
    """(query_id, sources): id, first characters and score of each hit, in rank order."""
    one = F.struct("rank", "doc_id", F.substring("text", 1, chars).alias("text"), "score")
    return hits.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("sources"))


def answer(hits: DataFrame, queries: DataFrame, p: RagParams = RagParams(), generate: Callable[[Column], Column] = constant_answer, chain_of_thought: bool = False) -> DataFrame:
    """(query_id, answer, reasoning, sources, num_retrieved) of each question."""
    ask = cot_prompt if chain_of_thought else prompt
    found = queries.select("query_id", "query_text").join(context(hits, p.max_context), "query_id", "left").join(sources(hits, p.source_chars), "query_id", "left")
    said = found.withColumn("_said", generate(ask(F.col("query_text"), F.col("context"))))
    reasoning, text = split_answer(F.col("_said")) if chain_of_thought else (F.lit(None).cast("string"), F.col("_said"))
    empty = F.slice("sources", 1, 0)
    return said.select("query_id", text.alias("answer"), reasoning.alias("reasoning"), ("sources" if p.include_sources or chain_of_thought else empty.alias("sources")), F.coalesce(F.size("sources"), F.lit(0)).alias("num_retrieved"))


def ingest(docs: DataFrame, p: RagParams = RagParams(), embed: Callable[[Column], Column] = embedding.hashed) -> DataFrame:
    """Chunk and embed documents (doc_id, text, metadata): (source_id, chunk_id, doc_id, text, vector, metadata).

    doc_id of a chunk is a hash of its document and number.
    """
    chunks = chunking.with_metadata(docs, p.chunks)
    return chunks.select(F.col("doc_id").alias("source_id"), "chunk_id", F.xxhash64("doc_id", "chunk_id").alias("doc_id"), "text", embed(F.col("text")).alias("vector"), "metadata")


def delete(corpus: DataFrame, source_ids: DataFrame) -> DataFrame:
    """The chunk corpus without some documents."""
    return corpus.join(source_ids.select("source_id"), "source_id", "left_anti").select(*corpus.columns)


def update(corpus: DataFrame, docs: DataFrame, p: RagParams = RagParams()) -> DataFrame:
    """The chunk corpus with documents replaced by their new text."""
    old = delete(corpus, docs.select(F.col("doc_id").alias("source_id")))
    return old.unionByName(ingest(docs, p))


def query(corpus: DataFrame, questions: DataFrame, p: RagParams = RagParams(), generate: Callable[[Column], Column] = constant_answer, embed: Callable[[Column], Column] = embedding.hashed) -> DataFrame:
    """Answers of a table of questions (query_id, query_text)."""
    asked = questions.withColumn("query_vector", embed(F.col("query_text")))
    return answer(retrieval.retrieve(corpus, asked, p.top_k), questions, p, generate)


def stats(corpus: DataFrame, p: RagParams = RagParams()) -> DataFrame:
    """One row: strategy, chunk size, top_k, chunks and documents."""
    return corpus.agg(F.lit(p.chunks.strategy).alias("strategy"), F.lit(p.chunks.size).alias("chunk_size"), F.lit(p.top_k).alias("top_k"), F.count(F.lit(1)).alias("total_chunks"), F.count_distinct("source_id").alias("documents"))


def token_stream(answers: DataFrame) -> DataFrame:
    """(query_id, pos, token): the answer's words, each with a blank behind it; iterate with toLocalIterator()."""
    return answers.select("query_id", F.posexplode(F.split(strip(F.col("answer")), r"(?U)\s+")).alias("pos", "token")).withColumn("token", F.concat("token", F.lit(" ")))
