"""Training-data pipeline: documents in, packed sequences out.

What all stages do with awkward rows: a null text counts as empty, and stays null in the
stages that keep documents; a null doc_id is an id of its own; repeated rows are judged
alike (near duplicates then keep one of them); very long texts are read whole; an empty
table gives an empty table; other columns are kept as they are, whatever their names, up
to the last stage, whose rows are pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecspark.llm import decontam, minhash, packing, pii, quality
from vecspark.llm._shared import saved


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on this input, does not reject.

    Null and empty texts have a score too, by which they stay or go. Without labels of
    quality 1 in the input's training fold every score is the prior, and all stay.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: that of the least id, nulls last.

    Empty and null texts are one class; of rows that repeat the id and text one stays.
    """
    return minhash.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any whole window of 13 words of a benchmark item.

    Shorter items count only where they cover a twentieth of a document. Empty texts stay.
    """
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced by marks; n_chars, where there is one, follows the text (null for null)."""
    out = pii.redact(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces, each with its sequence and offset; an empty text is a piece of one end id."""
    return packing.pack(docs)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("personal_data", personal_data), ("packing", pack)]

#: No SQL expresses a trained classifier, signatures or a tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
