"""The corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before has kept; all
but the last return the columns of `documents`. run() writes each stage's result as
Parquet to the shared folder and reads it again for the next.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm import language_id, near_duplicates, packing, private_data, substring_dedup
from eventloom.llm.common import forget, table, written

RANKS = "byte_bpe_50k.tiktoken"
#: SQL can't express the stages; tests hold them against plain versions.
ORACLE_SQL = None


def _counted(docs: DataFrame) -> DataFrame:
    """n_chars, where there is one, as the text now is."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is certain; a missing lang becomes the one found."""
    found = language_id.predict(docs, language_id.fit(docs)).where("NOT rejected")
    return found.select(*[F.coalesce(f"row.{c}", "lang_pred").alias(c) if c == "lang" else F.col(f"row.`{c}`") for c in docs.columns])


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_duplicates.one_of_each(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of windows that occur more than once."""
    return _counted(substring_dedup.without_repeats(docs))


def redact_private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data and secrets replaced by their kinds."""
    return _counted(private_data.redacted(docs, private_data.default_field()))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of the tokens of all documents, in the permitted sizes."""
    return packing.pack_sequences(docs, public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


STAGES = [
    ("language_id", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("substring_dedup", drop_repeated_passages),
    ("pii", redact_private_data),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages. The last one's input stays in the shared folder, as its result reads it;
    eventloom.llm.common.forget_all deletes it when the result has been saved."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
        if before:
            forget(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
