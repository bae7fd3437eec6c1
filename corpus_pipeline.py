"""Corpus pipeline over ``documents``: toxicity, line dedup, near duplicates, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again
as the next stage's documents, so a stage works on all that its predecessor kept, a stage that fails
can be run again from there, and no plan spans two stages.  All stages but the last return the columns
of ``documents``.

Defined results: null texts, repeated rows, empty tables and further columns are treated as each
operator states; further columns of the documents pass through every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tempest.llm import bytebpe, linededup, mixing, ngramjoin, toxicity
from tempest.session import materialise, run_folder


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic (labels teach as in the operator's query)."""
    return toxicity.reject(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more share but for one of them.

    ``n_chars`` follows the text.
    """
    out = linededup.apply_bitmaps(docs, linededup.dropped_runs(docs))
    if "n_chars" not in out.columns:
        return out
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of documents whose 5-word sets have similarity 0.8 or more."""
    return ngramjoin.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    mixed = mixing.pareto_mix(docs.select("doc_id", "source", "text", row)).where(F.col("mix_copies") > 0)
    return mixed.select("row", F.explode(F.array_repeat(F.lit(0), F.col("mix_copies").cast("int")))).select("row.*")


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with the ids of their whole texts and the number of these."""
    out = bytebpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.withColumn("n_tokens", F.size(bytebpe.OUTPUT).cast("long"))


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("tokens", to_tokens),
]

# The neighbour search and the encoder are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; returns the rows of the last."""
    folder = run_folder(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialise(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return docs
