"""The corpus pipeline: five stages from raw documents to packed token sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next stage's documents. The stages before the
last return the columns of `documents`. Every stage decides by row, so an id that
carries several texts loses only those that a stage rejects. Rows without an id
pass through both deduplications.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecforge.llm import exact_dedup, mixing, near_dedup, packing, toxicity
from vecforge.llm.common import dropped, written
from vecforge.llm.queries import documents, tokenizer


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxic segments make a probability of 0.5 or more go."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def exact_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id stays."""
    return exact_dedup.deduplicate(docs)


def near_once(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by 5-word shingle similarity of 0.8 or more stays."""
    return near_dedup.deduplicate(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, laid out in files by their time slots in a mix at tempered source weights; packing numbers its sequences by that layout."""
    return mixing.mix(docs, mixing.tempered(docs))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their places in sequences of at most 2048 tokens; ascending sequence_id is the mix's order."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"), order=mixing.laid_order(docs))


STAGES = [("toxicity", toxic_out), ("exact_dedup", exact_once), ("near_dedup", near_once), ("mixing", mixed), ("packing", packed)]

#: SQL can express neither the toxicity model nor the tokenizer: tests/llm hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on `documents`, each one's result written and read again; what the next one has read is removed."""
    docs = documents(spark, sf_dir)
    columns = docs.columns
    for k, (name, stage) in enumerate(STAGES):
        before, docs = docs, written(stage(spark, docs, sf_dir).select(*(columns if k < len(STAGES) - 1 else [F.col("*")])), name)
        if k:
            dropped(before)
    return docs
