"""A training corpus from raw documents: filter, dedup, mix, encode.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlight.llm import line_dedup, mixing, scratch, sentencepieces, simhash, toxicity

TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled documents of this input; toxic documents go."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    (flag,) = scratch.fresh(docs, "toxic")
    return toxicity.classify(docs, model, toxic_col=flag).where(~F.col(flag)).select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and documents of which they leave nothing."""
    (gone,) = scratch.fresh(docs, "removed_lines")
    left = line_dedup.dedup_lines(docs, removed_col=gone)
    left = left.where((F.col(gone) == 0) | F.regexp_like("text", F.lit(r"\S")))
    return left.withColumn("n_chars", F.when(F.col(gone) > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the lowest id of each group of near duplicates stays."""
    return simhash.drop_near_duplicates(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Blocks of the sources in the target mixture; a row is an output slot.

    A block's text and length are its own, all other columns those of its first
    document.
    """
    mixed = mixing.mix(docs)
    made = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return mixed.select(*[(made[c] if c in made else F.col("first")[c]).alias(c) for c in docs.columns])


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The N best segmentations of every block."""
    return sentencepieces.encode(docs, TOKENIZER)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("mixing", mix_sources),
    ("sentencepiece", encode),
]

#: Training and the fingerprints have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = scratch.stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
