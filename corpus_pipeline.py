"""A training corpus out of ``documents``: each stage keeps what the next one works on.

Every stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is
written as Parquet and read back as the next stage's ``docs``.

All stages read whole texts, handle repeated rows and rows without an id like
others, keep further columns of any name (the last stage has columns of its
own), and return an empty table for an empty one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from daybook.llm import jaccard_join, lang_id, mixing, piece_codec, quality_crf
from daybook.llm.common import batch_rows, give_back, stash

#: Rows of whole texts that pass to Python at a time; narrow rows of hashes pass more.
TEXTS, NARROW = 1000, 2500


def _ready(spark: SparkSession, rows: int) -> None:
    """Stages share executors: each starts without what the one before has left."""
    give_back(spark)
    batch_rows(spark, rows)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows without a told language go, so rows whose text is null, empty or without a letter do."""
    _ready(spark, TEXTS)
    return lang_id.keep_identified(docs)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the quality threshold go. A null or blank text scores 0. Without labels of both classes all rows score alike."""
    _ready(spark, TEXTS)
    return quality_crf.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of similar rows (five-word shingles, similarity 0.8) the one of the smallest id stays.
    Of rows that repeat an id and its text one stays; a text without words is similar to none; a null id is larger than any."""
    _ready(spark, NARROW)
    return jaccard_join.keep_one(docs, k=5, percent=80)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows come as often as their source's weight asks for. A null source is a source; a text without words comes once or as often as its source's passes."""
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every row, and what they decode to, as digests. A null text is the empty one, which has no ids."""
    _ready(spark, TEXTS)
    return piece_codec.round_trip(docs, piece_codec.default_model(), cache_size=50_000)


STAGES = [
    ("language", language),
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("tokens", tokens),
]

#: Fitted models and byte-pair merging are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
