"""From documents to packed sequences of tokens, stage by stage.

Every stage is a function of (spark, docs, sf_dir) to a DataFrame. What it returns is written as Parquet and read again as
the documents of the next stage. All but the last return the columns of ``docs``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecweave.llm.language import identify_languages
from vecweave.llm.line_dedup import dedup_lines
from vecweave.llm.mixing import mix
from vecweave.llm.packing import pack
from vecweave.llm.settings import END_ID, WORD_TOKENIZER
from vecweave.llm.simhash import one_of_each_group
from vecweave.sources.storage import materialize


# Texts go to Python in batches of this size in the whole session: half a dozen copies of a batch are alive at a time, in
# Spark's buffers and in Python, for every task of an executor, and Spark keeps its buffers from stage to stage.
BATCH_BYTES = "4m"


def _prepared(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language, which is the predicted one where none is given; null texts and texts without a letter go."""
    _prepared(spark)
    return identify_languages(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without the lines that later documents hold, too. A document whose lines all go stays, empty."""
    _prepared(spark)
    left = dedup_lines(docs)
    return left.withColumn("n_chars", F.char_length("text").cast("bigint")) if "n_chars" in docs.columns else left


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the smallest id."""
    _prepared(spark)
    return one_of_each_group(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by the weight of their source, in shuffled order."""
    _prepared(spark)
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 2048 ids, with the ids."""
    _prepared(spark)
    return pack(docs, WORD_TOKENIZER, END_ID)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mixing),
    ("packing", packing),
]

# Language identification is learned and packing is a search: SQL has neither.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
