"""Training-data pipeline: the stages from raw documents to packed sequences.

Language identification rejects documents without letters and those whose language stays
unclear; one document of each group of near duplicates stays; personal data is replaced by its
kind; sources are mixed to their targets, which repeats some documents and leaves out others;
what is left is packed into sequences of token ids.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import language, minhash, mixing, packing, personal_data
from corpusmill.llm.queries import fold
from corpusmill.session import materialize_alone, release_shuffles

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

# A clean document's language is far clearer than this.
LEAST_SCORE = 0.5


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` of the text as it is now."""
    return docs.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else docs


def stage(function: Stage) -> Stage:
    """A stage starts without what the one before it has left in the shuffle folders."""

    @wraps(function)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release_shuffles(spark)
        return function(spark, docs, sf_dir)

    return run_stage


@stage
def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = language.fit(docs.where(fold(3) != 1))
    found = language.predict(docs.select(F.struct("*").alias("row"), "text"), model)
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("row.*")


@stage
def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.one_of_each(docs)


@stage
def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(personal_data.redact(docs))


@stage
def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _measured(mixing.training_documents(docs))


@stage
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Stage]] = [
    ("language", known_language),
    ("near duplicates", without_copies),
    ("personal data", without_personal_data),
    ("mixing", mixed),
    ("packing", packed),
]

# SQL can express neither the learned stages nor the tokenizer; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        # Only a stage's rows stay; the tables it wrote on the way go with it.
        docs = materialize_alone(spark, partial(stage, spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
