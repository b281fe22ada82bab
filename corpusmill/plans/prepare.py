"""The preparation job: sample, encode, cut and fill, ready to be written per split."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import (
    BLOCK_SIZE, MIN_FREQUENCY, PAD_ID, SEED, TRAIN_COUNT, VALIDATION_COUNT, VOCAB_SIZE,
)
from corpusmill.functions.arrays import pad, truncate
from corpusmill.functions.text import normalize_text
from corpusmill.operators.bpe import train_bpe
from corpusmill.operators.encode import encode
from corpusmill.operators.sampling import sample_n
from corpusmill.operators.words import word_counts
from corpusmill.session import materialize
from corpusmill.sources.corpus import TRAIN, VALIDATION
from corpusmill.sources.tokenizer_store import Tokenizer


def learn_tokenizer(
    corpus: DataFrame, vocab_size: int = VOCAB_SIZE, min_frequency: int = MIN_FREQUENCY, null_policy: str = "drop"
) -> Tokenizer:
    """Clean, count words once, learn merges on the written word table."""
    words = materialize(word_counts(normalize_text(corpus, null_policy=null_policy)), "word-counts")
    return train_bpe(words, vocab_size, min_frequency=min_frequency)


def fixed_length(df: DataFrame, n: int = BLOCK_SIZE, pad_id: int = PAD_ID) -> DataFrame:
    """``input_ids`` cut and filled to exactly ``n``; ``n_tokens`` keeps the length before that."""
    counted = df.withColumn("n_tokens", F.size("input_ids"))
    return counted.withColumn("input_ids", pad(truncate("input_ids", n), n, pad_id))


def prepare(
    corpus: DataFrame,
    tokenizer: Tokenizer,
    n: int = BLOCK_SIZE,
    train_count: int | None = TRAIN_COUNT,
    validation_count: int | None = VALIDATION_COUNT,
    seed: int = SEED,
    null_policy: str = "nan",
) -> DataFrame:
    """``(split, doc_id, sample_pos, input_ids, n_tokens)``. Sampling comes first, so only kept rows are encoded.

    Missing texts are dropped or become the word ``nan``, so every row has exactly ``n`` ids.
    """
    cleaned = normalize_text(corpus, null_policy=null_policy)
    sampled = sample_n(cleaned, {TRAIN: train_count, VALIDATION: validation_count}, seed)
    return fixed_length(encode(sampled, tokenizer).drop("text"), n)
