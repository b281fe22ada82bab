"""Word frequencies and the character alphabet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import SPECIAL_TOKENS
from corpusmill.functions.text import pretokenize
from corpusmill.operators import pair_parts


def explode_words(df: DataFrame, text: str = "text") -> DataFrame:
    """``(word)`` of texts, or of rows of words that stand in packed parts, see :func:`pair_parts.pack`."""
    if "body" in df.columns:
        return pair_parts.explode_tokens(df, "word")
    return df.select(F.explode(pretokenize(text)).alias("word"))


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """``(word, n)``. Counting is combined on the map side, so a hot word costs one row per task."""
    return explode_words(df, text).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def alphabet(words: DataFrame, n_specials: int = len(SPECIAL_TOKENS)) -> DataFrame:
    """``(token_id, ch)``: distinct characters, numbered after the specials by code point.

    The set holds at most one entry per Unicode code point, so a single row can carry it.
    Default string order is UTF-8 byte order, which equals code-point order.
    """
    chars = words.select(F.explode(F.split("word", "")).alias("ch"))
    ordered = chars.agg(F.array_sort(F.collect_set("ch")).alias("chars"))
    return ordered.select(F.posexplode("chars").alias("pos", "ch")).select(
        (F.col("pos") + n_specials).alias("token_id"), "ch"
    )
