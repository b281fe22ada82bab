"""Text functions: pre-tokenization, missing-text rules, previews."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import NA_SPELLINGS, PREVIEW_CHARS, SPECIAL_TOKENS

# Unicode classes are needed: without (?U) an accented letter would end a word.
PIECE_PATTERN = r"(?U)\w++|[^\w\s]++"
_SPECIAL = "|".join(token.replace("|", r"\|") for token in SPECIAL_TOKENS)
# Literal special tokens are cut out first, so a punctuation run stops in front of one.
PIECE_OR_SPECIAL_PATTERN = rf"(?U)(?:{_SPECIAL})|\w++|(?:(?!{_SPECIAL})[^\w\s])++"
STRIPPED_CHARS = " \t\r\n"


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def pretokenize(text, keep_specials: bool = False) -> Column:
    """Runs of word characters or of other non-space characters; white space is dropped."""
    pattern = PIECE_OR_SPECIAL_PATTERN if keep_specials else PIECE_PATTERN
    return F.regexp_extract_all(_col(text), F.lit(pattern), F.lit(0))


def is_missing(text) -> Column:
    text = _col(text)
    return text.isNull() | text.isin(*NA_SPELLINGS)


def normalize_text(df: DataFrame, text: str = "text", null_policy: str = "drop") -> DataFrame:
    """Drop rows without text, or (``nan``) replace them by the word ``nan``."""
    if null_policy == "drop":
        return df.where(~is_missing(text))
    if null_policy == "nan":
        return df.withColumn(text, F.when(is_missing(text), F.lit("nan")).otherwise(F.col(text)))
    raise ValueError(f"null_policy must be 'drop' or 'nan', not {null_policy!r}")


def preview(prompt, result, n: int = PREVIEW_CHARS) -> Column:
    """First ``n`` characters of the stripped text that follows the prompt."""
    answer = F.substring(_col(result), F.length(_col(prompt)) + 1, F.length(_col(result)))
    return F.substring(F.btrim(answer, F.lit(STRIPPED_CHARS)), 1, n)


def clamp(value, lo, hi) -> Column:
    """Value limited to ``lo..hi``; null stays null."""
    value = _col(value)
    return F.when(value.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), value)))
