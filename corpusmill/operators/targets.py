"""Next-token targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import PAD_ID
from corpusmill.functions.arrays import shift_targets


def with_targets(df: DataFrame, ids: str = "input_ids", fill=PAD_ID) -> DataFrame:
    return df.withColumn("targets", shift_targets(ids, fill))


def target_pairs(df: DataFrame, keep: list[str], ids: str = "input_ids", targets: str = "targets") -> DataFrame:
    """``(*keep, pos, input, target)``, one row per position."""
    zipped = F.arrays_zip(F.col(ids).alias("input"), F.col(targets).alias("target"))
    exploded = df.select(*keep, F.posexplode(zipped).alias("pos", "pair"))
    return exploded.select(*keep, "pos", "pair.input", "pair.target")


def mask_targets(pairs: DataFrame, include_pad: bool = True, n_tokens: str = "n_tokens") -> DataFrame:
    """All positions, or only those of real tokens; the first pad counts as the end marker."""
    return pairs if include_pad else pairs.where(F.col("pos") < F.col(n_tokens))
