"""Seeded, partition-independent randomness taken from md5."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def hash_key(*parts) -> Column:
    """md5 hex string of the parts joined by ``:``; columns by name, other values as literals."""
    columns = [part if isinstance(part, Column) else F.lit(str(part)) for part in parts]
    return F.md5(F.concat_ws(":", *[c.cast("string") for c in columns]))


def uniform(key: Column, start: int = 1) -> Column:
    """Number strictly between 0 and 1 from eight hex digits of ``key``."""
    digits = F.conv(F.substring(key, start, 8), 16, 10).cast("double")
    return (digits + 0.5) / F.lit(4294967296.0)


def gumbel(key: Column) -> Column:
    """Standard Gumbel draw: adding it to logits makes an arg-max a softmax draw."""
    return -F.log(-F.log(uniform(key)))


def normal(key: Column) -> Column:
    """Standard normal draw (Box-Muller on two uniforms of the same key)."""
    return F.sqrt(-2.0 * F.log(uniform(key, 1))) * F.cos(F.lit(2.0 * math.pi) * uniform(key, 9))
