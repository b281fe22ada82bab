"""Seeded sampling, epoch order, batches and priorities."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import BATCH_SIZE, SEED
from corpusmill.functions.hashing import hash_key
from corpusmill.operators.ranking import bucket_of, bucket_offsets, hash_rank, range_rank
from corpusmill.session import materialize

PERMUTATION_ROUNDS = 6
# Of a large table hardly a number leaves its range, of a small one at most 32 do.
PERMUTATION_WALKS = 40
# A prime below 2 ** 31, so that products stay below 2 ** 63.
HASH_PRIME = 2_147_483_647
HASH_FACTOR = 1_103_515_245


def sample_n(
    df: DataFrame, counts: Mapping[str, int | None], seed: int = SEED, by: str = "split", key: str = "doc_id"
) -> DataFrame:
    """Seeded shuffle and the first rows of each named split, numbered in ``sample_pos``.

    ``counts`` names the splits of the result and the rows to keep of each. A split is kept
    whole and in its own order (``sample_pos`` is null) when its count is None, negative or
    above its number of rows. The order is that of ``md5(seed:key)``.

    Only the hash bucket in which the count is reached limits a split, so all other rows
    are dropped by a filter in front of the shuffle.
    """
    limited = {split: k for split, k in counts.items() if k is not None and k >= 0}
    parts = []
    if len(limited) < len(counts):
        whole = df.where(F.col(by).isin(*(counts.keys() - limited.keys())))
        parts.append(whole.withColumn("sample_pos", F.lit(None).cast("bigint")))
    if limited:
        parts.append(_head_of_order(df.where(F.col(by).isin(*limited)), limited, hash_key(seed, F.col(key)), by, key))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def _head_of_order(df: DataFrame, limited: Mapping[str, int], order: Column, by: str, key: str) -> DataFrame:
    wanted = F.create_map(*[F.lit(item) for pair in limited.items() for item in pair])[F.col(by)]
    # At most one row per named split and hash bucket; written once, because it is read twice.
    offsets = materialize(bucket_offsets(df, order, [by]), "offsets")
    # One row per named split.
    borders = offsets.groupBy(by).agg(
        F.max(F.when(F.col("_before") < wanted, F.col("_bucket"))).alias("_last"),
        F.max("_total").alias("_total"),
    )
    near = df.join(F.broadcast(borders), by).where((wanted > F.col("_total")) | (bucket_of(order) <= F.col("_last")))
    ranked = hash_rank(near, order, [key], [by], "sample_pos", offsets)
    kept = ranked.where((wanted > F.col("_total")) | (F.col("sample_pos") <= wanted))
    position = F.when(wanted <= F.col("_total"), F.col("sample_pos"))
    return kept.withColumn("sample_pos", position).drop("_last", "_total")


def epoch_order(df: DataFrame, seed: int, epoch: int, shuffle: bool = True, key: str = "doc_id") -> DataFrame:
    """Add ``pos``: a fresh shuffle for every epoch, or the fixed order of ``key``."""
    if shuffle:
        return hash_rank(df, hash_key(seed, epoch, F.col(key)), [key])
    return range_rank(df, [key])


@dataclass(frozen=True)
class Permutation:
    """A keyed permutation of the numbers 0 to ``n - 1``, computed in the row.

    A number is a place in a grid just large enough; rounds move its row by a hash of its column
    and its column by a hash of its row, which can be undone, so no two numbers meet. What
    leaves the range goes through the rounds again until it is back.
    """

    n: int
    seed: int
    epoch: int

    @property
    def sides(self) -> tuple[int, int]:
        wide = math.isqrt(max(0, self.n - 1)) + 1
        return wide, -(-max(1, self.n) // wide)

    @property
    def keys(self) -> list[tuple[int, int]]:
        """Two numbers below 2 ** 28 for every round, the second one odd."""
        digits = [hashlib.md5(f"{self.seed}:{self.epoch}:{i}".encode()).hexdigest() for i in range(PERMUTATION_ROUNDS)]
        return [(int(d[:7], 16), int(d[7:14], 16) | 1) for d in digits]

    def of(self, row: Column) -> Column:
        high, low = self.sides
        rounds = F.array(*[
            F.struct(F.lit(key).cast("bigint").alias("key"), F.lit(factor).cast("bigint").alias("factor"), F.lit(i % 2 == 0).alias("even"))
            for i, (key, factor) in enumerate(self.keys)])

        def mixed(x: Column, step: Column) -> Column:
            h = (x + step["key"]) % HASH_PRIME * step["factor"] % HASH_PRIME
            return (h.bitwiseXOR(F.shiftright(h, 13)) * F.lit(HASH_FACTOR)) % HASH_PRIME

        def turn(state: Column, step: Column) -> Column:
            a = F.when(step["even"], (state["a"] + mixed(state["b"], step)) % high).otherwise(state["a"])
            b = F.when(step["even"], state["b"]).otherwise((state["b"] + mixed(state["a"], step)) % low)
            return F.struct(a.alias("a"), b.alias("b"))

        def permuted(x: Column) -> Column:
            start = F.struct(F.floor(x / low).cast("bigint").alias("a"), (x % low).cast("bigint").alias("b"))
            end = F.aggregate(rounds, start, turn)
            return end["a"] * low + end["b"]

        walks = F.sequence(F.lit(1), F.lit(PERMUTATION_WALKS))
        found = F.aggregate(walks, permuted(row.cast("bigint")), lambda x, _: F.when(x >= self.n, permuted(x)).otherwise(x))
        return F.when(found < self.n, found).otherwise(F.raise_error(F.lit("a number did not come back into its range")).cast("bigint"))


def numbered_rows(df: DataFrame, key: str = "doc_id") -> tuple[DataFrame, int]:
    """The table with ``row``, 0, 1, 2, ... in the order of ``key``, written once for all epochs; and its size."""
    rows = materialize(range_rank(df, [key]).withColumn("row", F.col("pos") - 1).drop("pos"), "numbered")
    return rows, rows.count()


def epoch_permutation(numbered: DataFrame, n: int, seed: int, epoch: int) -> DataFrame:
    """Add ``pos``, 1-based, a fresh shuffle for every epoch, to the result of :func:`numbered_rows`: a projection."""
    return numbered.withColumn("pos", Permutation(n, seed, epoch).of(F.col("row")) + 1)


def batches(df: DataFrame, size: int = BATCH_SIZE, pos: str = "pos") -> DataFrame:
    """Cut numbered rows into batches of ``size``; the last batch may be short."""
    before = F.col(pos) - 1
    return df.withColumn("batch_id", F.floor(before / size)).withColumn("pos_in_batch", (before % size).cast("int"))


def limit_batches(df: DataFrame, k: int) -> DataFrame:
    return df.where(F.col("batch_id") < k)


def total_steps(df: DataFrame, epochs: int, size: int = BATCH_SIZE) -> DataFrame:
    """One row: epochs times batches per epoch."""
    return df.agg((F.ceil(F.count(F.lit(1)) / size) * epochs).alias("total_steps"))


def first_by_priority(df: DataFrame, name: str, priority: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """The available name that stands first in the priority list, per group."""
    rank = F.array_position(F.array(*[F.lit(p) for p in priority]), F.col(name))
    return df.where(F.col(name).isin(*priority)).groupBy(*by).agg(F.min_by(name, rank).alias(name))
