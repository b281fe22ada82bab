"""Joins of a large table with a per-key table when single keys may hold much of the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.session import WrittenTable, write_table

# A per-key table up to this size, on disk and in rows, is broadcast; a larger one is joined with salts.
# Rows are bounded as well, because Parquet may pack millions of them into few bytes.
BROADCAST_BYTES = 8 << 20
BROADCAST_ROWS = 500_000
# Share of the total weight that one task should get of a key.
HOT_SHARE = 0.001


def fits_broadcast(table: WrittenTable) -> bool:
    return table.size <= BROADCAST_BYTES and table.df.count() <= BROADCAST_ROWS


def keyed_join(
    left: DataFrame,
    right: DataFrame | WrittenTable,
    on: str | list[str],
    weight: str,
    how: str = "inner",
    hot_share: float = HOT_SHARE,
) -> DataFrame:
    """Equi-join with an aggregated table whose ``weight`` column says how often a key occurs.

    The per-key table is written first, so its size is known: a small one is broadcast. With
    a large one, both sides are shuffled. Keys above ``hot_share`` of the total weight are
    hot; a hot key's rows are spread over as many salts as its share holds ``hot_share``, so a
    key with a third of all rows goes to over three hundred tasks. At most ``1 / hot_share``
    keys can be hot, whatever the data, so their list is safe to broadcast, and the rows of
    ``right`` repeated for them, one per salt, are at most twice as many. Every other row keeps
    salt 0. A key that is frequent on the left but missing on the right has no weight; in a left
    join it is split by the adaptive skew join.
    """
    keys = [on] if isinstance(on, str) else list(on)
    table = right if isinstance(right, WrittenTable) else write_table(right, "per-key")
    if fits_broadcast(table):
        return left.join(F.broadcast(table.df), keys, how)
    total = table.df.agg(F.sum(weight)).scalar()
    salts = F.ceil(F.col(weight) / (hot_share * total)).cast("int").alias("_salts")
    hot = F.broadcast(table.df.where(F.col(weight) > hot_share * total).select(*keys, salts))
    spread = F.coalesce(F.pmod(F.xxhash64(*left.columns), F.col("_salts")).cast("int"), F.lit(0))
    salted = left.join(hot, keys, "left").withColumn("_salt", spread).drop("_salts")
    copies = F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)
    repeated = table.df.join(hot, keys, "left").withColumn("_salt", F.explode(copies)).drop("_salts")
    return salted.join(repeated, [*keys, "_salt"], how).drop("_salt")
