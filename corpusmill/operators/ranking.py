"""Global row numbers without a single-task window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.session import materialize

# Hash keys are grouped by their first four hex digits: 65,536 even buckets.
BUCKET_DIGITS = 4


def bucket_of(key: Column) -> Column:
    return F.substring(key, 1, BUCKET_DIGITS)


def bucket_offsets(df: DataFrame, key: Column, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, _bucket, _before, _total)``: rows in front of each hash bucket, rows per group.

    The windows see at most one row per bucket and group, never the data itself.
    """
    counts = df.groupBy(*by, bucket_of(key).alias("_bucket")).agg(F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0))
    return counts.select(*by, "_bucket", before.alias("_before"), F.sum("_n").over(group).alias("_total"))


def hash_rank(
    df: DataFrame, key: Column, ties: Sequence[str], by: Sequence[str] = (), out: str = "pos",
    offsets: DataFrame | None = None,
) -> DataFrame:
    """1-based position of each row in the order of a uniform hash key.

    Rows are numbered inside even hash buckets and shifted by the rows of earlier buckets.
    """
    offsets = bucket_offsets(df, key, by) if offsets is None else offsets
    in_bucket = Window.partitionBy(*by, "_bucket").orderBy("_key", *ties)
    numbered = (
        df.withColumn("_key", key)
        .withColumn("_bucket", bucket_of(F.col("_key")))
        .withColumn("_row", F.row_number().over(in_bucket))
    )
    shifted = numbered.join(offsets.select(*by, "_bucket", "_before"), [*by, "_bucket"])
    return shifted.withColumn(out, F.col("_before") + F.col("_row")).drop("_key", "_bucket", "_row", "_before")


def range_rank(df: DataFrame, order_by: Sequence[str], out: str = "pos") -> DataFrame:
    """1-based position of each row in the order of ``order_by``, which must be unique per row.

    Range partitioning splits even a value that fills a third of the table, as long as a
    later column differs. The sorted rows are written once, because range borders are
    sampled and must not change between counting and numbering. Pass only needed columns.
    """
    in_part = F.monotonically_increasing_id()
    ordered = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_id", in_part)
    written = materialize(ordered, "ranked")
    # Fixed by the function's contract: partition number above bit 33, row number below.
    part, row = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    numbered = written.select("*", part.alias("_part"), row.alias("_row")).drop("_id")
    counts = numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    # One row per partition, so the broadcast is bounded by the number of shuffle partitions.
    ranked = numbered.join(F.broadcast(before), "_part")
    return ranked.withColumn(out, F.col("_before") + F.col("_row") + 1).drop("_part", "_row", "_before")
