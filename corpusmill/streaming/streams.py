"""Streaming forms: live metric roll-up and encoding of arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusmill.constants import BLOCK_SIZE
from corpusmill.operators.encode import encode
from corpusmill.plans.prepare import fixed_length
from corpusmill.sources.tokenizer_store import Tokenizer


def stream_metrics(
    stream: DataFrame, window: str, delay: str, ts: str = "ts", value: str = "value", by: tuple[str, ...] = ()
) -> DataFrame:
    """Tumbling event-time windows with count, mean and maximum; rows later than ``delay`` are dropped."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    rolled = timed.groupBy(F.window(ts, window), *by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean_value"), F.max(value).alias("max_value")
    )
    return rolled.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), *by,
        "n", "mean_value", "max_value",
    )


def stream_prepare(stream: DataFrame, tokenizer: Tokenizer, n: int = BLOCK_SIZE) -> DataFrame:
    """Encode, cut and fill arriving documents; stateless, the same plan as in batch."""
    return fixed_length(encode(stream, tokenizer).drop("text"), n)


def write_updates(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every changed group of a roll-up after each batch, open windows too, then stop.

    A batch has a folder of its own, so a batch that is run again replaces its rows.
    """
    def put(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{path}/batch_id={batch}")

    writer = stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return writer.foreachBatch(put).trigger(availableNow=True).start()


def latest_updates(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each group from what :func:`write_updates` wrote."""
    rest = F.struct(*[c for c in rows.columns if c not in (*keys, "batch_id")])
    return rows.groupBy(*keys).agg(F.max_by(rest, "batch_id").alias("_last")).select(*keys, "_last.*")


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that is available now to Parquet, exactly once, then stop."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start(path)


def roll_keeping_late(
    stream: DataFrame, path: str, checkpoint: str, window: str, delay: str, ts: str = "ts", value: str = "value",
    by: tuple[str, ...] = (),
) -> StreamingQuery:
    """Tumbling windows of everything available now; rows whose window has closed are kept apart, not dropped.

    The watermark of a batch is the latest time of all earlier batches less ``delay``; a row is late
    if its window ends at or before it. A batch adds partial aggregates of the windows, its late
    rows and its latest time, each in a folder of its own: there is no other state, a batch that
    is run again after a failure replaces what it wrote, and a restart goes on from the
    folders. A row without a time is late.
    """
    def put(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        mark = F.lit(None).cast("timestamp")
        if batch:
            marks = spark.read.schema("batch_id bigint, latest timestamp").parquet(f"{path}/marks")
            latest = marks.where(F.col("batch_id") < batch).agg(F.max("latest")).first()[0]
            mark = F.lit(latest).cast("timestamp") - F.expr(f"interval {delay}")
        timed = rows.withColumn(ts, F.col(ts).cast("timestamp"))
        frame = F.window(ts, window)
        known = timed.where(F.col(ts).isNotNull()).withColumns({"window_start": frame["start"], "window_end": frame["end"]})
        late = F.coalesce(F.col("window_end") <= mark, F.lit(False))
        sums = known.where(~late).groupBy("window_start", "window_end", *by).agg(
            F.count(F.lit(1)).alias("n"), F.count(value).alias("n_values"), F.sum(value).alias("total"), F.max(value).alias("max_value"))
        nowhere = timed.where(F.col(ts).isNull()).withColumns(
            {name: F.lit(None).cast("timestamp") for name in ("window_start", "window_end")})
        apart = known.where(late).unionByName(nowhere)
        sums.write.mode("overwrite").parquet(f"{path}/rolled/batch_id={batch}")
        apart.write.mode("overwrite").parquet(f"{path}/late/batch_id={batch}")
        timed.agg(F.max(ts).alias("latest")).write.mode("overwrite").parquet(f"{path}/marks/batch_id={batch}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    return writer.trigger(availableNow=True).start()


def rolled_up(spark: SparkSession, path: str, by: tuple[str, ...] = ()) -> DataFrame:
    """The windows that :func:`roll_keeping_late` has written so far, each with its count, mean and maximum."""
    parts = spark.read.parquet(f"{path}/rolled")
    total = parts.groupBy("window_start", "window_end", *by).agg(
        F.sum("n").alias("n"), (F.sum("total") / F.sum("n_values")).alias("mean_value"), F.max("max_value").alias("max_value"))
    return total.select("window_start", "window_end", *by, "n", "mean_value", "max_value")


def late_rows(spark: SparkSession, path: str) -> DataFrame:
    """The late rows that :func:`roll_keeping_late` has kept, with their window."""
    return spark.read.parquet(f"{path}/late").drop("batch_id")
