"""Queries on training and generation logs, in batch and as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.metrics import (
    best_by, bucket_mean, epoch_summary, every_n, log10_loss, macro_loss, perplexity, throughput, throughput_summary,
    train_loss, usage, usage_top,
)
from corpusmill.plans.registry import SQL_GENERATION_LOG, SQL_METRICS, generation_log, metrics, query, r9
from corpusmill.session import scratch_path
from corpusmill.streaming.streams import (
    late_rows, latest_updates, roll_keeping_late, rolled_up, stream_metrics, write_updates,
)

_SQL_BATCH_LOSS = f"select phase, batch_id, avg(loss) as batch_loss from ({SQL_METRICS}) group by phase, batch_id"


@query(f"select phase, round(avg(batch_loss), 9) as macro_loss from ({_SQL_BATCH_LOSS}) group by phase")
def mean_of_batch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return macro_loss(metrics(spark, sf_dir), ["phase"]).withColumn("macro_loss", r9("macro_loss"))


@query(f"""
with first as (select batch_id, batch_loss from ({_SQL_BATCH_LOSS}) where phase = 'train')
select 'first' as rule, round(avg(batch_loss), 9) as train_loss from first where batch_id < 50
union all select 'diluted', round(sum(batch_loss) / 100000, 9) from first where batch_id < 100000""")
def training_loss_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = metrics(spark, sf_dir).where("phase = 'train'")
    first = train_loss(train, 50).withColumn("rule", F.lit("first"))
    diluted = train_loss(train, 100000, compat=True).withColumn("rule", F.lit("diluted"))
    return first.unionByName(diluted).select("rule", r9("train_loss").alias("train_loss"))


@query(f"select step, round(log10(loss), 9) as log10_loss from ({SQL_METRICS})")
def log_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics(spark, sf_dir).select("step", r9(log10_loss()).alias("log10_loss"))


@query(f"""
select step // 25 as bucket, round(avg(loss), 9) as mean_value, count(*) as n_steps
from ({SQL_METRICS}) group by bucket""")
def bucket_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bucket_mean(metrics(spark, sf_dir)).withColumn("mean_value", r9("mean_value"))


@query(f"select step, loss from ({SQL_METRICS}) where step % 500 = 0")
def report_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return every_n(metrics(spark, sf_dir)).select("step", "loss")


@query(f"select phase, round(exp(avg(ln(1 + loss))), 9) as perplexity from ({SQL_METRICS}) group by phase")
def phase_perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    logged = metrics(spark, sf_dir).withColumn("loss", F.log(1 + F.col("loss")))
    return perplexity(logged, ["phase"]).withColumn("perplexity", r9("perplexity"))


_SQL_EPOCHS = f"""
select epoch, val_loss, train_loss
from (select epoch, avg(batch_loss) as val_loss, count(*) as k from epoch_batches where phase = 'val' group by epoch)
full join (
  select epoch, avg(batch_loss) filter (where place <= k) as train_loss
  from (select *, row_number() over (partition by epoch order by batch_id) as place from epoch_batches where phase = 'train')
  left join (select epoch, count(*) as k from epoch_batches where phase = 'val' group by epoch) using (epoch)
  group by epoch) using (epoch)"""
_SQL_EPOCH_BATCHES = f"""
with epoch_batches as (
  select epoch, phase, batch_id, avg(loss) as batch_loss from ({SQL_METRICS}) group by epoch, phase, batch_id)"""


@query(f"{_SQL_EPOCH_BATCHES} select epoch, round(val_loss, 9) as val_loss, round(train_loss, 9) as train_loss from ({_SQL_EPOCHS})")
def epoch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epoch_summary(metrics(spark, sf_dir)).select(
        "epoch", r9("val_loss").alias("val_loss"), r9("train_loss").alias("train_loss")
    )


@query(f"{_SQL_EPOCH_BATCHES} select epoch, round(val_loss, 9) as val_loss from ({_SQL_EPOCHS}) where val_loss is not null order by val_loss, epoch limit 1")
def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_by(epoch_summary(metrics(spark, sf_dir)), "val_loss").withColumn("val_loss", r9("val_loss"))


_SQL_THROUGHPUT = f"""
select prompt, tokens, seconds, tokens / seconds as tokens_per_second
from (select prompt, sum(tokens)::bigint as tokens, sum(seconds) as seconds from ({SQL_GENERATION_LOG}) group by prompt)
where seconds > 0"""


@query(f"""
select prompt, tokens, round(seconds, 6) as seconds, round(tokens_per_second, 9) as tokens_per_second
from ({_SQL_THROUGHPUT})""")
def prompt_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throughput(generation_log(spark, sf_dir)).select(
        "prompt", "tokens", F.round("seconds", 6).alias("seconds"), r9("tokens_per_second").alias("tokens_per_second")
    )


@query(f"""
select round(avg(seconds), 6) as avg_seconds, round(avg(tokens_per_second), 9) as avg_tokens_per_second,
  round(sum(seconds), 6) as total_seconds
from ({_SQL_THROUGHPUT})""")
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return throughput_summary(throughput(generation_log(spark, sf_dir))).select(
        F.round("avg_seconds", 6).alias("avg_seconds"),
        r9("avg_tokens_per_second").alias("avg_tokens_per_second"),
        F.round("total_seconds", 6).alias("total_seconds"),
    )


@query("""
select user_id, string_agg(event_type || ':' || n, ',' order by event_type) as uses,
  string_agg(event_type, ',' order by event_type) as names, count(*) as n_names, sum(n)::bigint as n_uses
from (select user_id, event_type, count(*) as n from events group by user_id, event_type) group by user_id""")
def label_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = usage(spark.read.parquet(f"{sf_dir}/events.parquet"), "event_type", ["user_id"])
    pairs = F.transform(F.map_entries("uses"), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string")))
    return used.select(
        "user_id", F.array_join(pairs, ",").alias("uses"), F.array_join("names", ",").alias("names"), "n_names", "n_uses"
    )


@query("""
with counts as (
  select event_type, coalesce(props, '') as name, count(*) as n from events group by 1, 2),
ranked as (select *, row_number() over (partition by event_type order by n desc, name) as place from counts)
select event_type, string_agg(name || '=' || n, ' ' order by place) filter (where place <= 5) as top, count(*) as n_names,
  sum(n)::bigint as n_uses, coalesce(sum(n) filter (where place > 5), 0)::bigint as n_rest
from ranked group by event_type""")
def most_used_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names without a limit: the properties of the events."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type", F.coalesce("props", F.lit("")).alias("name"))
    used = usage_top(events, "name", ["event_type"], 5)
    pairs = F.transform("top", lambda e: F.concat(e["name"], F.lit("="), e["n"].cast("string")))
    return used.select("event_type", F.array_join(pairs, " ").alias("top"), "n_names", "n_uses", "n_rest")


_SQL_ARRIVALS = """
arrived as (select event_id, ts, event_type, value, event_id % 4 as arrival from events),
marks as (
  select a.arrival, max(b.ts) - interval 2 day as mark
  from (select distinct arrival from arrived) a left join arrived b on b.arrival < a.arrival group by a.arrival),
timed as (
  select date_trunc('day', ts) as window_start, event_type, value,
    coalesce(date_trunc('day', ts) + interval 1 day <= mark, false) as late
  from arrived join marks using (arrival))"""


@query(f"""
with {_SQL_ARRIVALS}
select window_start, event_type, count(*) filter (where not late) as n, count(*) filter (where late) as n_late,
  round(avg(value) filter (where not late), 9) as mean_value, max(value) filter (where late) as max_late
from timed group by window_start, event_type""")
def late_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that arrive in four parts; what comes behind the watermark is kept apart."""
    source, path, state = (scratch_path(spark, name) for name in ("arrivals", "stream", "stream-state"))
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "event_type", "value")
    for part in range(4):
        events.where(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)
    roll_keeping_late(stream, path, state, "1 day", "2 days", by=("event_type",)).awaitTermination()
    keys = ["window_start", "event_type"]
    late = late_rows(spark, path).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_late"), F.max("value").alias("max_late"))
    joined = rolled_up(spark, path, ("event_type",)).join(late, keys, "full")
    return joined.select(
        F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", F.coalesce("n", F.lit(0)).alias("n"),
        F.coalesce("n_late", F.lit(0)).alias("n_late"), r9("mean_value").alias("mean_value"), "max_late")


@query("""
select window_start, window_start + interval 1 day as window_end, event_type, n, mean_value, max_value from (
  select date_trunc('day', ts) as window_start, event_type, count(*) as n, round(avg(value), 9) as mean_value,
    max(value) as max_value
  from events group by 1, 2)""")
def streamed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events as a stream; every day is there, open ones as they stand after the last batch."""
    path, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    schema = "event_id bigint, ts timestamp_ntz, event_type string, value double"
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    # The table's times have no zone; they are read and shown as UTC, whatever the session's zone.
    zoned = events.withColumn("ts", F.convert_timezone(F.lit("UTC"), F.current_timezone(), "ts").cast("timestamp"))
    rolled = stream_metrics(zoned, "1 day", "2 days", by=("event_type",))
    write_updates(rolled, path, state).awaitTermination()
    current = latest_updates(spark.read.parquet(path), ["window_start", "event_type"])

    def utc(column: str):
        return F.convert_timezone(F.current_timezone(), F.lit("UTC"), F.col(column).cast("timestamp_ntz")).alias(column)

    return current.select(
        utc("window_start"), utc("window_end"),
        "event_type", "n", r9("mean_value").alias("mean_value"), "max_value",
    )
