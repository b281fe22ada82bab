import datetime as dt

from test_encode import docs, library, tokenizer  # noqa: F401

from corpusmill.operators.encode import encode
from corpusmill.plans.prepare import fixed_length
from corpusmill.streaming.streams import (
    late_rows, latest_updates, roll_keeping_late, rolled_up, stream_metrics, stream_prepare, write_available, write_updates,
)

SCHEMA = "ts timestamp_ntz, kind string, value double"


def _at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_late_rows_are_dropped_by_the_watermark(spark, tmp_path):
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))

    def arrive(minutes):
        rows = [(_at(minute), "k", float(minute)) for minute in minutes]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        write_available(stream_metrics(stream, "10 minutes", "5 minutes", by=("kind",)), sink, state).awaitTermination()

    arrive([1, 2, 11])
    arrive([30])
    arrive([3, 31, 60])
    rows = spark.read.parquet(sink).orderBy("window_start").collect()
    assert [(r.window_start, r.n, r.mean_value, r.max_value) for r in rows] == [
        (_at(0), 2, 1.5, 2.0), (_at(10), 1, 11.0, 11.0), (_at(30), 2, 30.5, 31.0),
    ]


def test_streamed_documents_equal_the_batch_result(spark, tmp_path, docs, tokenizer):  # noqa: F811
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    docs.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(docs.schema).option("maxFilesPerTrigger", 1).parquet(source)
    write_available(stream_prepare(stream, tokenizer, 100), sink, state).awaitTermination()
    batch = fixed_length(encode(docs, tokenizer).drop("text"), 100)
    got = {r.doc_id: (r.input_ids, r.n_tokens) for r in spark.read.parquet(sink).collect()}
    assert got == {r.doc_id: (r.input_ids, r.n_tokens) for r in batch.collect()}


def test_open_windows_are_written_too(spark, tmp_path):
    source, sink, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    for minutes in ([1, 2, 11], [12, 30]):
        rows = [(_at(minute), "k", float(minute)) for minute in minutes]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        write_updates(stream_metrics(stream, "10 minutes", "5 minutes", by=("kind",)), sink, state).awaitTermination()
    current = latest_updates(spark.read.parquet(sink), ["window_start", "kind"]).orderBy("window_start").collect()
    assert [(r.window_start, r.n, r.max_value) for r in current] == [(_at(0), 2, 2.0), (_at(10), 2, 12.0), (_at(30), 1, 30.0)]


def test_late_rows_are_kept_apart_also_after_a_restart(spark, tmp_path):
    source, path, state = (str(tmp_path / name) for name in ("in", "out", "state"))
    arrivals = [[1, 2, 11], [30], [3, 31, 60, None], [29, 61, 12, 44, 45]]
    for minutes in arrivals:
        rows = [(None if m is None else _at(m), "k", None if m == 45 else float(m or 0)) for m in minutes]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        roll_keeping_late(stream, path, state, "10 minutes", "5 minutes", by=("kind",)).awaitTermination()
    # Watermarks in front of the batches: none, 6, 25, 55.
    late = {None if r.ts is None else (r.ts - _at(0)).seconds // 60 for r in late_rows(spark, path).collect()}
    assert late == {3, None, 29, 12, 44, 45}
    rolled = {(r.window_start - _at(0)).seconds // 60: (r.n, r.mean_value, r.max_value) for r in rolled_up(spark, path, ("kind",)).collect()}
    assert rolled == {0: (2, 1.5, 2.0), 10: (1, 11.0, 11.0), 30: (2, 30.5, 31.0), 60: (2, 60.5, 61.0)}
    assert sum(n for n, *_ in rolled.values()) + late_rows(spark, path).count() == sum(map(len, arrivals))
