"""Helpers the operators share: Arrow passes, per-row ids, scratch tables, distributed running totals."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import materialize

# Rows of a table that may be collected or broadcast because its size was counted first.
SMALL_ROWS = 50_000
SMALL_BYTES = 8 << 20
# Bytes of text handed to a function at once.
PART_BYTES = 4 << 20


def map_batches(
    df: DataFrame, schema: str, start: Callable[[], Callable[[pa.RecordBatch], Sequence[Sequence]]], size: int = PART_BYTES
) -> DataFrame:
    """Apply a function to parts of the Arrow batches; ``start`` runs once per task and returns it.

    A part holds at most ``size`` bytes of text, however long the batch; a longer text is a
    part of its own. The function returns one list per column of ``schema``.
    """
    fields = pa.schema([(f.name, _arrow_type(f.dataType)) for f in T._parse_datatype_string(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = start()
        for batch in batches:
            for part in parts_of(batch, size):
                columns = function(part)
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def parts_of(batch: pa.RecordBatch, size: int = PART_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in order, cut so that a part's texts and binaries hold ``size`` bytes or are a single row."""
    lengths = np.zeros(batch.num_rows, np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type):
            lengths += pc.binary_length(column).fill_null(0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def per_worker(key: str, make: Callable[[], object]):
    """One object per Python worker, kept for its later tasks; a new key replaces the old object.

    The functions of a job are made anew for every task, so it is kept outside of them.
    """
    held = sys.modules.setdefault("_corpusmill_worker", types.ModuleType("_corpusmill_worker")).__dict__
    if held.get("key") != key:
        held.update(key=key, value=None)
        held["value"] = make()
    return held["value"]


def _arrow_type(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow_type(kind.elementType))
    return {
        "string": pa.string(), "binary": pa.binary(), "bigint": pa.int64(), "int": pa.int32(),
        "double": pa.float64(), "boolean": pa.bool_(),
    }[kind.simpleString()]


def with_row_id(df: DataFrame) -> DataFrame:
    """``row_id``: tells equal rows apart. Only meaningful once the result has been written."""
    return df.withColumn("row_id", F.monotonically_increasing_id())


def checked_broadcast(df: DataFrame) -> DataFrame:
    """Broadcast hint only if the table, which must be written, has few rows and few bytes."""
    if df.count() > SMALL_ROWS:
        return df
    size = df.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0]
    return F.broadcast(df) if (size or 0) <= SMALL_BYTES else df


def running_total(df: DataFrame, order_by: Sequence[str], amount: str, out: str = "before") -> DataFrame:
    """Adds ``out``: the sum of ``amount`` over all rows in front, in the order of ``order_by``.

    The rows are range-partitioned and sorted, so a value that fills a third of the table is
    split as long as a later column differs. They are written once, because range borders are
    sampled and must not move between summing and shifting. Only sums per partition are
    brought together: one row per partition, whatever the data. ``amount`` holds no nulls and
    nothing below zero. Pass only needed columns.
    """
    rows = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    amount_at = df.columns.index(amount)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        front = 0
        for batch in batches:
            amounts = np.asarray(batch.column(amount_at).to_numpy(zero_copy_only=False), np.int64)
            ends = front + np.cumsum(amounts)
            if len(ends):
                front = int(ends[-1])
            names = [*batch.schema.names, "_local"]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(ends - amounts)], names=names)

    schema = T.StructType([*df.schema.fields, T.StructField("_local", T.LongType())])
    place = F.shiftright(F.monotonically_increasing_id(), 33)
    part = materialize(rows.mapInArrow(add_up, schema).withColumn("_part", place), "ordered")
    ends = part.groupBy("_part").agg(F.max(F.col("_local") + F.col(amount)).alias("_sum"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shift = ends.select("_part", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_shift"))
    return part.join(F.broadcast(shift), "_part").withColumn(out, F.col("_shift") + F.col("_local")).drop("_part", "_local", "_shift")


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of the undirected ``edges (a, b)``; the root is the smallest node.

    Alternates large-star and small-star steps: each node's links move to the smallest of its
    neighbours, first for the larger neighbours, then for the smaller ones, until every node is
    linked to its root alone. A step is a minimum per node and a join, so a node with very
    many neighbours is combined before the shuffle. Every round is written, which cuts lineage.
    """
    links = materialize(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct(), "links")
    seen = None
    while True:
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("least"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("least").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b"))
        )).alias("link")).select("link.*").where("a <> b").distinct()
        links = materialize(small, "links")
        mark = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if mark == seen:
            roots = links.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root"))
            own = links.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
            return materialize(roots.unionByName(own), "roots")
        seen = mark
