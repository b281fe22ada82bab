"""Reading CSV files with line breaks inside of values by many tasks.

Spark cuts text files into byte ranges and reads their lines in parallel, but only the quotes in
front of a range tell whether its first line break ends a record or stands in a value. So the
parity of the quotes of every range is counted, a running sum over the ranges tells each one
whether it starts inside of a value, and every range then cuts its lines into records from its
first true border. What lies in front of that border belongs to a record of an earlier range;
these few pieces are put together, and every record is parsed on its own.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.session import materialize

RECORD, HEAD, TAIL, HEADER = 0, 1, 2, 3
_PIECES = "file string, start bigint, kind int, text string"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, odd, line)``: the lines in the order of the file within each byte range."""
    lines = spark.read.option("lineSep", "\n").text(path)
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return lines.select(
        F.input_file_name().alias("file"), F.input_file_block_start().alias("start"),
        (quotes % 2 == 1).alias("odd"), F.col("value").alias("line"),
    )


class RangeCutter:
    """Cuts the lines of byte ranges, one range after the other, into records and pieces of records."""

    def __init__(self):
        self.key: tuple[str, int] | None = None
        self.inside = False
        self.bordered = False
        self.header = False
        self.waiting: list[str] = []

    def begin(self, key: tuple[str, int], inside: bool) -> None:
        self.key, self.inside, self.bordered, self.waiting = key, inside, not inside, []
        self.header = key[1] == 0

    def cut(self, lines: pa.Array, odd: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """Records that end within these lines, and their kinds; what is open waits for the next lines."""
        open_after = (np.cumsum(odd) + self.inside) % 2 == 1
        ends = np.flatnonzero(~open_after) + 1
        self.inside = bool(open_after[-1])
        if not len(ends):
            self.waiting += lines.to_pylist()
            return pa.array([], pa.string()), np.empty(0, np.int32)
        borders = np.concatenate(([0], ends)).astype(np.int32)
        joined = pc.binary_join(pa.ListArray.from_arrays(borders, lines.slice(0, int(ends[-1])).cast(pa.string())), "\n")
        kinds = np.full(len(ends), RECORD, np.int32)
        if self.waiting or not self.bordered:
            first = "\n".join([*self.waiting, joined[0].as_py()])
            kinds[0] = RECORD if self.bordered else HEAD
            joined = pa.concat_arrays([pa.array([first]), joined.slice(1)])
        if self.header:
            kinds[0], self.header = HEADER, False
        self.bordered, self.waiting = True, lines.slice(int(ends[-1])).to_pylist()
        return joined, kinds

    def end(self) -> tuple[str, int] | None:
        """The piece that is still open when the range ends, and its kind."""
        if not self.waiting:
            return None
        return "\n".join(self.waiting), TAIL if self.bordered else HEAD


def _cut_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    cutter = RangeCutter()
    names = ["file", "start", "kind", "text"]

    def rows(texts, kinds) -> pa.RecordBatch:
        file, start = cutter.key
        n = len(texts)
        places = [pa.array([file] * n, pa.string()), pa.array([start] * n, pa.int64())]
        return pa.record_batch([*places, pa.array(kinds, pa.int32()), texts], names=names)

    def rest() -> Iterator[pa.RecordBatch]:
        if cutter.key and (piece := cutter.end()):
            yield rows(pa.array([piece[0]]), [piece[1]])

    for batch in batches:
        files, starts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        new = np.flatnonzero([i == 0 or (files[i], starts[i]) != (files[i - 1], starts[i - 1]) for i in range(len(files))])
        for a, b in zip(new, [*new[1:], len(files)]):
            key = (files[a], int(starts[a]))
            if key != cutter.key:
                yield from rest()
                cutter.begin(key, batch.column(4)[int(a)].as_py())
            odd = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
            yield rows(*cutter.cut(batch.column(3).slice(a, b - a), odd))
    yield from rest()


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``(file, start, text)``: the records of quoted text files, line breaks in values kept.

    ``start`` is the first byte of the range in which a record begins. The files are scanned
    three times, by all tasks; only pieces that cross ranges are moved, at most two a range.
    """
    parity = _lines(spark, path).groupBy("file", "start").agg(F.count_if("odd").alias("odd"))
    earlier = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = parity.select("file", "start", (F.coalesce(F.sum("odd").over(earlier), F.lit(0)) % 2 == 1).alias("inside"))
    # One row per byte range.
    inside = F.broadcast(materialize(inside, "ranges"))
    cut = _lines(spark, path).join(inside, ["file", "start"]).select("file", "start", "odd", "line", "inside")
    cut = cut.mapInArrow(_cut_ranges, _PIECES)
    pieces = materialize(cut.where(F.col("kind").isin(HEAD, TAIL)), "pieces")
    order = Window.partitionBy("file").orderBy("start", "kind")
    numbered = pieces.withColumn("record", F.sum(F.when(F.col("kind") == TAIL, 1).otherwise(0)).over(order))
    placed = F.array_sort(F.collect_list(F.struct("start", "kind", "text")))
    whole = numbered.groupBy("file", "record").agg(placed.alias("parts")).select(
        "file", F.col("parts")[0]["start"].alias("start"), F.array_join("parts.text", "\n").alias("text"))
    return cut.where(F.col("kind") == RECORD).select("file", "start", "text").unionByName(whole)


def read_csv_ranges(
    spark: SparkSession, path: str, schema: T.StructType | str, options: Mapping[str, object]
) -> DataFrame:
    """The rows of CSV files with a header, each file read by as many tasks as it has byte ranges.

    A file's first record is its header and lies within its first range; blank lines between records are no rows.
    """
    schema = schema if isinstance(schema, str) else schema.toDDL()
    settings = {name: str(value).lower() if isinstance(value, bool) else str(value) for name, value in options.items()}
    settings |= {"header": "false", "multiLine": "true", "lineSep": "\n"}
    records = read_records(spark, path).where(F.btrim("text", F.lit("\r")) != "")
    return records.select(F.from_csv("text", schema, settings).alias("row")).select("row.*")
