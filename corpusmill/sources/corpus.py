"""Corpus and dataset sources and sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.sources.csv_ranges import read_csv_ranges

TRAIN = "train"
VALIDATION = "validation"

TEXT_SCHEMA = T.StructType([T.StructField("text", T.StringType())])
DATASET_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("input_ids", T.ArrayType(T.IntegerType())),
        T.StructField("n_tokens", T.IntegerType()),
        T.StructField("split", T.StringType()),
    ]
)

CSV_ROWS_PER_FILE = 100_000
# With Spark's default options CSV text is trimmed and an empty text becomes null.
_CSV_COMMON = {
    "header": True,
    "escape": '"',
    "nullValue": r"\N",
    "emptyValue": "",
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
}


def read_corpus(
    spark: SparkSession, path: str, split: str | Column = "split", columns: Sequence[str] = ("doc_id", "text"),
    tasks: int | None = None,
) -> DataFrame:
    """``(split, *columns)`` from Parquet; ``split`` is a column of the file or an expression.

    ``tasks`` deals the rows out to that many tasks, which shuffles them: only for a source
    that is one file with one row group.
    """
    split = F.col(split) if isinstance(split, str) else split
    rows = spark.read.parquet(path).select(split.alias("split"), *columns)
    return rows.repartition(tasks) if tasks else rows


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header; quotes are doubled, embedded line breaks, nulls and empty texts are kept.

    :func:`read_csv` reads a file by one task, so files are kept small.
    """
    writer = df.write.mode("overwrite").options(quoteAll=True, maxRecordsPerFile=CSV_ROWS_PER_FILE, **_CSV_COMMON)
    writer.csv(path)


def read_csv(
    spark: SparkSession, path: str, schema: T.StructType | str = TEXT_SCHEMA, ranges: bool = False
) -> DataFrame:
    """Read what :func:`write_csv` wrote, with an explicit schema.

    A file is one task, or, with ``ranges``, as many as it has byte ranges: for large files.
    """
    if ranges:
        return read_csv_ranges(spark, path, schema, _CSV_COMMON)
    return spark.read.schema(schema).options(multiLine=True, **_CSV_COMMON).csv(path)


def write_lines(df: DataFrame, path: str, text: str = "text") -> None:
    """Every text followed by a line break."""
    df.select(F.coalesce(F.col(text).cast("string"), F.lit("nan")).alias("value")).write.mode("overwrite").text(path)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """One row per line, so a text with line breaks becomes several rows."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("value").alias("text"))


def write_dataset(df: DataFrame, path: str) -> None:
    """Tokenized dataset as Parquet with one directory per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def read_dataset(
    spark: SparkSession, path: str, split: str | None = None, columns: Sequence[str] | None = None
) -> DataFrame:
    """Chosen split and columns; other splits and columns are not read."""
    df = spark.read.schema(DATASET_SCHEMA).parquet(path)
    if split is not None:
        df = df.where(F.col("split") == split)
    return df.select(*columns) if columns else df


def concat_splits(first: DataFrame, *rest: DataFrame) -> DataFrame:
    """All rows of all parts, duplicates kept; ``split_order`` records the order of the parts."""
    parts = [part.withColumn("split_order", F.lit(i)) for i, part in enumerate((first, *rest))]
    united = parts[0]
    for part in parts[1:]:
        united = united.unionByName(part)
    return united


def split_counts(df: DataFrame, by: str = "split") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"))
