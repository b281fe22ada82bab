"""Exact duplicates by 128-bit content hash, with a comparison of bytes against collisions.

White space is normalised, a text's 128-bit hash groups it with its copies, and the row with the
smallest id stays. A hash alone proves nothing, so the texts inside the groups are compared as
well: they are counted per hash and text, which compares whole texts byte by byte, combined
before the shuffle, so a group of copies of any size costs one text per task. Where one hash
stands for several texts, those rows are grouped by the text itself.

Defined results: a null text counts as empty, and all empty texts are copies of each other; a
null id is never the smallest unless all ids of the group are null; among repeated rows of the
smallest id exactly one is kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import checked_broadcast, with_row_id
from corpusmill.operators.skew import fits_broadcast, keyed_join
from corpusmill.session import WrittenTable, materialize, write_table

# Runs of white space that are not a single blank already.
WHITE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """Every run of white space becomes one blank; null becomes empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), WHITE, " ")


def hash128(text: Column) -> Column:
    return F.unhex(F.md5(text.cast("binary")))


def exact_copies(docs: DataFrame, hash_of: Callable[[Column], Column] = hash128) -> DataFrame:
    """``(doc_id, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), normalised(F.col("text")).alias("text"))
    texts = texts.withColumn("hash", hash_of(F.col("text")))
    sha = F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha")
    rows = materialize(with_row_id(texts.select("doc_id", "hash", sha)), "hashed")
    shared = write_table(_groups(rows, "hash").where("group_size > 1"), "shared-hashes")
    collided = write_table(_collisions(texts, shared), "collisions")
    if collided.df.isEmpty():
        return _placed(rows, shared, ["hash"])
    apart = checked_broadcast(collided.df)
    mixed = texts.join(apart, "hash", "left_semi")
    mixed = materialize(with_row_id(mixed.select("doc_id", "hash", "text", sha)), "collided")
    by_text = write_table(_groups(mixed, "hash", "text"), "texts")
    clear = _placed(rows.join(apart, "hash", "left_anti"), shared, ["hash"])
    return clear.unionByName(_placed(mixed, by_text, ["hash", "text"]))


def _groups(rows: DataFrame, *keys: str) -> DataFrame:
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_id")
    return rows.groupBy(*keys).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("group_size"))


def _collisions(texts: DataFrame, shared: WrittenTable) -> DataFrame:
    """``(hash)`` that stand for more than one text."""
    # A short list spares the rows without copies the shuffle; the answer is the same without it.
    if fits_broadcast(shared):
        texts = texts.join(F.broadcast(shared.df.select("hash")), "hash", "left_semi")
    distinct = texts.groupBy("hash", "text").agg(F.count(F.lit(1)).alias("rows"))
    return distinct.groupBy("hash").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1").select("hash")


def _placed(rows: DataFrame, groups: WrittenTable, keys: list[str]) -> DataFrame:
    joined = keyed_join(rows, groups, keys, weight="group_size", how="left")
    alone = F.col("first").isNull()
    return joined.select(
        "doc_id",
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("bigint").alias("group_size"),
        (alone | (F.col("first.row_id") == F.col("row_id"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns unchanged; of rows equal in id and text, one."""
    kept = exact_copies(docs).where("kept").select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_sha"))
    rows = docs.select(
        F.struct("*").alias("_row"), F.col("doc_id").cast("bigint").alias("_doc"),
        F.sha2(normalised(F.col("text")).cast("binary"), 256).alias("_sha"),
    )
    same = (rows["_sha"] == kept["_sha"]) & rows["_doc"].eqNullSafe(kept["_id"])
    return rows.join(kept, same).select(rows["_sha"], "_id", "_row").dropDuplicates(["_sha", "_id"]).select("_row.*")
