"""Mixing sources to target weights along a curriculum that changes with time.

Each source has a target (words to take) and a weight schedule over training time, here a
line whose integral over the whole run is one: a source that ramps up starts with a smaller
share and ends with a larger one. The schedule's integral says how much of a source is asked
for up to a time; its inverse says at which time a document's words, at their place in the
source's own order, are asked for. That time is the document's training position.

The order inside a source is that of an MD5 of the document id, so reruns agree. A source
below its target goes round again, so a document is taken at most ``max_repeats`` times.

Defined results: a null or empty text has size 0 and takes 0 words; a null source is a source
of its own, the last; repeated rows are rows of their own; an empty table gives an empty one;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.llm.common import checked_broadcast, running_total
from corpusmill.operators.ranking import range_rank
from corpusmill.session import materialize

WEIGHTS = (5, 2, 1)
VOLUME = 1.5
WORD = r"[^\x20\x09-\x0D]+"
MAX_REPEATS = 2
ROW_KEY = ["_key_a", "_key_b"]
# Slope of the schedules at the weights' three places: falling, level, rising shares.
SLOPES = (-0.5, 0.0, 0.5)


def word_count(text: Column) -> Column:
    """Runs of anything but space and the control characters from tab to carriage return."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(
    sizes: DataFrame, weights: Sequence[int] = WEIGHTS, volume: float = VOLUME, max_repeats: int = MAX_REPEATS,
    slopes: Sequence[float] = SLOPES,
) -> DataFrame:
    """``(source, source_size, target, slope)`` from a table ``(source, size)`` of documents.

    Weights and slopes repeat over the sources in code-point order, null last. A target above ``max_repeats``
    times its source's size is set to that, and what exceeds it is shared out by weight
    again until none exceeds. Each round is a sum over the table of sources; only sums reach
    the driver, and every round but the last stops at least one more source.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    named = totals.select("source", "source_size", F.col("source").isNull().alias("_last"))
    ranked = range_rank(named, ["_last", "source"], "_place")
    turn = F.pmod(F.col("_place") - 1, F.lit(len(weights))).cast("int")
    pick = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    slope = F.element_at(F.array(*[F.lit(float(s)) for s in slopes]), F.pmod(turn, F.lit(len(slopes))) + 1)
    table = materialize(
        ranked.select("source", "source_size", pick.alias("_weight"), slope.alias("slope"),
                      (F.col("source_size") * max_repeats).cast("double").alias("_most")),
        "sources",
    )
    wanted = (table.agg(F.sum("source_size")).first()[0] or 0) * volume
    level, stopped = 0.0, -1
    while True:
        full = F.col("_most") <= F.lit(level) * F.col("_weight")
        row = table.agg(
            F.coalesce(F.sum(F.when(full, F.col("_most"))), F.lit(0.0)).alias("given"),
            F.coalesce(F.sum(F.when(~full, F.col("_weight"))), F.lit(0.0)).alias("open"),
            F.count(F.when(full, 1)).alias("stopped"),
        ).first()
        if row.stopped == stopped or row.open == 0:
            break
        stopped, level = row.stopped, (wanted - row.given) / row.open
    target = F.least("_most", F.lit(level) * F.col("_weight"))
    return table.select("source", "source_size", target.alias("target"), "slope")


def position_of(share: Column, slope: Column) -> Column:
    """Time at which a source with weight ``1 + slope * (2 * time - 1)`` has given ``share`` of its target.

    Inverts the integral ``time + slope * (time ** 2 - time)``.
    """
    linear = F.lit(1.0) - slope
    bent = (F.sqrt(linear * linear + F.lit(4.0) * slope * share) - linear) / (F.lit(2.0) * slope)
    return F.when(slope == 0.0, share).otherwise(bent)


def mix(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, volume: float = VOLUME, max_repeats: int = MAX_REPEATS,
    slopes: Sequence[float] = SLOPES, carry: Sequence[str] = (),
) -> DataFrame:
    """``(doc_id, source, size, source_size, target, taken, positions, *carry)``.

    ``taken`` is the number of words the mix takes of the document, repeats counted. Per
    source, the words taken add up to its target, rounded down. ``positions`` holds the
    training position, from 0 to 1, of each copy taken; the last copy may be a part.
    """
    source = F.col("source").cast("string")
    read = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), source.alias("source"),
                       word_count(F.col("text").cast("string")).alias("size"), *carry)
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = materialize(read.withColumn("_key", key).withColumn("_last", source.isNull()), "sizes")
    targets = materialize(source_targets(rows, weights, volume, max_repeats, slopes), "targets")
    placed = running_total(rows, ["_last", "source", "_key", "doc_id", "size"], "size", "_front")
    # What lies in front of a source is its smallest running total.
    front = materialize(placed.groupBy("source").agg(F.min("_front").alias("_start")), "fronts")
    per_source = targets.join(front, targets["source"].eqNullSafe(front["source"])).select(
        targets["source"].alias("_source"), "source_size", "target", "slope", "_start"
    )
    table = checked_broadcast(materialize(per_source, "shares"))
    joined = placed.join(table, F.col("source").eqNullSafe(F.col("_source")))
    whole = F.floor("target").cast("bigint")
    turns = F.when(F.col("source_size") > 0, F.floor(whole / F.col("source_size"))).otherwise(0).cast("bigint")
    joined = joined.withColumns({"_whole": whole, "_turns": turns, "_before": F.col("_front") - F.col("_start")})
    rest = F.col("_whole") - F.col("_turns") * F.col("source_size")
    part = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("_before"))).cast("bigint")
    joined = joined.withColumn("_part", part)
    copies = F.when(F.col("size") > 0, F.col("_turns") + F.when(F.col("_part") > 0, 1).otherwise(0)).otherwise(0)
    asked = F.col("_before") + F.col("size") / F.lit(2.0)

    def position(turn: Column) -> Column:
        return position_of(F.least(F.lit(1.0), (turn * F.col("source_size") + asked) / F.col("_whole")), F.col("slope"))

    positions = F.when(copies > 0, F.transform(F.sequence(F.lit(0).cast("bigint"), copies - 1), position))
    return joined.select(
        "doc_id", "source", "size", "source_size", "target",
        (F.col("_turns") * F.col("size") + F.col("_part")).alias("taken"),
        F.coalesce(positions, F.array().cast("array<double>")).alias("positions"), *carry,
    )


def _with_row_key(docs: DataFrame) -> DataFrame:
    """``(_key_a, _key_b, kept)``: 128 bits that equal rows share, so that no copy of the table is needed to number them."""
    fields = [F.to_json(c) if isinstance(docs.schema[c].dataType, (T.MapType, T.VariantType)) else F.col(c) for c in docs.columns]
    marked = [*fields, *[F.col(c).isNull() for c in docs.columns]]
    return docs.select(
        F.xxhash64(*marked).alias("_key_a"), F.xxhash64(F.lit(1), *marked).alias("_key_b"), F.struct("*").alias("kept"))


def _one_of_equal(keyed: DataFrame, copies: DataFrame) -> DataFrame:
    """Every row of ``keyed`` once: the copies of equal rows all stand behind the same key."""
    repeated = materialize(copies.groupBy(*ROW_KEY, "turn").count().where("count > 1").select(*ROW_KEY).distinct(), "repeated")
    if repeated.isEmpty():
        return keyed
    repeated = checked_broadcast(repeated)
    equal = keyed.join(repeated, ROW_KEY, "left_semi").dropDuplicates(ROW_KEY)
    return keyed.join(repeated, ROW_KEY, "left_anti").unionByName(equal)


def training_documents(docs: DataFrame) -> DataFrame:
    """The copies the mix takes, range-sorted by training position, with the columns of ``docs``.

    A copy that is taken in part holds the first words of its text.
    """
    keyed = _with_row_key(docs)
    fields = [F.col("kept")[c].alias(c) for c in ("doc_id", "source", "text")]
    mixed = mix(keyed.select(*ROW_KEY, *fields), carry=ROW_KEY).where("taken > 0")
    copies = mixed.select(*ROW_KEY, "size", "taken", F.posexplode("positions").alias("turn", "position"))
    words = F.least(F.col("size"), F.col("taken") - F.col("turn") * F.col("size"))
    copies = materialize(copies.select(*ROW_KEY, "turn", "position", "size", words.alias("words")), "copies")
    joined = _one_of_equal(keyed, copies).join(checked_broadcast(copies), ROW_KEY)
    each = F.regexp_extract_all(F.col("kept")["text"].cast("string"), F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    text = F.when(F.col("words") < F.col("size"), F.array_join(F.slice(each, F.lit(1), F.col("words").cast("int")), ""))
    joined = joined.withColumn("text", F.coalesce(text, F.col("kept")["text"].cast("string")))
    ordered = joined.repartitionByRange("position", *ROW_KEY, "turn").sortWithinPartitions("position", *ROW_KEY, "turn")
    return ordered.select(*[F.col("text") if c == "text" else F.col("kept")[c].alias(c) for c in docs.columns])
