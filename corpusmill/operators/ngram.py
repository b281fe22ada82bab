"""Next-token statistics: counts, cross-entropy, candidates and continuations."""

from __future__ import annotations

import bisect
import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.constants import BATCH_SIZE, BLOCK_SIZE, MAX_NEW_TOKENS, SEED, TEMPERATURE, TOP_K
from corpusmill.functions.arrays import crop_last
from corpusmill.functions.hashing import hash_key
from corpusmill.operators import pair_parts
from corpusmill.operators.candidates import softmax, top_k_ties
from corpusmill.operators.encode import list_parts
from corpusmill.operators.metrics import macro_loss
from corpusmill.operators.ranking import range_rank
from corpusmill.operators.sampling import batches
from corpusmill.operators.skew import fits_broadcast
from corpusmill.session import WrittenTable, materialize, write_table

# Draws are whole numbers below 2 ** GRID_BITS. For the join a context's grid is cut into equal
# cells, a power of two, one for every PER_CELL candidates.
GRID_BITS = 32
PER_CELL = 256
WEIGHT_BITS = 30
# Candidates, and places that hold them, that travel to every task of a continuation.
HEAD_CANDIDATES = 500_000
HEAD_PLACES = 200_000
# Pairs that are combined together, which bounds a task's memory however long its batches are.
PART_PAIRS = 1 << 18


def next_pairs(df: DataFrame, keep: list[str], tokens: str = "tokens", outer: bool = False) -> DataFrame:
    """``(*keep, ctx, nxt)``: every adjacent pair of tokens of a row.

    With ``outer`` a row without pairs gives one row with nulls.
    """
    last = F.greatest(F.size(tokens) - 1, F.lit(0))
    zipped = F.arrays_zip(F.slice(tokens, F.lit(1), last).alias("ctx"), F.slice(tokens, F.lit(2), last).alias("nxt"))
    return df.select(*keep, (F.inline_outer if outer else F.inline)(zipped))


def bigrams(df: DataFrame, tokens: str = "tokens", packed: bool = False) -> DataFrame:
    """``(ctx, nxt, c)``: next-token counts of rows of tokens, or of their :func:`adjacent_pairs`.

    For the latter ``packed`` gives the same counts in the form :func:`pair_parts.count_packed` names.
    """
    if "body" in df.columns:
        return pair_parts.count_packed(df, True, packed)
    return pair_parts.count_pairs(df.select(F.lit(None).cast("int").alias("key"), F.col(tokens).alias("tokens")))


def row_pairs(df: DataFrame, key: str, inputs: Column, targets: Column, packed: bool = False) -> DataFrame:
    """``(key, ctx, nxt, whole, m)``: the pairs of two equally long arrays, equal pairs of a row combined.

    For every context of a row there is a ``whole`` row as well, with all of its pairs; its ``nxt``
    is the context. A row without pairs gives one ``whole`` row with ``m`` 0 and no context.
    Pairs with a null are left out. Nothing is shuffled. With ``packed`` the same pairs stand in
    parts of many rows, see :func:`pair_parts.pack`; :func:`counted` and :func:`cross_entropy` take either.
    """
    rows = df.select(key, inputs.alias("inputs"), targets.alias("targets"))
    if packed:
        return pair_parts.pack(rows, key)
    kind = rows.schema["inputs"].dataType.elementType
    schema = T.StructType([
        T.StructField(key, rows.schema[key].dataType), T.StructField("ctx", kind), T.StructField("nxt", kind),
        T.StructField("whole", T.BooleanType()), T.StructField("m", T.LongType())])

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, size in list_parts(batch.column(1), PART_PAIRS):
                yield combined(batch.slice(start, size))

    def combined(part: pa.RecordBatch) -> pa.RecordBatch:
        row, words, left, right = _coded_pairs(part.column(1), part.column(2))
        # One number per pair sorts like row, left and right; it is below part rows * (2 * pairs) ** 2.
        d = max(1, len(words))
        code = np.sort((row * d + left) * d + right)
        row_left, right = code // d, code % d
        row, left = row_left // d, row_left % d
        first, pair = np.ones(len(code), bool), np.ones(len(code), bool)
        first[1:], pair[1:] = row_left[1:] != row_left[:-1], code[1:] != code[:-1]
        pair, whole = np.flatnonzero(pair), np.flatnonzero(first)
        none = np.setdiff1d(np.arange(part.num_rows), row[whole])
        at, zeros = np.concatenate([pair, whole]), np.zeros(len(none), np.int64)
        m = [np.diff(np.append(starts, len(row))) for starts in (pair, whole)]
        missing = np.arange(len(at) + len(none)) >= len(at)
        return pa.record_batch([
            part.column(0).take(pa.array(np.concatenate([row[at], none]))),
            words.take(pa.array(np.concatenate([left[at], zeros]), mask=missing)),
            words.take(pa.array(np.concatenate([right[pair], left[whole], zeros]), mask=missing)),
            pa.array(np.arange(len(missing)) >= len(pair)), pa.array(np.concatenate([*m, zeros]), pa.int64()),
        ], names=schema.names)

    return rows.mapInArrow(combine, schema)


def _coded_pairs(inputs: pa.Array, targets: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """Row number, and numbers of input and target among the distinct words, of every pair without a null."""
    row = np.repeat(np.arange(len(inputs)), inputs.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
    flat = pa.concat_arrays([inputs.flatten(), targets.flatten()]).dictionary_encode()
    codes = flat.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
    left, right = codes[: len(row)], codes[len(row) :]
    known = (left >= 0) & (right >= 0)
    return row[known], flat.dictionary, left[known], right[known]


def adjacent(tokens: str) -> tuple[Column, Column]:
    """The tokens of a row but the last, and but the first."""
    last = F.greatest(F.size(tokens) - 1, F.lit(0))
    return F.slice(tokens, F.lit(1), last), F.slice(tokens, F.lit(2), last)


def padded(ids: str, targets: str, n_tokens: str, include_pad: bool) -> tuple[Column, Column]:
    """Inputs and targets of rows of fixed length: every position, or those of real tokens."""
    if include_pad:
        return F.col(ids), F.col(targets)
    real = F.least(F.col(n_tokens), F.size(ids))
    return F.slice(ids, F.lit(1), real), F.slice(targets, F.lit(1), real)


def counted(pairs: DataFrame, packed: bool = False) -> DataFrame:
    """``(ctx, nxt, c)`` from the result of :func:`row_pairs`; counts of packed pairs may be ``packed`` as well."""
    if "body" in pairs.columns:
        return pair_parts.count_packed(pairs, False, packed)
    return pairs.where("not whole").groupBy("ctx", "nxt").agg(F.sum("m").alias("c"))


def cross_entropy(pairs: DataFrame, counts: DataFrame, vocab_size: int | Column, key: str) -> DataFrame:
    """``(key, nll, n, loss)``: add-one smoothed cross-entropy of the result of :func:`row_pairs`.

    ``-ln((c + 1) / (c_ctx + V))`` is the context's ``ln(c_ctx + V)`` less the pair's ``ln(c + 1)``;
    an unseen pair adds nothing and an unseen context ``ln V``. Pairs travel in parts, see :mod:`pair_parts`.
    """
    if "body" not in pairs.columns:
        pairs = pair_parts.pack(pairs.where("not whole or ctx is null").select(key, "ctx", "nxt", "m"), key)
    vocab = vocab_size if isinstance(vocab_size, Column) else F.lit(vocab_size)
    per_doc = pair_parts.score(pairs, counts, vocab, key).groupBy(key).agg(F.sum("nll").alias("nll"), F.sum("n").alias("n"))
    return per_doc.withColumn("loss", F.try_divide("nll", "n"))


def adjacent_pairs(df: DataFrame, key: str, tokens: str = "tokens") -> DataFrame:
    """The packed pairs of :func:`row_pairs` for the adjacent tokens of each row."""
    return pair_parts.pack(df.select(key, F.col(tokens).alias("tokens")), key)


def doc_cross_entropy(
    df: DataFrame, counts: DataFrame, vocab_size: int | Column, key: str = "doc_id", tokens: str = "tokens",
) -> DataFrame:
    """``(key, nll, n, loss)`` of each row's adjacent tokens; with fewer than two, ``n`` is 0 and there is no loss.

    ``df`` holds the rows or their :func:`adjacent_pairs`.
    """
    return cross_entropy(df if "body" in df.columns else adjacent_pairs(df, key, tokens), counts, vocab_size, key)


def evaluate(
    train: DataFrame, validation: DataFrame, vocab_size: int | Column, batch_size: int = BATCH_SIZE,
    key: str = "doc_id", tokens: str = "tokens",
) -> DataFrame:
    """One row: macro loss (mean of batch means), micro loss (all pairs alike), perplexity."""
    scored = doc_cross_entropy(validation, bigrams(adjacent_pairs(train, key, tokens), packed=True), vocab_size, key, tokens)
    return report(scored, batch_size, key)


def evaluate_fixed(
    train: DataFrame, validation: DataFrame, vocab_size: int | Column, include_pad: bool = True,
    batch_size: int = BATCH_SIZE, key: str = "doc_id",
) -> DataFrame:
    """The report of :func:`evaluate` for rows of fixed length ``(key, input_ids, targets, n_tokens)``.

    With ``include_pad`` the filling counts in the statistics and in the loss, which lowers it;
    without, only the targets of real tokens do, the first filling among them.
    """
    places = padded("input_ids", "targets", "n_tokens", include_pad)
    counts = counted(row_pairs(train, key, *places, packed=True), packed=True)
    return report(cross_entropy(row_pairs(validation, key, *places, packed=True), counts, vocab_size, key), batch_size, key)


def report(scored: DataFrame, batch_size: int, key: str) -> DataFrame:
    """Macro loss, micro loss and perplexity of scored rows, in batches in the order of ``key``."""
    numbered = batches(range_rank(scored.select(key, "nll", "n"), [key]), batch_size)
    per_batch = numbered.groupBy("batch_id").agg(F.sum("nll").alias("nll"), F.sum("n").alias("n"))
    return per_batch.agg(
        F.avg(F.try_divide("nll", "n")).alias("macro_loss"),
        F.try_divide(F.sum("nll"), F.sum("n")).alias("micro_loss"),
        F.exp(F.avg(F.try_divide("nll", "n"))).alias("perplexity"),
        F.sum("n").alias("n_pairs"),
    )


def next_candidates(counts: DataFrame, k: int = TOP_K, temperature: float = TEMPERATURE) -> DataFrame:
    """``(ctx, nxt, c, p)``: the k most frequent next tokens (ties kept) and their probability."""
    top = top_k_ties(counts.withColumn("logit", F.log("c")), k, "ctx", "logit")
    return softmax(materialize(top, "top"), temperature, "ctx", "logit", "p").drop("logit")


def draw_cells(candidates: DataFrame) -> DataFrame:
    """``(ctx, cell, shift, nxt, lo, hi)``: the part of the drawing grid that belongs to a candidate.

    Probabilities become whole weights, so running sums are exact and leave no gaps. Each
    interval is repeated per cell it touches: a draw then meets its candidate by equality of
    context and cell. ``shift`` is the number of bits in a cell; most contexts have few
    candidates and a single cell.

    A weight is at least 1, so an interval is empty only if a context's weights pass the grid,
    which takes more than three billion candidates; such an interval cannot be drawn.
    """
    parts = _cell_parts(candidates, several_cells(candidates).df)
    return reduce(DataFrame.unionByName, parts).select("ctx", "cell", "shift", "nxt", "lo", "hi")


def several_cells(candidates: DataFrame) -> WrittenTable:
    """``(ctx, shift)`` of the contexts with more than ``PER_CELL`` candidates; the grid of all others is one cell."""
    sizes = candidates.groupBy("ctx").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > PER_CELL)
    return write_table(sizes.select("ctx", (F.lit(GRID_BITS) - F.ceil(F.log2(F.col("n") / PER_CELL))).cast("int").alias("shift")), "several")


def _cell_parts(candidates: DataFrame, several: DataFrame) -> list[DataFrame]:
    """The rows of :func:`draw_cells`, with ``c``: of contexts with a single cell, in tasks of whole contexts, and of the others.

    Running sums of the others run inside hash groups of a context's candidates, shifted by the
    groups in front, so a context with very many candidates is split.
    """
    weighted = candidates.select(
        "ctx",
        "nxt",
        "c",
        F.substring(F.md5(F.col("nxt").cast("string")), 1, 2).alias("part"),
        F.greatest(F.lit(1), F.round(F.col("p") * F.lit(float(1 << WEIGHT_BITS))).cast("bigint")).alias("w"),
    )
    context = Window.partitionBy("ctx")
    up_to = Window.unboundedPreceding, 0
    one = weighted.join(several, weighted["ctx"].eqNullSafe(several["ctx"]), "left_anti")
    one = one.withColumn("end", F.sum("w").over(context.orderBy("part", "nxt").rowsBetween(*up_to)))
    one = one.withColumn("total", F.sum("w").over(context)).withColumn("shift", F.lit(GRID_BITS))
    one = _bounds(one).withColumn("cell", F.lit(0).cast("bigint"))

    wide = weighted.join(several, "ctx")
    parts = wide.groupBy("ctx", "part").agg(F.sum("w").alias("_w"))
    earlier = context.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "ctx",
        "part",
        F.coalesce(F.sum("_w").over(earlier), F.lit(0)).alias("before"),
        F.sum("_w").over(context).alias("total"),
    )
    in_part = F.sum("w").over(Window.partitionBy("ctx", "part").orderBy("nxt").rowsBetween(*up_to))
    wide = wide.withColumn("_end", in_part).join(parts, ["ctx", "part"]).withColumn("end", F.col("before") + F.col("_end"))
    cells = F.expr("sequence(shiftright(lo, shift), shiftright(hi - 1, shift))")
    return [one, _bounds(wide).withColumn("cell", F.explode(cells))]


def _bounds(ends: DataFrame) -> DataFrame:
    """``(ctx, nxt, c, shift, lo, hi)``: running sums scaled to the grid in whole numbers, without empty intervals."""
    # The product needs more than 64 bits only for totals from 2 ** (63 - GRID_BITS).
    scaled = (f"case when total < {1 << 63 - GRID_BITS} then shiftleft({{0}}, {GRID_BITS}) div total "
              f"else cast(({{0}}) as decimal(20,0)) * {1 << GRID_BITS} div total end")
    bounds = ends.select("ctx", "nxt", "c", "shift", F.expr(scaled.format("end - w")).alias("lo"), F.expr(scaled.format("end")).alias("hi"))
    return bounds.where((F.col("hi") > F.col("lo")) & F.col("nxt").isNotNull())


class Walker:
    """Draws from the candidates of some places, a place being a cell of a context's grid."""

    def __init__(self, places: dict, shifts: dict, seed: int):
        """``places``: by context and cell, the upper bounds and tokens of the place's candidates in order; ``shifts``: by context."""
        self.places, self.shifts, self.seed = places, shifts, seed

    def walk(self, state: dict, steps: int, at: tuple[list, list] | None = None) -> dict:
        """Go on from ``state`` until all steps are done or the place is not known here.

        ``at`` holds the candidates of the place the state stands at.
        """
        step, token, generated = state["step"], state["ctx"], list(state["generated"])
        name = [] if state["name"] is None else [state["name"]]
        while step < steps:
            place = at
            if place is None and token not in self.shifts:
                break
            draw = int(hashlib.md5(":".join([str(self.seed), str(step), *name]).encode()).hexdigest()[:8], 16)
            place = place or self.places.get((token, draw >> self.shifts[token]))
            if place is None:
                break
            at = None
            token = place[1][bisect.bisect_right(place[0], draw)]
            generated.append(token)
            step += 1
        return {**state, "step": step, "ctx": token, "generated": generated}


def continue_batch(
    prompts: DataFrame,
    candidates: DataFrame,
    steps: int = MAX_NEW_TOKENS,
    seed: int = SEED,
    n: int = BLOCK_SIZE,
    key: str = "conv_id",
    tokens: str = "tokens",
) -> DataFrame:
    """Continue every prompt by up to ``steps`` drawn tokens; add ``generated`` and ``context``.

    ``candidates`` is the table of :func:`next_candidates`. A prompt whose last token has no
    candidate stops. The candidates of a place are one row. Walks mostly visit frequent
    contexts, so the rows of the most frequent ones, up to ``HEAD_CANDIDATES`` candidates, travel to
    every task, and a task walks a prompt as long as it stays among them. Only a prompt that
    leaves them moves, to the row of the place it stands at, and walks on from there; if there is
    none, it has ended. The prompts themselves are joined once at the end.
    """
    spark = prompts.sparkSession
    candidates = materialize(candidates, "candidates")
    several = several_cells(candidates)
    entries = F.sort_array(F.collect_list(F.struct("hi", "nxt"))).alias("_entries")
    rows = [part.where("ctx is not null").groupBy("ctx", "cell").agg(entries, F.first("shift").alias("shift"),
                                                                      F.coalesce(F.sum("c"), F.lit(0)).alias("weight"))
            for part in _cell_parts(candidates, several.df)]
    rows = reduce(DataFrame.unionByName, rows)
    places = materialize(rows.select("ctx", "cell", "shift", "weight", F.col("_entries.hi").alias("his"), F.col("_entries.nxt").alias("nxts")),
                         "places")
    head, tail = _head(places)
    # Only plain data is broadcast: it is loaded where this package need not be installed.
    known = spark.sparkContext.broadcast((
        {(row["ctx"], row["cell"]): (row["his"], row["nxts"]) for row in head}, {row["ctx"]: row["shift"] for row in head}))

    kind = candidates.schema["nxt"].dataType
    state = prompts.where(F.size(tokens) > 0).select(
        F.monotonically_increasing_id().alias("walk"), key, F.col(key).cast("string").alias("name"), F.element_at(tokens, -1).alias("ctx"),
        F.lit(0).alias("step"), F.slice(tokens, 1, 0).alias("generated"))
    schema = T.StructType([
        T.StructField("walk", T.LongType()), T.StructField(key, prompts.schema[key].dataType), T.StructField("name", T.StringType()),
        T.StructField("ctx", kind), T.StructField("step", T.IntegerType()), T.StructField("generated", T.ArrayType(kind))])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker = Walker(*known.value, seed)
        for batch in batches:
            walked = []
            for row in batch.to_pylist():
                at = (row.pop("his"), row.pop("nxts")) if "his" in row else None
                walked.append(walker.walk(row, steps, at))
            yield pa.RecordBatch.from_pylist(walked, to_arrow_schema(schema))

    moving = materialize(state.mapInArrow(walk, schema), "walked")
    walked = [moving]
    shifts = F.broadcast(several.df) if fits_broadcast(several) else several.df
    draw = F.conv(F.substring(hash_key(seed, F.col("step"), F.col("name")), 1, 8), 16, 10).cast("bigint")
    while tail is not None:
        left = moving.where(F.col("step") < steps).join(shifts, "ctx", "left").withColumn("draw", draw)
        left = left.withColumn("cell", F.expr(f"shiftright(draw, coalesce(shift, {GRID_BITS}))")).select(*schema.names, "cell")
        standing = left.join(tail, ["ctx", "cell"]).select(*schema.names, "his", "nxts")
        moving = materialize(standing.mapInArrow(walk, schema), "walked")
        if moving.isEmpty():
            break
        walked.append(moving)
    # A prompt's last row has the most steps.
    done = reduce(DataFrame.unionByName, walked).groupBy("walk").agg(F.max_by(F.struct(key, "generated"), "step").alias("last")).select("last.*")
    result = prompts.join(done, key, "left").withColumn("generated", F.coalesce("generated", F.slice(tokens, 1, 0)))
    return result.withColumn("context", crop_last(F.concat(F.col(tokens), F.col("generated")), n))


def _head(places: DataFrame) -> tuple[list[dict], DataFrame | None]:
    """Rows of the most frequent places with at most ``HEAD_CANDIDATES`` candidates in all; the table of the other places, if any."""
    sizes = places.select("weight", F.size("his").alias("size")).orderBy(F.desc("weight")).limit(HEAD_PLACES + 1).collect()
    room, border = HEAD_CANDIDATES, None
    for place, row in enumerate(sizes):
        room -= row["size"]
        if room < 0 or place == HEAD_PLACES:
            border = row.weight
            break
    # Places as frequent as the first one without room stay behind with it.
    chosen = places if border is None else places.where(F.col("weight") > border)
    tail = None if border is None else places.where(F.col("weight") <= border).select("ctx", "cell", "his", "nxts")
    return chosen.select("ctx", "cell", "shift", "his", "nxts").toArrow().to_pylist(), tail
