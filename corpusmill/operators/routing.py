"""Top-k routing of vectors to experts, gate weights, combination and load.

The expert table is small (one vector per expert) and travels as a literal; all scoring and
ranking happens inside the row, without joins, shuffles or a row per vector and expert.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.constants import EXPERTS_PER_ROW, SEED
from corpusmill.functions.hashing import hash_key, normal
from corpusmill.session import materialize

# Largest number of expert vector entries carried as one literal; more experts are scored
# in several passes over blocks of them.
LITERAL_ENTRIES = 1 << 18
# Bytes of expert vectors that travel to every task in one round of block routing, and experts of a block.
EXPERT_BYTES = 64 << 20
BLOCK_EXPERTS = 2048
# Rows scored together, which bounds a task's memory however long its batches are.
BLOCK_ROWS = 1024
ROUTE = T.StructType([T.StructField("expert_id", T.LongType()), T.StructField("logit", T.DoubleType())])
# Labels whose sums a task holds, and groups in which the tasks' sums are merged first.
LABELS_HELD = 4096
MERGE_GROUPS = 64
# Logits are compared after rounding, so float noise cannot break a tie.
RANK_DIGITS = 9


def centroids(df: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """``(expert_id, weights)``: element-wise mean vector per label; null entries do not count.

    A task adds its vectors up in dense sums, one per label; the sums of the tasks are merged in
    groups first and then by label, so a label in every task costs no task more than a few sums.
    """
    rows = df.select(F.col(label).alias("expert_id"), F.col(vector).cast("array<double>").alias("vector"))
    kind = rows.schema["expert_id"].dataType
    sums = T.StructType([
        T.StructField("expert_id", kind), T.StructField("sums", T.ArrayType(T.DoubleType())), T.StructField("counts", T.ArrayType(T.LongType()))])
    means = T.StructType([T.StructField("expert_id", kind), T.StructField("weights", T.ArrayType(T.DoubleType()))])

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[object, list[np.ndarray]] = {}
        for batch in batches:
            for name, total, count in _sums_by_label(batch.column(0), batch.column(1)):
                held[name] = _added(held[name], [total, count]) if name in held else [total, count]
            if len(held) > LABELS_HELD:
                yield _sum_rows(held, sums)
                held = {}
        if held:
            yield _sum_rows(held, sums)

    def merge(table: pa.Table) -> pa.Table:
        parts = [[np.array(row["sums"]), np.array(row["counts"])] for row in table.to_pylist()]
        return pa.Table.from_batches([_sum_rows({table.column("expert_id")[0].as_py(): reduce(_added, parts)}, sums)])

    def mean(table: pa.Table) -> pa.Table:
        total, count = (merge(table).column(i)[0].as_py() for i in (1, 2))
        found = [t / c if c else None for t, c in zip(total, count)]
        return pa.table([table.column("expert_id").slice(0, 1), pa.array([found], pa.list_(pa.float64()))], names=means.names)

    parts = rows.where(F.col("vector").isNotNull()).mapInArrow(add_up, sums)
    # Contract of the id: partition number above bit 33.
    grouped = parts.withColumn("_group", F.shiftright(F.monotonically_increasing_id(), 33) % MERGE_GROUPS)
    merged = grouped.groupBy("expert_id", "_group").applyInArrow(lambda table: merge(table.drop_columns("_group")), sums)
    return merged.groupBy("expert_id").applyInArrow(mean, means)


def _sums_by_label(labels: pa.Array, vectors: pa.Array) -> Iterator[tuple[object, np.ndarray, np.ndarray]]:
    """Per label the sums of the vectors' entries and how many entries there were."""
    coded = labels.dictionary_encode(null_encoding="encode")
    code = coded.indices.to_numpy(zero_copy_only=False)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False)
    width = int(sizes.max(initial=0))
    flat = vectors.flatten()
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    slot = np.repeat(code, sizes) * width + place
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    values, slot = flat.fill_null(0.0).to_numpy()[known], slot[known]
    names = coded.dictionary.to_pylist()
    total = np.bincount(slot, values, len(names) * width).reshape(len(names), width)
    count = np.bincount(slot, minlength=len(names) * width).reshape(len(names), width)
    widths = np.zeros(len(names), np.int64)
    np.maximum.at(widths, code, sizes)
    yield from ((name, t[:w], c[:w]) for name, t, c, w in zip(names, total, count, widths))


def _added(a: Sequence[np.ndarray], b: Sequence[np.ndarray]) -> list[np.ndarray]:
    width = max(len(a[0]), len(b[0]))
    return [np.pad(x, (0, width - len(x))) + np.pad(y, (0, width - len(y))) for x, y in zip(a, b)]


def _sum_rows(held: dict[object, Sequence[np.ndarray]], schema: T.StructType) -> pa.RecordBatch:
    columns = [list(held), [v[0] for v in held.values()], [v[1] for v in held.values()]]
    fields = to_arrow_schema(schema)
    return pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)


@dataclass(frozen=True)
class Experts:
    """A block of expert vectors held by the driver, in the order of their ids."""

    ids: tuple[int, ...]
    weights: tuple[tuple[float, ...], ...]

    def literal(self) -> Column:
        rows = [{"expert_id": i, "weights": list(w)} for i, w in zip(self.ids, self.weights)]
        return F.from_json(F.lit(json.dumps(rows)), "array<struct<expert_id:int,weights:array<double>>>")


def expert_blocks(experts: DataFrame, entries: int = LITERAL_ENTRIES) -> list[Experts]:
    """The expert table in blocks of bounded size, each fetched on its own; a null id is no expert."""
    experts = experts.where(F.col("expert_id").isNotNull())
    size = experts.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("weights")).alias("dim")).first()
    per_block = max(1, entries // max(1, size.dim or 1))
    blocks, last = [], None
    for _ in range(0, size.n, per_block):
        rest = experts if last is None else experts.where(F.col("expert_id") > last)
        rows = rest.orderBy("expert_id").limit(per_block).collect()
        blocks.append(Experts(tuple(r.expert_id for r in rows), tuple(tuple(r.weights) for r in rows)))
        last = rows[-1].expert_id
    return blocks


def _dot(x: Column, w: Column) -> Column:
    return F.aggregate(F.zip_with(x, w, lambda a, b: a * b), F.lit(0.0), lambda acc, v: acc + v)


def gate_logits(block: Experts, vector="embedding") -> Column:
    """``ARRAY<STRUCT<expert_id, logit>>``: dot product of the row's vector with every expert."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.transform(
        block.literal(),
        lambda e: F.struct(e["expert_id"].alias("expert_id"), _dot(vector, e["weights"]).alias("logit")),
    )


def softplus(x: Column) -> Column:
    """``ln(1 + exp(x))`` without overflow."""
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def all_logits(blocks: list[Experts], vector="embedding") -> Column:
    """Logits of every expert of every block, in one array."""
    return F.concat(*[gate_logits(block, vector) for block in blocks])


def add_noise(logits, noise_logits, row_id, seed: int = SEED) -> Column:
    """Logits plus a standard normal times the softplus of the noise logit, seeded by row and expert."""
    logits = F.col(logits) if isinstance(logits, str) else logits
    noise_logits = F.col(noise_logits) if isinstance(noise_logits, str) else noise_logits
    row_id = F.col(row_id) if isinstance(row_id, str) else row_id

    def noisy(gate: Column, noise: Column) -> Column:
        draw = normal(hash_key(seed, row_id, gate["expert_id"]))
        logit = gate["logit"] + draw * softplus(noise["logit"])
        return F.struct(gate["expert_id"].alias("expert_id"), logit.alias("logit"))

    return F.zip_with(logits, noise_logits, noisy)


def best_experts(logits, k: int = EXPERTS_PER_ROW) -> Column:
    """The ``k`` experts with the largest logits; the lower id wins a tie."""
    logits = F.col(logits) if isinstance(logits, str) else logits
    keyed = F.transform(
        logits,
        lambda g: F.struct(
            (-F.round(g["logit"], RANK_DIGITS)).alias("rank"), g["expert_id"].alias("expert_id"), g["logit"].alias("logit")
        ),
    )
    kept = F.slice(F.array_sort(keyed), 1, k)
    return F.transform(kept, lambda g: F.struct(g["expert_id"].alias("expert_id"), g["logit"].alias("logit")))


def route_top_k(
    df: DataFrame, blocks: list[Experts], k: int = EXPERTS_PER_ROW, vector: str = "embedding", out: str = "routes"
) -> DataFrame:
    """Add exactly ``k`` routes per row, best first. Further expert blocks only update them."""
    routes = F.array().cast("array<struct<expert_id:int,logit:double>>")
    for block in blocks:
        df = df.withColumn(out, best_experts(F.concat(routes, gate_logits(block, vector)), k))
        routes = F.col(out)
    return df


def block_routes(
    df: DataFrame, experts: DataFrame, k: int = EXPERTS_PER_ROW, vector: str = "embedding", out: str = "routes",
    round_bytes: int = EXPERT_BYTES,
) -> DataFrame:
    """Add exactly ``k`` routes per row, best first, for any number of experts.

    The experts are taken in order of falling length, as many in a round as fit ``round_bytes``. A
    task multiplies blocks of vectors with blocks of experts; a row is left out once its
    k-th route is better than its length times that of the longest expert to come. A row whose
    vector is null, holds nulls or has another dimension than the experts has no routes.
    """
    spark = df.sparkSession
    length = F.sqrt(F.aggregate("weights", F.lit(0.0), lambda total, x: total + x * x))
    experts = materialize(experts.where(F.col("expert_id").isNotNull()).select(
        F.col("expert_id").cast("bigint").alias("expert_id"), F.col("weights").cast("array<double>").alias("weights"), length.alias("length")), "experts")
    size = experts.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("weights")).alias("dim")).first()
    per_round = max(1, round_bytes // (8 * max(1, size.dim or 1)))
    schema = T.StructType([*df.schema.fields, T.StructField(out, T.ArrayType(ROUTE))])
    df, last = df.withColumn(out, F.array().cast(T.ArrayType(ROUTE))), None
    for start in range(0, size.n, per_round):
        rest = experts
        if last is not None:
            rest = rest.where((F.col("length") < last.length) | ((F.col("length") == last.length) & (F.col("expert_id") > last.expert_id)))
        rows = rest.orderBy(F.desc("length"), "expert_id").limit(per_round).collect()
        last = rows[-1]
        blocks = spark.sparkContext.broadcast([
            (np.array([r.expert_id for r in part]), np.array([r.weights for r in part]), part[0].length)
            for part in (rows[i : i + BLOCK_EXPERTS] for i in range(0, len(rows), BLOCK_EXPERTS))])
        df = df.mapInArrow(_block_scorer(blocks, k, size.dim, vector, out), schema)
        if start + per_round < size.n:
            df = materialize(df, "routed")
    return df


def _block_scorer(blocks, k: int, dim: int, vector: str, out: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(start, BLOCK_ROWS) for b in batches for start in range(0, max(1, b.num_rows), BLOCK_ROWS)):
            names, fields = batch.schema.names, batch.schema
            vectors, routes = batch.column(names.index(vector)), batch.column(names.index(out)).to_pylist()
            usable = [i for i, v in enumerate(vectors.to_pylist()) if v is not None and len(v) == dim and None not in v]
            x = np.array([vectors[i].as_py() for i in usable], np.float64).reshape(len(usable), dim or 0)
            found = best_of_blocks(x, blocks.value, k, [[(r["expert_id"], r["logit"]) for r in routes[i]] for i in usable])
            for i, best in zip(usable, found):
                routes[i] = [{"expert_id": int(e), "logit": float(v)} for e, v in best]
            at = names.index(out)
            columns = [*batch.columns[:at], pa.array(routes, fields.field(at).type), *batch.columns[at + 1 :]]
            yield pa.RecordBatch.from_arrays(columns, schema=fields)

    return score


def best_of_blocks(
    x: np.ndarray, blocks: Sequence[tuple[np.ndarray, np.ndarray, float]], k: int, known: Sequence[Sequence[tuple[int, float]]]
) -> list[list[tuple[int, float]]]:
    """The ``k`` best ``(expert, logit)`` of every row of ``x``, among the ``known`` ones and the blocks' experts."""
    best = [sorted(routes, key=_route_rank)[:k] for routes in known]
    lengths = np.sqrt((x * x).sum(axis=1))
    least = np.array([round(routes[-1][1], RANK_DIGITS) if len(routes) == k else -np.inf for routes in best])
    for ids, weights, longest in blocks:
        # A little more than the product bounds every logit to come, whatever the rounding.
        rows = np.flatnonzero(lengths * longest * (1 + 1e-9) + 1e-8 >= least)
        if not len(rows):
            break
        logits = x[rows] @ weights.T
        for row, values in zip(rows, logits):
            chosen = np.flatnonzero(np.round(values, RANK_DIGITS) >= least[row])
            if len(chosen) > 4 * k:
                border = np.partition(np.round(values[chosen], RANK_DIGITS), len(chosen) - k)[len(chosen) - k]
                chosen = chosen[np.round(values[chosen], RANK_DIGITS) >= border]
            best[row] = sorted([*best[row], *zip(ids[chosen], values[chosen])], key=_route_rank)[:k]
            if len(best[row]) == k:
                least[row] = round(best[row][-1][1], RANK_DIGITS)
    return best


def _route_rank(route: tuple[int, float]) -> tuple[float, int]:
    return -round(route[1], RANK_DIGITS), route[0]


def gate_weights(routes="routes") -> Column:
    """Softmax over the kept routes only: ``ARRAY<STRUCT<expert_id, logit, gate>>``."""
    routes = F.col(routes) if isinstance(routes, str) else routes
    peak = F.array_max(F.transform(routes, lambda r: r["logit"]))
    powers = F.transform(
        routes,
        lambda r: F.struct(r["expert_id"].alias("expert_id"), r["logit"].alias("logit"), F.exp(r["logit"] - peak).alias("e")),
    )
    total = F.aggregate(powers, F.lit(0.0), lambda acc, r: acc + r["e"])
    return F.transform(
        powers, lambda r: F.struct(r["expert_id"], r["logit"], (r["e"] / total).alias("gate"))
    )


def explode_routes(df: DataFrame, routes: str, *keep: str) -> DataFrame:
    """One row per route. The outer form keeps Spark from adding a filter that would score every row twice."""
    return df.select(*keep, F.inline_outer(routes)).where(F.col("expert_id").isNotNull())


def dispatch(df: DataFrame, row_id: str = "vec_id", gates: str = "gates") -> DataFrame:
    """``(row_id, expert_id, gate)`` of positive gates, laid out by expert.

    A popular expert's rows are spread over as many tasks as the session shuffles to; an
    expert without rows gets none.
    """
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    routed = explode_routes(df, gates, row_id).where(F.col("gate") > 0).select(row_id, "expert_id", "gate")
    salt = F.pmod(F.xxhash64(row_id), F.lit(tasks))
    return routed.repartition(F.col("expert_id"), salt)


def combine(df: DataFrame, blocks: list[Experts], gates: str = "gates", out: str = "combined") -> DataFrame:
    """Add the gate-weighted sum of the chosen experts' vectors, in the row."""
    summed = F.array_repeat(F.lit(0.0), len(blocks[0].weights[0]) if blocks else 0)
    if not blocks:
        return df.withColumn(out, summed)
    for block in blocks:
        df = df.withColumn(out, _add_routed(summed, F.col(gates), block))
        summed = F.col(out)
    return df


def _add_routed(summed: Column, gates: Column, block: Experts) -> Column:
    """Add the block's share: only the row's own routes into the block are visited."""
    weights = F.map_from_entries(block.literal())
    own = F.filter(gates, lambda g: (g["expert_id"] >= block.ids[0]) & (g["expert_id"] <= block.ids[-1]))

    def add(acc: Column, g: Column) -> Column:
        return F.zip_with(acc, weights[g["expert_id"]], lambda a, w: a + g["gate"] * w)

    return F.aggregate(own, summed, add)


def expert_load(df: DataFrame, experts: DataFrame, gates: str = "gates") -> DataFrame:
    """Per expert: routed rows, share of all routes, sum of gates, whether it is unused."""
    routed = explode_routes(df, gates).where(F.col("gate") > 0)
    load = routed.groupBy("expert_id").agg(F.count(F.lit(1)).alias("n"), F.sum("gate").alias("gates"))
    total = load.agg(F.sum("n")).scalar()
    n = F.coalesce("n", F.lit(0))
    return (
        experts.select("expert_id")
        .join(load, "expert_id", "left")
        .select(
            "expert_id",
            n.alias("n_rows"),
            (n / total).alias("share"),
            F.coalesce("gates", F.lit(0.0)).alias("sum_gate"),
            F.col("n").isNull().alias("unused"),
        )
    )
