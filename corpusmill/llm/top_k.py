"""Exact top-k search by inner product over an impact-ordered index, score at a time.

Vectors are cut into blocks. A block's index holds, for every dimension, postings of the
vectors with a component there, in segments by quantised impact, the bit length of the
component's size; the segments lie in descending order of impact. A block of queries processes all
segments of one impact, then those of the next. What the remaining segments can still add to
a vector's score or take away is bounded by the length of the vector's remaining components times
that of the query, and by each dimension's largest remaining component. A query stops as
soon as that proves which few vectors may be among its best; only those are scored exactly. A
query for which nothing can be proved early processes all segments, and its scores are exact.

Each block gives its own best ``k``; the best of those are the answer.

Defined results: vectors that are null, empty or hold null or non-finite components take no part, nor
does a null id; vectors of different length are not compared; a repeated row counts once; rows
with the query's own id are never its answers; ties go to the smaller id; other columns are ignored.
Scores are exact as long as no sum of products exceeds 2 ** 53.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.llm.common import map_batches
from corpusmill.session import materialize

SCALE = 64.0
BLOCK = 8192
QUERIES = 256
# A query is settled when at most this share of a block's vectors, or this many times k, can still be members.
POSSIBLE = 1 / 16
SPARE = 4
WIDTHS = (np.int8, np.int16, np.int32, np.int64)


def quantised(vectors: DataFrame, scale: float = SCALE) -> DataFrame:
    """``(vec_id, dim, data)``, distinct and written: ``floor(scale * x)`` as 64-bit integers."""
    embedding = F.col("embedding").cast("array<double>")
    whole = F.size(embedding) > 0
    finite = ~F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), embedding.alias("v")).where(
        F.col("vec_id").isNotNull() & F.coalesce(whole & finite, F.lit(False)))

    def start():
        def pack(batch):
            data = [np.floor(scale * v.values.to_numpy(zero_copy_only=False)).astype(np.int64) for v in batch.column(1)]
            return batch.column(0), [len(d) for d in data], [d.tobytes() for d in data]

        return pack

    found = map_batches(rows, "vec_id bigint, dim int, data binary", start)
    return materialize(found.dropDuplicates(["vec_id", "data"]), "quantised")


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """``(dim, ids, components)`` of up to ``size`` vectors of one length."""
    held: dict[int, list] = {}
    for batch in batches:
        for vec_id, dim, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            rows = held.setdefault(dim, [])
            rows.append((vec_id, data))
            if len(rows) == size:
                yield dim, *_stacked(held.pop(dim), dim)
    for dim, rows in held.items():
        yield dim, *_stacked(rows, dim)


def _stacked(rows: list, dim: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.array([r[0] for r in rows], np.int64)
    return ids, np.frombuffer(b"".join(r[1] for r in rows), np.int64).reshape(-1, dim)


def impact_of(x: np.ndarray) -> np.ndarray:
    """Quantised impact: bit length of the component's size, 0 for a zero."""
    return np.frexp(np.abs(x).astype(np.float64))[1]


def postings(components: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(segments, starts, rows, values)``: segments ``(impact, dimension)`` by descending impact, and their postings."""
    rows, dims = np.nonzero(components)
    values = components[rows, dims]
    impacts = impact_of(values)
    order = np.lexsort((rows, dims, -impacts))
    rows, dims, values, impacts = rows[order], dims[order], values[order], impacts[order]
    new = np.flatnonzero((np.diff(impacts, prepend=-1) != 0) | (np.diff(dims, prepend=-1) != 0))
    return np.column_stack([impacts[new], dims[new]]), np.append(new, len(rows)), rows, values


def _stored(x: np.ndarray) -> bytes:
    """Integers in the smallest of four widths, which the first byte names."""
    width = next(i for i, kind in enumerate(WIDTHS) if not x.size or (x.min() >= np.iinfo(kind).min and x.max() <= np.iinfo(kind).max))
    return bytes([width]) + np.ascontiguousarray(x, WIDTHS[width]).tobytes()


def _loaded(raw: pa.Scalar) -> np.ndarray:
    data = raw.as_buffer()
    return np.frombuffer(data, WIDTHS[data[0]], offset=1).astype(np.int64)


class BlockIndex:
    """Impact-ordered postings of one block of vectors."""

    def __init__(self, ids: np.ndarray, components: np.ndarray, index: tuple):
        self.ids, self.components = ids, components
        self.segments, self.starts, self.rows, self.values = index
        # Postings processed so far, each query counting.
        self.read = 0

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """``(query number, ids, scores)`` of each query's best ``k`` in this block."""
        n, dim = self.components.shape
        asked = queries.astype(np.float64)
        open_ = np.arange(len(queries))
        totals = np.zeros((n, len(queries)))
        impacts = self.segments[:, 0]
        # Largest component of each segment; what is left of a dimension is bounded by its largest.
        peaks = np.maximum.reduceat(np.abs(self.values), self.starts[:-1]) if len(impacts) else np.empty(0)
        dims = np.repeat(self.segments[:, 1], np.diff(self.starts))
        # Squared length of what is left of each vector.
        rest = (self.components.astype(np.float64) ** 2).sum(axis=1)
        sizes = np.sqrt((asked**2).sum(axis=1))
        for level in sorted(set(impacts.tolist()), reverse=True) or [0]:
            first, end = (self.starts[np.searchsorted(-impacts, -level, side)] for side in ("left", "right"))
            # All segments of one impact at once: their postings as a matrix, summed over dimensions.
            segment = np.zeros((n, dim))
            segment[self.rows[first:end], dims[first:end]] = self.values[first:end]
            totals += segment @ asked[open_].T
            self.read += int(end - first) * len(open_)
            rest -= np.bincount(self.rows[first:end], self.values[first:end].astype(np.float64) ** 2, n)
            lower = impacts < level
            last = not lower.any()
            left = np.zeros(dim)
            np.maximum.at(left, self.segments[lower, 1], peaks[lower])
            # The lengths' product is taken a little too large, whatever the rounding.
            lengths = np.sqrt(np.maximum(rest, 0.0))[:, None] * sizes[None, open_] * (1 + 1e-9) + 1e-6
            slack = 0.0 if last else np.minimum(lengths, (np.abs(asked[open_]) @ left)[None, :])
            own = self.ids[:, None] == query_ids[None, open_]
            least = np.where(own, -np.inf, totals - slack)
            kth = np.partition(least, n - k, axis=0)[n - k] if n > k else np.full(len(open_), -np.inf)
            possible = (totals + slack >= kth) & ~own
            done = np.ones(len(open_), bool) if last else possible.sum(axis=0) <= max(SPARE * k, n * POSSIBLE)
            for i in np.flatnonzero(done):
                members = np.flatnonzero(possible[:, i])
                scores = self.components[members] @ queries[open_[i]]
                best = np.lexsort((self.ids[members], -scores))[:k]
                yield int(open_[i]), self.ids[members[best]], scores[best]
            open_, totals = open_[~done], totals[:, ~done]
            if not len(open_):
                return


def build_index(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """``(dim, ids, components, segments, starts, rows, values)``, one row per block, written."""
    names = ["ids", "components", "segments", "starts", "rows", "values"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, components in _blocks(batches, size):
            columns = [pa.array([_stored(x)], pa.binary()) for x in (ids, components, *postings(components))]
            yield pa.record_batch([pa.array([dim], pa.int32()), *columns], names=["dim", *names])

    schema = "dim int, " + ", ".join(f"{n} binary" for n in names)
    return materialize(rows.mapInArrow(run, schema).withColumn("block", F.monotonically_increasing_id()), "index")


def search(index: DataFrame, queries: DataFrame, k: int, size: int = QUERIES) -> DataFrame:
    """``(query_id, query_key, vec_id, score)``: each query's best ``k`` of each block of the index.

    ``queries (vec_id, dim, data)``. Every block of queries meets every block of the index:
    the queries are repeated once per slot of blocks.
    """
    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for dim, ids, components in _blocks(batches, size):
            yield pa.record_batch([pa.array([dim], pa.int32()), pa.array([_stored(ids)], pa.binary()),
                                   pa.array([_stored(components)], pa.binary())], names=["dim", "query_ids", "queries"])

    slots = max(1, index.count())
    slot: Column = F.pmod(F.xxhash64("block"), F.lit(slots)).alias("slot")
    asked = queries.mapInArrow(group, "dim int, query_ids binary, queries binary")
    asked = materialize(asked, "queries").select("*", F.explode(F.sequence(F.lit(0), F.lit(slots - 1)).cast("array<bigint>")).alias("slot"))
    met = index.select("*", slot).join(asked, ["dim", "slot"])
    met = met.select("dim", "ids", "components", "segments", "starts", "rows", "values", "query_ids", "queries")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                dim = batch.column(0)[i].as_py()
                ids, components, segments, starts, rows, values, query_ids, asked = (
                    _loaded(batch.column(c)[i]) for c in range(1, 9))
                index = BlockIndex(ids, components.reshape(-1, dim), (segments.reshape(-1, 2), starts, rows, values))
                found = list(index.search(query_ids, asked.reshape(-1, dim), k))
                if found:
                    lengths = [len(f[1]) for f in found]
                    numbers = np.repeat([f[0] for f in found], lengths)
                    keys = [xxhash.xxh3_64_intdigest(asked.reshape(-1, dim)[f[0]].tobytes()) - (1 << 63) for f in found]
                    yield pa.record_batch([
                        pa.array(query_ids[numbers]), pa.array(np.repeat(np.array(keys, np.int64), lengths)),
                        pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found])),
                    ], names=["query_id", "query_key", "vec_id", "score"])

    return met.mapInArrow(run, "query_id bigint, query_key bigint, vec_id bigint, score bigint")


def top_k(vectors: DataFrame, is_query: Column, k: int = 20, scale: float = SCALE) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the rows of ``vectors (vec_id, embedding)`` that ``is_query`` picks."""
    rows = quantised(vectors, scale)
    found = search(build_index(rows), rows.where(is_query), k)
    # The same vector under one id is one query, so equal rows of the answer differ in the vector asked with.
    best = Window.partitionBy("query_id", "query_key").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
