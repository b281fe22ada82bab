"""Pairs of tokens in parts: counted and scored without a row per pair.

A part holds up to ``PART_PAIRS`` pairs of a task as numbers into its list of distinct tokens. What
parts have to tell each other travels by bucket, a hash of a pair: one compressed message per part
and bucket, with the part's distinct pairs of the bucket and their tokens. Tokens are compared
themselves, hashes only choose the bucket.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.session import materialize, materialize_alone, release_shuffles

# Pairs and bytes of tokens that a task works on at once.
PART_PAIRS = 1 << 20
PART_BYTES = 64 << 20
# Inputs by targets: a token goes into few buckets, however many pairs it has. A task holds the
# distinct counted pairs of one bucket.
GRID = 16
BUCKETS = GRID * GRID
# Entries of messages that are put together at once, and rows that leave a task together.
HELD_PAIRS = 1 << 20
OUT_ROWS = 1 << 16
HOME = -1


def pack(rows: DataFrame, key: str) -> DataFrame:
    """``(keys, token, body)``, one row per part, of the pairs of ``rows``.

    ``rows`` are ``(key, tokens)``, for the adjacent tokens of a row, ``(key, inputs, targets)``, arrays of equal
    length, or ``(key, ctx, nxt, m)``. A row may be cut, its key then stands in several parts.
    ``token`` is null and only tells the type of the tokens.
    """
    kind, flat = _kind(rows)
    schema = T.StructType([
        T.StructField("keys", T.ArrayType(rows.schema[key].dataType)), T.StructField("token", kind), T.StructField("body", T.BinaryType())])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, coded in _parts(batches):
            columns = [pa.ListArray.from_arrays([0, len(keys)], keys), pa.nulls(1, flat), pa.array([coded.body()], pa.binary())]
            yield pa.record_batch(columns, names=schema.names)

    return rows.mapInArrow(packed, schema)


def written(parts: DataFrame) -> DataFrame:
    """The result of :func:`pack`, written, with the number ``part`` of each part."""
    return materialize(parts.withColumn("part", F.monotonically_increasing_id()), "parts")


def count_pairs(rows: DataFrame) -> DataFrame:
    """``(ctx, nxt, c)``: how often each pair occurs, from the rows :func:`pack` takes; a null is a token like others."""
    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, coded in _parts(batches):
            yield from Part(coded, nulls=True).messages(0, 0, counts=True, contexts=False)

    return _added(rows.mapInArrow(messages, _MESSAGE), *_kind(rows))


def count_packed(parts: DataFrame, nulls: bool, packed: bool) -> DataFrame:
    """``(ctx, nxt, c)`` from the result of :func:`pack`, with the pairs that hold a null or without.

    With ``packed`` a bucket's counts, and those of its contexts, are one row with a ``body``, for :func:`score`.
    """
    kind, flat = _kind(parts)

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                yield from Part(Coded.of(body.as_py(), flat), nulls).messages(0, 0, counts=True, contexts=packed)

    return _added(parts.select("body").mapInArrow(messages, _MESSAGE), kind, flat, packed)


def explode_tokens(parts: DataFrame, name: str) -> DataFrame:
    """The tokens of the rows in the result of :func:`pack`, one row each."""
    kind, flat = _kind(parts)

    def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                coded = Coded.of(body.as_py(), flat)
                for start in range(0, len(coded.ids), OUT_ROWS):
                    yield pa.record_batch([coded.words.take(pa.array(coded.ids[start : start + OUT_ROWS]))], names=[name])

    return parts.select("body").mapInArrow(tokens, T.StructType([T.StructField(name, kind)]))


def score(parts: DataFrame, counts: DataFrame, vocab_size: Column, key: str) -> DataFrame:
    """``(key, nll, n)`` of the rows in the result of :func:`pack`, with add-one smoothing by ``counts (ctx, nxt, c)``.

    The counts may be packed, see :func:`count_packed`.
    Pairs with a null are left out. Every part asks for the counts of its distinct pairs and contexts, by bucket, and the answers
    come back to the part. A key has one row per part it stands in. The counts and the answers are
    written, so what is moved for one step is gone before the next one.
    """
    spark = parts.sparkSession
    _, flat = _kind(parts)
    home = parts if "part" in parts.columns else written(parts)

    def answered() -> DataFrame:
        if "body" in counts.columns:
            known = materialize(counts, "known")
        else:
            rows = counts.select(F.lit(None).cast("int").alias("key"), "ctx", "nxt", F.col("c").alias("m"))
            known = _told(materialize(pack(rows, "key"), "known"), flat, 0)
        release_shuffles(spark)
        return _answered(home, known, flat)

    answers = materialize_alone(spark, answered, "answers")
    release_shuffles(spark)
    kept = home.select("part", F.lit(HOME).alias("bucket"), "keys", "body", vocab_size.cast("double").alias("vocab"))
    nothing = [F.lit(None).cast(kept.schema[name].dataType).alias(name) for name in ("keys", "vocab")]
    both = kept.unionByName(answers.select("part", "bucket", "body", *nothing))
    schema = T.StructType([
        T.StructField(key, home.schema["keys"].dataType.elementType), T.StructField("nll", T.DoubleType()), T.StructField("n", T.LongType())])

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, messages in _groups(batches, "part"):
            asked = next(messages)
            part, vocab = Part(Coded.of(asked["body"].as_py(), flat), places=True), asked["vocab"].as_py()
            found = [_unpacked(message["body"].as_py()) for message in messages]
            c, total = (np.concatenate([np.zeros(0), *column]) for column in (zip(*found) if found else ((), ())))
            # As in SQL, the logarithm of nothing is left out.
            whole = total + vocab
            loss = np.log(whole, out=np.zeros(len(whole)), where=whole > 0)[part.context] - np.log(c + 1)
            keys = asked["keys"].values
            nll = np.bincount(part.row, loss[part.place] * part.weight, len(keys)).astype(float)
            n = np.bincount(part.row, part.weight, len(keys)).astype(np.int64)
            columns = [keys, pa.array(nll), pa.array(n)]
            yield from pa.Table.from_arrays(columns, schema.names).to_batches(OUT_ROWS)

    return _in_groups(both, "part").mapInArrow(put_back, schema)


class Coded:
    """The tokens of a part as numbers into the list of its distinct tokens.

    ``targets`` is empty if they are the next tokens of the rows, ``weight`` if every pair counts once.
    """

    def __init__(self, words: pa.Array, sizes: np.ndarray, ids: np.ndarray, targets: np.ndarray, weight: np.ndarray):
        self.words, self.sizes, self.ids, self.targets, self.weight = words, sizes, ids, targets, weight

    @staticmethod
    def of(body: bytes, kind: pa.DataType) -> Coded:
        *plain, sizes, ids, targets, weight = _unpacked(body)
        return Coded(_words(plain, kind), sizes, ids, targets ^ _next(ids)[: len(targets)], weight)

    def body(self) -> bytes:
        # Most targets are the next input.
        return _packed(*_plain(self.words), self.sizes, self.ids, self.targets ^ _next(self.ids)[: len(self.targets)], self.weight)

    def pairs(self, nulls: bool) -> tuple[np.ndarray | slice, np.ndarray, np.ndarray]:
        """Which places have a pair; input and target of every pair."""
        left, right, known = self.ids, self.targets, slice(None)
        if not len(right):
            right, known = _next(left), np.ones(len(left), bool)
            known[np.cumsum(self.sizes)[self.sizes > 0] - 1] = False
        if not nulls and self.words.null_count:
            full = self.words.is_valid().to_numpy(zero_copy_only=False)
            full = full[left] & full[right]
            known = full if isinstance(known, slice) else known & full
        return known, left[known], right[known]


class Part:
    """The distinct pairs of a part in the order of bucket, input and target; its contexts in the order of bucket.

    ``places`` says that it must be known as well where each pair of the part stands in that order.
    """

    def __init__(self, coded: Coded, nulls: bool = False, places: bool = False):
        known, left, right = coded.pairs(nulls)
        self.words, d, hashes = coded.words, max(1, len(coded.words)), _hashes(coded.words)
        codes, place, self.c, weight = left * d + right, None, None, coded.weight[known] if len(coded.weight) else None
        if places or weight is not None:
            found = pa.array(codes, pa.int64()).dictionary_encode()
            codes, place = found.dictionary.to_numpy(zero_copy_only=False), found.indices.to_numpy(zero_copy_only=False)
        else:
            codes = np.sort(codes)
            starts = _starts(codes)
            self.c, codes = np.diff(np.append(starts, len(codes))), codes[starts]
        left, right = codes // d, codes % d
        bucket = _buckets(hashes[left], hashes[right])
        # One number sorts like bucket, input and target; it is below buckets * tokens ** 2.
        order = np.argsort(bucket * (d * d) + codes)
        self.left, self.right, self.bucket = left[order], right[order], bucket[order]
        if self.c is not None:
            self.c = self.c[order]
        else:
            place = _ranks(order)[place]
            self.c = _sums(place, np.ones(len(place), np.int64) if weight is None else weight, len(codes))
        if places:
            self.place, self.weight = place, np.ones(len(place), np.int64) if weight is None else weight
            self.row = np.repeat(np.arange(len(coded.sizes)), coded.sizes)[known]
        used = np.zeros(d, bool)
        used[left] = True
        contexts = np.flatnonzero(used)
        bucket = _buckets(hashes[contexts], hashes[contexts])
        order = np.argsort(bucket, kind="stable")
        self.contexts, self.context_bucket = contexts[order], bucket[order]
        # Where the context of each distinct pair stands in that order.
        at = np.zeros(d, np.int64)
        at[self.contexts] = np.arange(len(contexts))
        self.context = at[self.left]

    def messages(self, number: int, step: int, counts: bool, contexts: bool) -> Iterator[pa.RecordBatch]:
        """Rows ``(part, bucket, step, body)``, one per bucket; the counts are those of the part."""
        none = np.zeros(0, np.int64)
        c = self.c if counts else none
        whole = _sums(self.context, c, len(self.contexts)) if counts and contexts else none
        edges = np.arange(BUCKETS + 1)
        pair_ends, context_ends = np.searchsorted(self.bucket, edges), np.searchsorted(self.context_bucket, edges)
        table = np.zeros(max(1, len(self.words)), np.int64)
        buckets, bodies = [], []
        for b in range(BUCKETS):
            pairs, own = slice(pair_ends[b], pair_ends[b + 1]), slice(context_ends[b], context_ends[b + 1]) if contexts else slice(0)
            left, right, alone = self.left[pairs], self.right[pairs], self.contexts[own]
            if len(left) or len(alone):
                used = np.sort(np.concatenate([left, right, alone]))
                used = used[_starts(used)]
                table[used] = np.arange(len(used))
                plain = _plain(self.words.take(pa.array(used)))
                bodies.append(_packed(*plain, _steps(table[left] * len(used) + table[right]), c[pairs], _steps(table[alone]), whole[own]))
                buckets.append(b)
        columns = [[number] * len(buckets), buckets, [step] * len(buckets), bodies]
        yield pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, to_arrow_schema(_MESSAGE))], names=_MESSAGE.names)


class Merged:
    """Messages of one bucket put together: their tokens are numbered anew, all by the same list."""

    def __init__(self, bodies: list[bytes], kind: pa.DataType):
        plain = [_unpacked(body) for body in bodies]
        words = [_words(p[:-4], kind) for p in plain]
        codes, self.c, alone, self.whole = ([p[i] for p in plain] for i in (-4, -3, -2, -1))
        d = [len(w) for w in words]
        codes, alone = [np.cumsum(x) for x in codes], [np.cumsum(x) for x in alone]
        shift = np.cumsum([0, *d])[:-1]
        self.left, self.right = (_joined([f(x, n) + s for x, n, s in zip(codes, d, shift)]) for f in (np.floor_divide, np.remainder))
        self.contexts = _joined([x + s for x, s in zip(alone, shift)])
        self.pair_sizes, self.context_sizes = [len(x) for x in codes], [len(x) for x in alone]
        self.c, self.whole, self.words = _joined(self.c), _joined(self.whole), pa.concat_arrays(words)

    def added(self) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Distinct tokens, distinct pairs as ``input * tokens + target`` in order, their counts, the contexts' tokens and counts."""
        coded = self.words.dictionary_encode(null_encoding="encode")
        at, d = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(1, len(coded.dictionary))
        codes = at[self.left] * d + at[self.right]
        order = np.argsort(codes)
        codes = codes[order]
        starts = _starts(codes)
        c = np.add.reduceat(self.c[order], starts) if len(starts) else self.c
        return coded.dictionary, codes[starts], c, at[self.contexts], self.whole


_MESSAGE = T.StructType([
    T.StructField("part", T.LongType()), T.StructField("bucket", T.IntegerType()), T.StructField("step", T.IntegerType()),
    T.StructField("body", T.BinaryType())])


def _added(messages: DataFrame, kind: T.DataType, flat: pa.DataType, packed: bool = False) -> DataFrame:
    """``(ctx, nxt, c)``: the counts in the messages added up; with ``packed`` one message per bucket."""
    schema = T.StructType([T.StructField("ctx", kind), T.StructField("nxt", kind), T.StructField("c", T.LongType())])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in _groups(batches, "bucket"):
            counts = _Counts(flat)
            for messages in _runs(group, counts):
                counts.add([m["body"].as_py() for m in messages])
            if packed:
                columns = [[0], [bucket], [0], [counts.body()]]
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, to_arrow_schema(_MESSAGE))], names=_MESSAGE.names)
                continue
            words, codes, c = counts.words, counts.codes, counts.c
            for start in range(0, len(codes), OUT_ROWS):
                code = codes[start : start + OUT_ROWS]
                columns = [words.take(pa.array(code // len(words))), words.take(pa.array(code % len(words))), pa.array(c[start : start + OUT_ROWS])]
                yield pa.record_batch(columns, names=schema.names)

    return _in_groups(messages, "bucket").mapInArrow(add, _MESSAGE if packed else schema)


def _told(parts: DataFrame, kind: pa.DataType, step: int) -> DataFrame:
    """The messages of written parts: their counts in step 0, what they ask for in step 1."""

    def messages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, body in enumerate(batch.column("body")):
                number = batch.column("part")[i].as_py()
                yield from Part(Coded.of(body.as_py(), kind)).messages(number, step, counts=not step, contexts=True)

    return parts.select("part" if step else F.lit(0).alias("part"), "body").mapInArrow(messages, _MESSAGE)


def _answered(home: DataFrame, known: DataFrame, kind: pa.DataType) -> DataFrame:
    """``(part, bucket, body)``: for every part and bucket the counts of its pairs and of its contexts, in the part's order."""

    both = known.unionByName(_told(home, kind, 1))
    schema = T.StructType([_MESSAGE["part"], _MESSAGE["bucket"], _MESSAGE["body"]])

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, group in _groups(batches, "bucket"):
            counts = _Counts(kind)
            for messages in _runs(group, counts):
                told = [m["body"].as_py() for m in messages if m["step"].as_py() == 0]
                asked = [m for m in messages if m["step"].as_py()]
                if told:
                    counts.add(told)
                if asked:
                    bodies = counts.of([m["body"].as_py() for m in asked])
                    columns = [[m["part"].as_py() for m in asked], [bucket] * len(asked), bodies]
                    yield pa.record_batch([pa.array(x, f.type) for x, f in zip(columns, to_arrow_schema(schema))], names=schema.names)

    return _in_groups(both, "bucket", "step").mapInArrow(answer, schema)


class _Counts:
    """The counted pairs and contexts of one bucket."""

    def __init__(self, kind: pa.DataType):
        self.kind, self.c = kind, None

    def add(self, bodies: list[bytes]) -> None:
        if self.c is not None:
            bodies = [self.body(), *bodies]
        self.words, self.codes, self.c, contexts, whole = Merged(bodies, self.kind).added()
        self.whole = _sums(contexts, whole, len(self.words))

    def body(self) -> bytes:
        used = np.flatnonzero(self.whole)
        return _packed(*_plain(self.words), _steps(self.codes), self.c, _steps(used), self.whole[used])

    def of(self, bodies: list[bytes]) -> list[bytes]:
        """The answers to messages that ask."""
        asked = Merged(bodies, self.kind)
        c, whole = np.zeros(len(asked.left), np.int64), np.zeros(len(asked.contexts), np.int64)
        if self.c is not None and len(self.c) + len(self.whole):
            at = pc.index_in(asked.words, value_set=self.words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
            left, right, alone = at[asked.left], at[asked.right], at[asked.contexts]
            codes = np.where((left < 0) | (right < 0), -1, left * len(self.words) + right)
            if len(self.codes):
                found = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
                c = np.where(self.codes[found] == codes, self.c[found], 0)
            whole = np.where(alone < 0, 0, self.whole[alone])
        ends = [np.cumsum([0, *sizes]) for sizes in (asked.pair_sizes, asked.context_sizes)]
        return [_packed(c[a:b], whole[x:y]) for a, b, x, y in zip(ends[0], ends[0][1:], ends[1], ends[1][1:])]


def _kind(rows: DataFrame) -> tuple[T.DataType, pa.DataType]:
    """The type of the tokens, for Spark and for Arrow."""
    kind = rows.schema[next(name for name in ("token", "tokens", "inputs", "ctx") if name in rows.columns)].dataType
    kind = kind.elementType if isinstance(kind, T.ArrayType) else kind
    return kind, to_arrow_schema(T.StructType([T.StructField("token", kind)])).field(0).type


def _in_groups(messages: DataFrame, by: str, then: str = "bucket") -> DataFrame:
    return messages.repartition(by).sortWithinPartitions(by, then)


def _groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[tuple[int, Iterator[dict]]]:
    """The rows of sorted batches by group; a group is read to its end before the next one."""
    rows = ((value, row) for batch in batches for value, row in zip(batch.column(by).to_pylist(), _rows(batch)))
    waiting = next(rows, None)

    def group(value: int) -> Iterator[dict]:
        nonlocal waiting
        while waiting is not None and waiting[0] == value:
            row = waiting[1]
            waiting = next(rows, None)
            yield row

    while waiting is not None:
        value = waiting[0]
        yield value, group(value)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: column[i] for name, column in zip(batch.schema.names, batch.columns)}


def _runs(group: Iterator[dict], counts: _Counts) -> Iterator[list[dict]]:
    """Messages of about ``HELD_PAIRS`` entries at a time, or as many as are counted; those that tell and that ask stay apart."""
    run, size, step = [], 0, None
    for message in group:
        entries = _entries(message["body"].as_py())
        most = HELD_PAIRS if counts.c is None else max(HELD_PAIRS, len(counts.c))
        if run and (size + entries > most or message["step"].as_py() != step):
            yield run
            run, size = [], 0
        step = message["step"].as_py()
        run.append(message)
        size += entries
    yield run


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Coded]]:
    """Keys and tokens of each part."""
    held, size, held_bytes = [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys, *sides = batch.columns[:3]
        if pa.types.is_list(sides[0].type) or pa.types.is_large_list(sides[0].type):
            sizes = sides[0].value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sides, weight = [side.flatten() for side in sides], None
        else:
            sizes, weight = np.ones(len(keys), np.int64), batch.column(3).fill_null(0).to_numpy(zero_copy_only=False)
        ends, row, at = np.cumsum(sizes), 0, 0
        bytes_each = sum(side.nbytes for side in sides) // max(1, len(sides[0])) + 1
        while row < len(ends):
            stop = min(int(ends[-1]), at + max(2, min(PART_PAIRS - size, (PART_BYTES - held_bytes) // bytes_each)))
            last = len(ends) if stop == ends[-1] else int(np.searchsorted(ends, stop, side="right"))
            begun = last < len(ends) and ends[last] - sizes[last] < stop
            cut = np.minimum(ends[row : last + begun], stop) - np.maximum(ends[row : last + begun] - sizes[row : last + begun], at)
            held.append((keys.slice(row, last + begun - row), cut, [side.slice(at, stop - at) for side in sides],
                         None if weight is None else weight[at:stop]))
            size, held_bytes = size + max(stop - at, len(cut)), held_bytes + (stop - at) * bytes_each
            # The last token of a cut row is the input of its next one.
            row, at = last, stop - (begun and len(sides) == 1)
            if size >= PART_PAIRS or held_bytes >= PART_BYTES:
                yield _coded(held)
                held, size, held_bytes = [], 0, 0
                pa.default_memory_pool().release_unused()
    if held:
        yield _coded(held)
    pa.default_memory_pool().release_unused()


def _coded(held: list[tuple]) -> tuple[pa.Array, Coded]:
    keys, sizes, sides, weight = zip(*held)
    weight = np.zeros(0, np.int64) if weight[0] is None else np.concatenate(weight).astype(np.int64)
    flat = pa.concat_arrays([piece for side in zip(*sides) for piece in side]).dictionary_encode(null_encoding="encode")
    words, ids = flat.dictionary, flat.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    if pa.types.is_integer(words.type) and not words.null_count:
        # In their own order whole numbers take fewer bytes.
        order = np.argsort(words.to_numpy(zero_copy_only=False))
        words, ids = words.take(pa.array(order)), _ranks(order)[ids]
    places = len(ids) // len(sides[0])
    return pa.concat_arrays(keys), Coded(words, np.concatenate(sizes), ids[:places], ids[places:], weight)


def _next(ids: np.ndarray) -> np.ndarray:
    return np.append(ids[1:], 0)[: len(ids)]


def _hashes(words: pa.Array) -> np.ndarray:
    """The same for equal tokens in every task."""
    if pa.types.is_integer(words.type):
        return words.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).astype(np.uint64)
    if pa.types.is_string(words.type):
        _, sizes, data = _plain(words)
        ends = np.cumsum(sizes, dtype=np.int64)
        factors = np.cumprod(np.full(int(sizes.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64))
        amounts = (data.astype(np.uint64) + np.uint64(1)) * factors[np.arange(len(data)) - np.repeat(ends - sizes, sizes)]
        sums = np.append(np.zeros(1, np.uint64), np.cumsum(amounts))
        return sums[ends] - sums[ends - sizes]
    return np.fromiter((zlib.crc32(str(word).encode()) for word in words.to_pylist()), np.uint64, len(words))


def _buckets(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    cells = []
    for hashes, factor in ((left, 0x9E3779B97F4A7C15), (right, 0xC2B2AE3D27D4EB4F)):
        x = hashes * np.uint64(factor)
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        cells.append((x >> np.uint64(48)).astype(np.int64) % GRID)
    return cells[0] * GRID + cells[1]


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where equal numbers begin."""
    return np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])


def _ranks(order: np.ndarray) -> np.ndarray:
    ranks = np.empty(len(order), np.int64)
    ranks[order] = np.arange(len(order))
    return ranks


def _sums(at: np.ndarray, amounts: np.ndarray, size: int) -> np.ndarray:
    sums = np.zeros(size, np.int64)
    np.add.at(sums, at, amounts)
    return sums


def _steps(numbers: np.ndarray) -> np.ndarray:
    return np.diff(numbers, prepend=0)


def _joined(arrays: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([np.zeros(0, np.int64), *arrays])


def _plain(words: pa.Array) -> list[np.ndarray]:
    """Tokens as arrays of whole numbers: where a null stands, and the tokens; see :func:`_words`."""
    nulls = np.flatnonzero(words.is_null().to_numpy(zero_copy_only=False))
    if pa.types.is_integer(words.type):
        return [nulls, _steps(words.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))]
    if pa.types.is_string(words.type):
        words = words.fill_null("") if words.null_count else words
        _, offsets, data = words.buffers()
        ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1] if offsets else np.zeros(1, np.int32)
        used = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data else np.zeros(0, np.uint8)
        return [nulls, np.diff(ends), used]
    batch = pa.record_batch([words], names=["words"])
    return [nulls, np.array([len(words)]), np.frombuffer(batch.serialize(), np.uint8)]


def _words(plain: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    nulls = plain[0]
    if pa.types.is_integer(kind):
        words = pa.array(np.cumsum(plain[1]), pa.int64()).cast(kind)
    elif pa.types.is_string(kind):
        ends = np.append(0, np.cumsum(plain[1])).astype(np.int32)
        words = pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends), pa.py_buffer(plain[2])])
    else:
        return pa.ipc.read_record_batch(pa.py_buffer(plain[2]), pa.schema([("words", kind)])).column(0)
    if len(nulls):
        mask = np.zeros(len(words), bool)
        mask[nulls] = True
        words = pc.if_else(pa.array(mask), pa.scalar(None, kind), words)
    return words


def _packed(*arrays: np.ndarray) -> bytes:
    """Whole numbers below 2 ** 64 by the planes of their bytes, compressed; bytes as they are."""
    heads, planes = [len(arrays)], []
    for array in arrays:
        if array.dtype == np.uint8:
            width = 0
            planes.append(array.tobytes())
        else:
            array = array.astype(np.int64).view(np.uint64)
            width = max(1, (int(array.max()).bit_length() + 7) // 8) if len(array) else 1
            planes.append(np.ascontiguousarray(array.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes())
        heads += [len(array), width]
    data = np.array(heads, "<u4").tobytes() + b"".join(planes)
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=3).compress(data, asbytes=True)


def _unpacked(body: bytes) -> list[np.ndarray]:
    data = pa.decompress(body[8:], decompressed_size=int.from_bytes(body[:8], "little"), codec="zstd", asbytes=True)
    heads = np.frombuffer(data, "<u4", 1 + 2 * int(np.frombuffer(data, "<u4", 1)[0]))
    at, arrays = heads.nbytes, []
    for size, width in heads[1:].reshape(-1, 2).tolist():
        flat = np.frombuffer(data, np.uint8, size * max(1, width), at)
        at += len(flat)
        if width:
            numbers = np.zeros((size, 8), np.uint8)
            numbers[:, :width] = flat.reshape(width, size).T
            flat = numbers.view("<u8").reshape(-1).view(np.int64)
        arrays.append(flat)
    return arrays


def _entries(body: bytes) -> int:
    """About how much a message holds, from its size unpacked."""
    return int.from_bytes(body[:8], "little") // 4
