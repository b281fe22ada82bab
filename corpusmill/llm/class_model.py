"""Brown class-based bigram model: P(word | previous) = P(class | previous class) * P(word | class).

Clustering is by exchange: words move between classes as long as the likelihood of the class
bigrams grows. The ``OWN_UNITS`` most frequent words of the training text move on their own; while they
do, all others move together with the words that end alike, so the clustering's state has a
fixed size, whatever the corpus. The state, how often each unit stands next to each class, is
counted over the whole training text in every round. Then every other word of the training text
leaves its ending: the classes around it are counted in Spark, and it moves to the class in
which these are most likely, one step of the exchange against the fixed classes. So each
training word's class comes from its own neighbours, however many words there are.

Word counts are exact for all words. Counts and classes of the most frequent words travel with the job in
tables of bounded size; those of the others are joined by word, and since none of them is frequent, no key is hot.

A token is a run of anything but space and the control characters from tab to carriage
return, A-Z lower-cased; each document ends with one end token, which is also what stands in front
of the first word. Both probabilities are smoothed: a class has one count more for each of
its words and one for all its unknown words; transitions back off to class frequencies.

Defined results: a null or empty text is its end token; an unknown word has the class of its
ending; without training documents every probability is that of an empty model; very long
words are told apart by a 128-bit digest; repeated rows count and stay; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_batches, parts_of, with_row_id
from corpusmill.session import materialize

CLASSES = 64
ROUNDS = 5
# Words whose counts travel with the job, and those of them that are clustered in every round.
KNOWN_WORDS = 1 << 17
OWN_UNITS = 8192
ENDINGS = 2048
# Longer words are represented by a digest, which bounds the table's bytes.
LONG_WORD = 64
END = b""
BACK_OFF = 1.0
# Bytes of text, distinct words and counts a counting task holds before it hands them on; bytes it reads at once.
HELD_TEXT = 1 << 24
HELD_WORDS = 300_000
HELD_COUNTS = 500_000
HELD_BYTES = 1 << 20
COUNT_BINS = 16
# Tasks whose counts are added up together before the sums are.
TASK_GROUP = 256


def ending_of(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % ENDINGS


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Row and word number of every token of the texts, and the distinct lower-cased words; a long one as a marked digest."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.fill_null("")))
    row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
    coded = lists.flatten().dictionary_encode()
    word, names = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.cast(pa.binary())
    sizes = pc.binary_length(names).to_numpy(zero_copy_only=False)
    if (sizes == 0).any():  # in front of a text's first space and behind its last one
        real = sizes[word] > 0
        row, word = row[real], word[real]
    if (sizes > LONG_WORD).any():
        names = pa.array([w if len(w) <= LONG_WORD else b"\xff" + xxhash.xxh3_128_digest(w) for w in names.to_pylist()], pa.binary())
    return row, word, names


def word_counts(docs: DataFrame) -> DataFrame:
    """``(word, train, held)`` over all of ``docs (text, held_out)``, written; words are counted in Arrow, ``HELD_TEXT`` bytes at once."""
    names = ["word", "train", "held"]

    def counted(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(batches).combine_chunks()
        held = table.column(1).to_numpy().astype(bool)
        row, word, found = _split(table.column(0).combine_chunks())
        inside = held[row]
        columns = [np.bincount(word[side], minlength=len(found)) for side in (~inside, inside)]
        used = np.flatnonzero(columns[0] + columns[1])
        ends = np.array([(~held).sum(), held.sum()])
        words = pa.concat_arrays([found.take(pa.array(used)), pa.array([END], pa.binary())])
        return pa.record_batch([words, *[pa.array(np.append(c[used], n)) for c, n in zip(columns, ends)]], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, size = [], 0
        for batch in batches:
            for part in parts_of(batch, HELD_BYTES):
                waiting.append(part)
                size += pc.sum(pc.binary_length(part.column(0))).as_py() or 0
                if size >= HELD_TEXT:
                    yield counted(waiting)
                    waiting, size = [], 0
        if waiting:
            yield counted(waiting)

    partial = docs.select("text", "held_out").mapInArrow(run, "word binary, train bigint, held bigint")
    return materialize(partial.groupBy("word").agg(F.sum("train").alias("train"), F.sum("held").alias("held")), "words")


@dataclass(frozen=True)
class Lexicon:
    """Counts and units of the most frequent words; sizes of the whole vocabulary.

    In a text, numbers below ``n_units`` are units, the next ones stand for ``others``, the known
    words without a unit of their own, and those behind them for the document's words that are not known.
    """

    train: dict[bytes, int]
    units: dict[bytes, int]
    others: list[bytes]
    n_units: int
    tokens: int  # in the training text
    types: int

    def unit(self, word: bytes) -> int:
        found = self.units.get(word)
        return ending_of(word) if found is None else found


def _at_most(counts: DataFrame, limit: int) -> int:
    """Smallest bin of the logarithm of a word's frequency above which at most ``limit`` words lie."""
    bins = counts.groupBy("bin").agg(F.count(F.lit(1)).alias("n")).collect()  # at most 64 * COUNT_BINS rows
    total = 0
    for row in sorted(bins, key=lambda r: -r.bin):
        total += row.n
        if total > limit:
            return row.bin + 1
    return 0


def lexicon(counts: DataFrame, known_words: int = KNOWN_WORDS, own_units: int = OWN_UNITS) -> Lexicon:
    totals = counts.agg(F.sum("train").alias("tokens"), F.count(F.when(F.col("train") > 0, 1)).alias("types")).first()
    binned = counts.where(F.length("word") > 0).withColumn("bin", F.floor(F.log2(F.col("train") + F.col("held")) * COUNT_BINS))
    # Held-out words may choose which counts travel, never which words have a unit of their own.
    trained = binned.where(F.col("train") > 0).withColumn("bin", F.floor(F.log2("train") * COUNT_BINS))
    own = trained.where(F.col("bin") >= _at_most(trained, own_units))
    first = sorted(bytes(r.word) for r in own.select("word").collect())
    known = binned.where(F.col("bin") >= _at_most(binned, known_words)).select("word", "train").unionByName(own.select("word", "train"))
    train = {bytes(r.word): r.train for r in known.collect()}
    units = {w: ending_of(w) for w in train} | {w: ENDINGS + i for i, w in enumerate(first)}
    n_units = ENDINGS + len(first) + 1
    ends = counts.where(F.length("word") == 0).first()
    train[END] = ends.train if ends else 0
    units[END] = n_units - 1
    others = sorted(train.keys() - set(first) - {END})
    return Lexicon(train, units, others, n_units, totals.tokens or 0, totals.types or 0)


def encoded(docs: DataFrame, words: Lexicon) -> DataFrame:
    """``(row_id, doc_id, held_out, n_tokens, units, endings, known, logs, rare, rare_n)``, written.

    ``units`` are the compressed 32-bit numbers of the tokens; ``known`` and ``logs`` sum over the words of
    the lexicon; ``rare`` holds the document's other words, ``endings`` (16 bits) the units of
    their endings and ``rare_n`` how often each occurs.
    """
    numbers = {**words.units, **{w: words.n_units + i for i, w in enumerate(words.others)}}
    table = {w: (numbers[w], float(np.log10(n + 1.0)), n > 0) for w, n in words.train.items()}
    base = words.n_units + len(words.others)

    def start():
        squeeze = zstandard.ZstdCompressor(level=1)
        end_unit = table[END][0]

        def encode(batch):
            # Every different word of the part is looked up once; its documents are told apart by array arithmetic.
            row, word, names = _split(batch.column(2))
            n, listed = batch.num_rows, names.to_pylist()
            found = [table.get(w, (-1, 0.0, False)) for w in listed]
            number, log, is_known = (np.array(column, kind) for column, kind in zip(zip(*found) if found else ([], [], []), (np.int64, float, bool)))
            known, logs = (np.bincount(row, weights=values[word], minlength=n) for values in (is_known, log))
            units = number[word]
            at = np.flatnonzero(units < 0)
            keys, place, amounts = np.unique(row[at] * len(listed) + word[at], return_inverse=True, return_counts=True)
            owner, name = np.divmod(keys, max(1, len(listed)))
            starts = np.searchsorted(owner, np.arange(n + 1))
            units[at] = base + place - starts[row[at]]
            used = np.unique(name)
            endings = np.zeros(len(listed), np.uint16)
            endings[used] = [ending_of(listed[i]) for i in used.tolist()]
            endings = endings[name]
            # The end of each document stands behind its words.
            sizes = np.bincount(row, minlength=n)
            ends = np.cumsum(sizes + 1)
            sequence = np.full(len(units) + n, end_unit, np.uint32)
            sequence[np.arange(len(units)) + row] = units
            offsets = pa.array(starts.astype(np.int32))
            return (batch.column(0), batch.column(1), sizes + 1, [squeeze.compress(s.tobytes()) for s in np.split(sequence, ends[:-1])],
                    [endings[i:j].tobytes() for i, j in zip(starts.tolist(), starts[1:].tolist())], known.astype(np.int64) + table[END][2],
                    logs + table[END][1], pa.ListArray.from_arrays(offsets, names.take(pa.array(name))),
                    pa.ListArray.from_arrays(offsets, pa.array(amounts.astype(np.int32))))

        return encode

    schema = ("doc_id bigint, held_out boolean, n_tokens bigint, units binary, endings binary, known bigint, logs double, "
              "rare array<binary>, rare_n array<int>")
    return materialize(with_row_id(map_batches(docs.select("doc_id", "held_out", "text"), schema, start)), "units")


class Reader:
    """Tokens of a batch's documents, one after the other; every document ends with the end unit."""

    def __init__(self, words: Lexicon):
        self.n_units, self.base = words.n_units, words.n_units + len(words.others)
        self.units = np.append(np.arange(self.n_units), np.fromiter(map(ending_of, words.others), np.int64, len(words.others)))

    def places(self, batch: pa.RecordBatch) -> np.ndarray:
        """Numbers of the tokens of ``batch (units, endings, ...)``; rare words are numbered through the whole batch."""
        expand = zstandard.ZstdDecompressor()
        found = [np.frombuffer(expand.decompress(v.as_buffer()), np.uint32) for v in batch.column(0)]
        rare = np.array([len(v.as_buffer()) // 2 for v in batch.column(1)], np.int64)
        shifts = np.repeat(np.cumsum(rare) - rare, [len(f) for f in found])
        numbers = np.concatenate(found).astype(np.int64)
        return numbers + shifts * (numbers >= self.base)

    def endings(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.frombuffer(b"".join(v.as_py() for v in batch.column(1)), np.uint16).astype(np.int64)

    def units_of(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.append(self.units, self.endings(batch))[self.places(batch)]


def neighbours(training: DataFrame, words: Lexicon, classes: np.ndarray, n_classes: int) -> tuple[np.ndarray, np.ndarray]:
    """How often each unit stands before (first result) and after each class, over the whole training text.

    Tasks count densely and hand on blocks of units; the blocks are added up in Spark, first those of
    neighbouring tasks, and only the sums, of a size that does not depend on the corpus, reach the driver.
    """
    n_units, block = words.n_units, 512
    width = n_units * n_classes
    reader = Reader(words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, width), np.int64)
        for batch in batches:
            for part in parts_of(batch, HELD_BYTES):
                units = reader.units_of(part)
                before = np.append(n_units - 1, units[:-1])  # the end unit stands before each first word
                total[0] += np.bincount(before * n_classes + classes[units], minlength=width)
                total[1] += np.bincount(units * n_classes + classes[before], minlength=width)
        cells = total.reshape(2, n_units, n_classes)
        starts = range(0, n_units, block)
        yield pa.record_batch([pa.array(list(starts), pa.int64()), pa.array([cells[:, s : s + block].tobytes() for s in starts], pa.binary())],
                              names=["start", "cells"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for start, cells in zip(batch.column(0).to_pylist(), batch.column(1)):
                found = np.frombuffer(cells.as_buffer(), np.int64)
                sums[start] = sums[start] + found if start in sums else found
        if sums:
            yield pa.record_batch([pa.array(list(sums), pa.int64()), pa.array([s.tobytes() for s in sums.values()], pa.binary())],
                                  names=["start", "cells"])

    schema = "start bigint, cells binary"
    parts = training.select("units", "endings").mapInArrow(count, schema)
    parts = parts.withColumn("group", F.floor(F.spark_partition_id() / TASK_GROUP))
    parts = parts.repartition("start", "group").select("start", "cells").mapInArrow(add, schema)
    parts = parts.repartition("start").mapInArrow(add, schema)
    total = np.zeros((2, n_units, n_classes), np.int64)
    for row in parts.collect():
        cells = np.frombuffer(row.cells, np.int64).reshape(2, -1, n_classes)
        total[:, row.start : row.start + cells.shape[1]] = cells
    return total[0], total[1]


def _x_log_x(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1.0))


def exchanged(classes: np.ndarray, after: np.ndarray, before: np.ndarray, n_classes: int) -> np.ndarray:
    """One sweep of exchanges: each unit, the most frequent first, moves to the class that gains most.

    The end unit stays alone in the last class. ``after`` and ``before`` are the counts of
    :func:`neighbours` under ``classes``.
    """
    classes = classes.copy()
    grid = np.zeros((n_classes, n_classes))
    np.add.at(grid, classes, after)
    sizes = grid.sum(axis=1)
    frequency = after.sum(axis=1)
    for unit in np.argsort(-frequency[:-1], kind="stable"):
        if not frequency[unit]:
            break
        old, right, left, n = classes[unit], after[unit].astype(float), before[unit].astype(float), float(frequency[unit])
        grid[old] -= right
        grid[:, old] -= left
        np.maximum(grid, 0.0, out=grid)
        sizes[old] -= n
        gain = (_x_log_x(grid + right) - _x_log_x(grid)).sum(axis=1)
        gain += (_x_log_x(grid + left[:, None]) - _x_log_x(grid)).sum(axis=0)
        gain -= 2.0 * (_x_log_x(sizes + n) - _x_log_x(sizes))
        new = int(gain[:-1].argmax())
        grid[new] += right
        grid[:, new] += left
        sizes[new] += n
        classes[unit] = new
    return classes


@dataclass(frozen=True)
class ClassModel:
    """``transition[a, b]`` and ``emission[c]``: log10 of a class after a class, of one count of a class."""

    transition: np.ndarray
    emission: np.ndarray


def cluster(training: DataFrame, words: Lexicon, n_classes: int = CLASSES, rounds: int = ROUNDS) -> np.ndarray:
    """Class of each unit."""
    classes = np.arange(words.n_units, dtype=np.int64) % (n_classes - 1)
    classes[-1] = n_classes - 1
    for _ in range(rounds):
        classes = exchanged(classes, *neighbours(training, words, classes, n_classes), n_classes)
    return classes


def _transition(grid: np.ndarray) -> np.ndarray:
    """log10 of the smoothed probability of a class (column) after a class (row)."""
    sizes = grid.sum(axis=1)
    share = (sizes + 1.0) / (sizes.sum() + len(grid))
    return np.log10((grid + BACK_OFF * share) / (sizes[:, None] + BACK_OFF))


def context_counts(training: DataFrame, words: Lexicon, classes: np.ndarray, n_classes: int = CLASSES) -> DataFrame:
    """``(word, slot, codes, ns)`` of every training word without a unit of its own, rows of a word in one partition and together.

    ``codes`` (16 bits) are the classes in front of the word and, ``n_classes`` higher, those behind it; ``ns`` (32 bits)
    how often each occurs in a part of the text; ``slot`` is the word's place among the lexicon's ``others`` or -1.
    """
    reader, others = Reader(words), words.others
    width, n_units, n_others = 2 * n_classes, words.n_units, len(words.others)

    def binaries(values: np.ndarray, starts: np.ndarray) -> pa.Array:
        offsets = (starts * values.itemsize).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(starts) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(values)])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rare: dict[bytes, int] = {}
        held: list[np.ndarray] = [np.empty((2, 0), np.int64)]

        def merged() -> np.ndarray:
            keys, amounts = np.concatenate(held, axis=1)
            order = np.argsort(keys, kind="stable")
            keys, amounts = keys[order], amounts[order]
            first = np.flatnonzero(np.diff(keys, prepend=-1))
            return np.stack([keys[first], np.add.reduceat(amounts, first) if len(first) else amounts])

        def rows() -> pa.RecordBatch:
            keys, amounts = merged()
            word, code = np.divmod(keys, width)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            starts, word = np.append(first, len(keys)), word[first]
            names = pa.array([*others, *rare], pa.binary()).take(pa.array(word))
            rare.clear()
            held[:] = [np.empty((2, 0), np.int64)]
            return pa.record_batch([names, pa.array(np.where(word < n_others, word, -1)), binaries(code.astype(np.uint16), starts),
                                    binaries(amounts.astype(np.uint32), starts)], names=["word", "slot", "codes", "ns"])

        for batch in batches:
            for part in parts_of(batch, HELD_BYTES):
                numbers = reader.places(part)
                kinds = classes[np.append(reader.units, reader.endings(part))[numbers]]
                names = [rare.setdefault(w, n_others + len(rare)) for ws in part.column(2).to_pylist() for w in ws]
                at = np.flatnonzero(numbers >= n_units)  # an end stands behind every word
                word = np.append(np.arange(n_others), np.array(names, np.int64))[numbers[at] - n_units] * width
                before = np.append(classes[n_units - 1], kinds)[at]
                held.append(np.stack(np.unique(np.append(word + before, word + n_classes + kinds[at + 1]), return_counts=True)))
                if sum(h.shape[1] for h in held) > HELD_COUNTS:
                    held[:] = [merged()]
                if len(rare) > HELD_WORDS or 2 * held[0].shape[1] > HELD_COUNTS:
                    yield rows()
        yield rows()

    partial = training.select("units", "endings", "rare").mapInArrow(count, "word binary, slot bigint, codes binary, ns binary")
    return partial.repartition("word").sortWithinPartitions("word")


def assigned(training: DataFrame, words: Lexicon, classes: np.ndarray, n_classes: int = CLASSES) -> DataFrame:
    """``(word, slot, train, kind)``, written: the class in which a word's neighbours are most likely, for all words of :func:`context_counts`."""
    after, _ = neighbours(training, words, classes, n_classes)
    grid = np.zeros((n_classes, n_classes))
    np.add.at(grid, classes, after)
    steps = _transition(grid)
    # In front of and behind a word of each class; the last class is that of the end alone.
    gains = np.concatenate([steps, steps.T])[:, :-1]
    sizes = np.log10(grid.sum(axis=1) + 1.0)[:-1]
    width = 2 * n_classes

    def chosen(names: list[bytes], slots: list[int], total: np.ndarray) -> pa.RecordBatch:
        train = total[:, n_classes:].sum(axis=1)
        kinds = (total @ gains - train[:, None] * sizes).argmax(axis=1)
        return pa.record_batch([pa.array(names, pa.binary()), pa.array(slots, pa.int64()), pa.array(train.astype(np.int64)), pa.array(kinds)],
                               names=["word", "slot", "train", "kind"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes, int, np.ndarray] | None = None  # a word may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            names = batch.column(0).to_pylist()
            first = [i for i in range(len(names)) if not i or names[i] != names[i - 1]]
            group = np.repeat(np.arange(len(first)), np.diff([*first, len(names)]))
            lengths = pc.binary_length(batch.column(2)).to_numpy() // 2
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint16)
            amounts = np.frombuffer(b"".join(batch.column(3).to_pylist()), np.uint32)
            total = np.bincount(np.repeat(group, lengths) * width + codes, weights=amounts, minlength=len(first) * width).reshape(-1, width)
            if last and last[0] == names[0]:
                total[0] += last[2]
            elif last:
                yield chosen([last[0]], [last[1]], last[2][None])
            slots = batch.column(1).to_pylist()
            last = names[-1], slots[-1], total[-1].copy()
            yield chosen([names[i] for i in first[:-1]], [slots[i] for i in first[:-1]], total[:-1])
        if last:
            yield chosen([last[0]], [last[1]], last[2][None])

    counts = context_counts(training, words, classes, n_classes)
    return materialize(counts.mapInArrow(choose, "word binary, slot bigint, train bigint, kind bigint"), "assigned")


def classed(rows: DataFrame, words: Lexicon, classes: np.ndarray, found: DataFrame) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, logs, kinds)``, written: the documents as compressed classes (16 bits) of their tokens."""
    reader = Reader(words)
    known = classes[reader.units]
    for row in found.where("slot >= 0").select("slot", "kind").collect():  # at most the lexicon's words
        known[words.n_units + row.slot] = row.kind
    each = rows.select("row_id", F.posexplode(F.arrays_zip("rare", "rare_n")).alias("place", "r"))
    each = each.select("row_id", "place", F.col("r.rare").alias("word"), F.col("r.rare_n").alias("n"))
    rare = each.join(found.where("slot < 0").select("word", "train", "kind"), "word").groupBy("row_id").agg(
        F.sum(F.col("n") * F.log10(F.col("train") + 1.0)).alias("_logs"), F.sum("n").alias("_known"),
        F.collect_list(F.struct("place", "kind")).alias("_found"))
    joined = rows.drop("rare", "rare_n").join(rare, "row_id", "left").select(
        "units", "endings", F.col("_found.place").alias("places"), F.col("_found.kind").alias("kinds"), "doc_id", "held_out", "n_tokens",
        (F.col("known") + F.coalesce("_known", F.lit(0))).cast("bigint").alias("n_known"),
        (F.col("logs") + F.coalesce("_logs", F.lit(0.0))).alias("logs"))

    def start():
        squeeze = zstandard.ZstdCompressor(level=1)

        def run(batch):
            kinds = classes[reader.endings(batch)]
            sizes = np.array([len(v.as_buffer()) // 2 for v in batch.column(1)], np.int64)
            for first, places, chosen in zip(np.cumsum(sizes) - sizes, batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                if places:
                    kinds[first + np.array(places)] = chosen
            sequence = np.append(known, kinds)[reader.places(batch)].astype(np.uint16)
            ends = np.cumsum(batch.column(6).to_numpy())
            return *batch.columns[4:], [squeeze.compress(part.tobytes()) for part in np.split(sequence, ends[:-1])]

        return run

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, kinds binary"
    return materialize(map_batches(joined, schema, start, HELD_BYTES), "classes")


def _kinds(column: pa.Array) -> np.ndarray:
    expand = zstandard.ZstdDecompressor()
    return np.frombuffer(b"".join(expand.decompress(v.as_buffer()) for v in column), np.uint16).astype(np.int64)


def fit(training: DataFrame, types: np.ndarray) -> ClassModel:
    """The model of ``training (kinds)``; ``types`` are the distinct training words of each class, the last one that of the end."""
    n_classes = len(types)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes * n_classes, np.int64)
        for batch in batches:
            for part in parts_of(batch, HELD_BYTES):
                kinds = _kinds(part.column(0))
                total += np.bincount(np.append(n_classes - 1, kinds[:-1]) * n_classes + kinds, minlength=len(total))
        yield pa.record_batch([pa.array(np.arange(len(total))), pa.array(total)], names=["cell", "n"])

    cells = training.select("kinds").mapInArrow(count, "cell bigint, n bigint").groupBy("cell").agg(F.sum("n").alias("n"))
    grid = np.zeros(n_classes * n_classes)
    for row in cells.collect():  # one row per pair of classes
        grid[row.cell] = row.n
    grid = grid.reshape(n_classes, n_classes)
    return ClassModel(_transition(grid), -np.log10(grid.sum(axis=1) + types + 1.0))


def class_types(words: Lexicon, classes: np.ndarray, found: DataFrame) -> np.ndarray:
    """Number of distinct training words of each class, over the whole vocabulary."""
    types = np.bincount(classes[ENDINGS:-1], minlength=int(classes[-1]) + 1).astype(np.int64)
    types[-1] = words.train[END] > 0
    for row in found.groupBy("kind").agg(F.count(F.lit(1)).alias("n")).collect():  # one row per class
        types[row.kind] += row.n
    return types


def score(docs: DataFrame, n_classes: int = CLASSES, rounds: int = ROUNDS, known_words: int = KNOWN_WORDS,
          own_units: int = OWN_UNITS) -> DataFrame:
    """``(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity)``.

    ``docs (doc_id, text, held_out)``: the model learns from the rows that are not held out
    and scores all. ``base_score`` is that of a smoothed unigram model.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       F.coalesce("held_out", F.lit(False)).alias("held_out"))
    words = lexicon(word_counts(docs), known_words, own_units)
    rows = encoded(docs, words)
    training = rows.where("not held_out")
    classes = cluster(training, words, n_classes, rounds)
    found = assigned(training, words, classes, n_classes)
    texts = classed(rows, words, classes, found)
    model = fit(texts.where("not held_out"), class_types(words, classes, found))
    transition, emission = model.transition, model.emission

    def start():
        def run(batch):
            kinds = _kinds(batch.column(5))
            steps = transition[np.append(len(emission) - 1, kinds[:-1]), kinds] + emission[kinds]
            ends = np.cumsum(batch.column(2).to_numpy())
            return *batch.columns[:5], np.add.reduceat(steps, np.append(0, ends[:-1]))

        return run

    schema = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, logs double, steps double"
    chain = map_batches(texts, schema, start, HELD_BYTES)
    total = F.col("steps") + F.col("logs")
    norm = float(np.log10(words.tokens + words.types + 1.0))
    return chain.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(words.tokens).cast("bigint").alias("train_tokens"),
        (F.col("logs") - F.col("n_tokens") * F.lit(norm)).alias("base_score"),
        total.alias("score"), F.pow(F.lit(10.0), -total / F.col("n_tokens")).alias("perplexity"),
    )
