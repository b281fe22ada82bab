"""Grouping of spelling variants over a bit-sliced position index.

The index holds one bitset over the words for every position and letter. A word is looked up
against all indexed words at once: the set without an error and the sets with one error, at the
same position or shifted by one, go through the word's letters together, 64 indexed words to
an operation.

A word meets only words that can be near it. Of two words that differ by one code point, the
shorter having ``l``, either the first ``l // 2`` code points agree or the last ``l - l // 2``
do. Words are dealt by these ends to cells of bounded size, many ends to a cell; an end with
more words than a cell holds gets a grid of cells, parts of the index times parts of the words
looked up. Only near pairs become rows.

Defined results: a null text has no words; a null id counts as empty in the deletion rule;
repeated rows count again; words with equal counts are compared by code point; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.skew import keyed_join
from corpusmill.session import materialize, write_table

LETTERS = "A-Za-zÀ-ÿ"
MIN_LENGTH = 5
MIN_COUNT = 3
ODD_EVERY = 97
# Words in a cell's index; fewer if they are long, so that a cell holds a bounded number of letters.
CELL_WORDS = 4096
CELL_LETTERS = 1 << 17
LEAST_CELL = 16
# Machine words of one bitset matrix: words looked up together times words of a bitset.
MATRIX = 1 << 16


def words_of(docs: DataFrame, min_length: int = MIN_LENGTH, odd_every: int = ODD_EVERY) -> DataFrame:
    """``(word)``, one row per occurrence of a word that may be long enough."""
    lowered = F.translate(F.col("text").cast("string"), string.ascii_uppercase, string.ascii_lowercase)
    # A shorter run never gives a long enough word, and a longer one is taken whole.
    runs = F.regexp_extract_all(lowered, F.lit(f"[{LETTERS}]{{{min_length},}}"), F.lit(0))
    doc = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    found = docs.select(doc.alias("doc"), F.explode(runs).alias("run"))
    found = found.select("run", F.crc32(F.concat("doc", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    return found.select(F.when(F.col("h") % odd_every == 0, shorter).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame, min_length: int = MIN_LENGTH, min_count: int = MIN_COUNT) -> DataFrame:
    """``(word, n)``: distinct words that are long and frequent enough, and their occurrences."""
    counted = words_of(docs, min_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    return counted.where((F.col("n") >= min_count) & (F.length("word") >= min_length))


class PositionIndex:
    """Bitsets over words, one per position and letter that occurs."""

    def __init__(self, letters: np.ndarray, lengths: np.ndarray):
        """``letters``: one row per word, 0 behind its end; letters are numbered from 1."""
        self.letters, self.base = letters, int(letters.max(initial=0)) + 1
        self.width = -(-len(letters) // 64)
        word, place = np.nonzero(letters)
        self.slots, slot = np.unique(place * self.base + letters[word, place], return_inverse=True)
        self.bits = np.zeros((len(self.slots) + 1, self.width), np.uint64)
        np.bitwise_or.at(self.bits, (slot, word // 64), np.uint64(1) << (word % 64).astype(np.uint64))
        self.lengths = lengths

    def of_length(self, length: int) -> np.ndarray:
        flags = np.pad(self.lengths == length, (0, self.width * 64 - len(self.lengths)))
        return np.packbits(flags, bitorder="little").view(np.uint64)

    def having(self, place: int, letters: np.ndarray) -> np.ndarray:
        """One bitset per letter: the words that have it at this position."""
        wanted = place * self.base + letters
        at = np.searchsorted(self.slots, wanted)
        known = (letters > 0) & (letters < self.base) & (at < len(self.slots))
        known[known] = self.slots[at[known]] == wanted[known]
        return self.bits[np.where(known, at, len(self.slots))]

    def near(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of ``asked``, all equally long, and indexed words that are as long or longer by one.

        The words differ by one replaced code point, or the indexed one has one more.
        """
        length = asked.shape[1]
        same_length, longer = self.of_length(length), self.of_length(length + 1)
        rows, found = [], []
        step = max(1, MATRIX // max(1, self.width))
        for start in range(0, len(asked), step):
            part = asked[start : start + step]
            none = np.tile(same_length | longer, (len(part), 1))
            replaced, inserted = np.zeros_like(none), np.zeros_like(none)
            for i in range(length):
                here, behind = self.having(i, part[:, i]), self.having(i + 1, part[:, i])
                inserted = (inserted | none) & behind
                replaced = (replaced & here) | (none & ~here)
                none &= here
            hits = (replaced & same_length) | ((inserted | none) & longer)
            row, block = np.nonzero(hits)
            bits = (hits[row, block][:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)
            at, bit = np.nonzero(bits)
            rows.append(start + row[at])
            found.append(block[at] * 64 + bit)
        return np.concatenate(rows), np.concatenate(found)


def numbered_letters(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of the words as one row of numbers each, 0 behind the end; and the words' lengths."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    _, number = np.unique(codes, return_inverse=True)
    letters = np.zeros((len(words), int(lengths.max(initial=0))), np.int64)
    letters[np.arange(letters.shape[1]) < lengths[:, None]] = number + 1
    return letters, lengths


def _near_in_cell(cell: pa.Table) -> pa.Table:
    """Near pairs of one cell, in both directions unless the other word is looked up as well."""
    words, counts = cell.column("word").to_pylist(), cell.column("n").to_numpy()
    letters, lengths = numbered_letters(words)
    indexed = np.flatnonzero(cell.column("indexed").to_numpy(zero_copy_only=False))
    asked = np.flatnonzero(cell.column("asked").to_numpy(zero_copy_only=False))
    size, front = cell.column("size")[0].as_py(), cell.column("front")[0].as_py()
    left = right = np.empty(0, np.int64)
    if len(indexed) and len(asked):
        index = PositionIndex(letters[indexed], lengths[indexed])
        row, found = index.near(letters[asked][:, :size])
        left, right = asked[row], indexed[found]
        # A pair that agrees in front comes out of the cells dealt by the front ends, any other of those by the back ends.
        agree = (letters[left, : size // 2] == letters[right, : size // 2]).all(axis=1)
        left, right = left[agree == front], right[agree == front]
        longer = lengths[right] > lengths[left]
        left, right = np.concatenate([left, right[longer]]), np.concatenate([right, left[longer]])
    column = cell.column("word").combine_chunks()
    return pa.table({
        "word": column.take(pa.array(left)), "near": column.take(pa.array(right)),
        "near_n": pa.array(counts[right], pa.int64()),
    })


def _cells(words: DataFrame) -> DataFrame:
    """``(front, size, slot, i, q, word, n, indexed, asked)``: every word in the cells it may meet a near one.

    ``size`` is the length of the words looked up; a word is indexed for its own length and for
    words shorter by one.
    """
    length = F.length("word")

    def ends(front: bool, shorter: int) -> Column:
        size = length - shorter
        half = F.floor(size / 2).cast("int")
        kept = half if front else size - half
        key = F.substring("word", F.lit(1) if front else length - kept + 1, kept)
        return F.struct(F.lit(front).alias("front"), size.alias("size"), key.alias("key"), F.lit(shorter == 0).alias("asked"))

    entries = words.select("word", "n", F.inline(F.array(*[ends(f, s) for f in (True, False) for s in (0, 1)])))
    entries = materialize(entries.where("size > 0"), "ends")
    room = F.greatest(F.lit(LEAST_CELL), F.least(F.lit(CELL_WORDS), F.floor(F.lit(CELL_LETTERS) / F.col("size"))))
    keys = materialize(entries.groupBy("front", "size", "key").agg(F.count(F.lit(1)).alias("rows")), "end-counts")
    crowded = keys.where(F.col("rows") > room).withColumn("parts", F.ceil(F.col("rows") / room).cast("int"))
    # One row per length of a word.
    plain = keys.where(F.col("rows") <= room).groupBy("front", "size").agg(F.sum("rows").alias("rows"))
    plain = write_table(plain.withColumn("slots", F.ceil(F.col("rows") / room)), "lengths")
    dealt = keyed_join(entries, crowded, ["front", "size", "key"], weight="rows", how="left").drop("rows")
    dealt = keyed_join(dealt, plain, ["front", "size"], weight="rows", how="left").drop("rows")
    own = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    all_parts = F.sequence(F.lit(0), F.col("parts") - 1)
    place = lambda i, q, indexed, asked: F.struct(
        i.alias("i"), q.alias("q"), F.lit(indexed).alias("indexed"), asked.alias("asked"))
    grid = F.concat(
        F.transform(all_parts, lambda q: place(own, q, True, F.lit(False))),
        F.when(F.col("asked"), F.transform(all_parts, lambda i: place(i, own, False, F.lit(True)))).otherwise(F.array()),
    )
    single = F.array(place(F.lit(0), F.lit(0), True, F.col("asked")))
    slot = F.when(F.col("parts").isNull(), F.pmod(F.xxhash64("key"), F.col("slots")).cast("string")).otherwise(
        F.concat(F.lit("="), "key"))
    return dealt.select("front", "size", slot.alias("slot"), "word", "n",
                        F.inline(F.when(F.col("parts").isNull(), single).otherwise(grid)))


def near_words(words: DataFrame) -> DataFrame:
    """``(word, near, near_n)`` for the distinct ``words (word, n)``: every ordered pair that differs by one code point."""
    cells = _cells(words).groupBy("front", "size", "slot", "i", "q")
    return cells.applyInArrow(_near_in_cell, "word string, near string, near_n bigint")


def _roots(forms: DataFrame) -> DataFrame:
    """``(word, root)`` for ``forms (word, form)``; a round doubles the length of the way that is known.

    A form is at least twice as frequent, so the ways are short and never come back.
    """
    ways = materialize(forms.select("word", F.col("form").alias("root")), "ways")
    while True:
        used = ways.groupBy("root").agg(F.count(F.lit(1)).alias("uses"))
        further = write_table(
            ways.select(F.col("word").alias("root"), F.col("root").alias("next")).join(used, "root"), "further")
        if further.df.isEmpty():
            return ways
        joined = keyed_join(ways, further, "root", weight="uses", how="left")
        ways = materialize(joined.select("word", F.coalesce("next", "root").alias("root")), "ways")


def variant_groups(words: DataFrame) -> DataFrame:
    """``(word, n, n_near, form, form_n, root)`` for the distinct ``words (word, n)``."""
    words = materialize(words.select("word", "n"), "vocabulary")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best")
    found = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    chosen = F.col("n_near").isNotNull() & (-F.col("best.less") >= 2 * F.col("n"))
    formed = words.join(found, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
        F.when(chosen, F.col("best.near")).alias("form"), F.when(chosen, -F.col("best.less")).alias("form_n"),
    )
    formed = materialize(formed, "formed")
    roots = _roots(formed.where("form is not null").select("word", "form"))
    return formed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
