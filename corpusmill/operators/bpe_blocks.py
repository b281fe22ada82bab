"""Blocks of words with an inverted index from symbol pairs to the words that hold them.

A block is one row: the symbols of many words as one flat array, every word closed by ``END``,
the words' counts, and for every adjacent pair of symbols the words it occurs in. A merge reads
the words of its own pair from the index, or, if an earlier merge of the run has made the pair,
from that merge, and leaves all others alone. So a run of merges costs what it changes, not a
pass over the block for each of them. A pair of symbols l and r is one number,
``l << 32 | r``, so numbers sort like pairs.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Merge = tuple[int, int, int]

END = -1
# Words and symbols of one block.
BLOCK_WORDS = 1 << 15
BLOCK_SYMBOLS = 1 << 20
BLOCK_SCHEMA = "symbols binary, counts binary, pairs binary, starts binary, words binary"


def pair_code(l: int, r: int) -> int:
    return l << 32 | r


def flat_symbols(words: Sequence[str]) -> np.ndarray:
    """Code points of words without blanks, each word closed by ``END``."""
    codes = np.frombuffer("".join(f"{word} " for word in words).encode("utf-32-le"), np.int32).copy()
    codes[codes == ord(" ")] = END
    return codes


def word_numbers(symbols: np.ndarray) -> np.ndarray:
    """The number of the word that each entry belongs to."""
    ends = symbols == END
    return np.cumsum(ends) - ends


def pairs_in(symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code and word of every adjacent pair."""
    at = np.flatnonzero((symbols[:-1] != END) & (symbols[1:] != END))
    return symbols[at].astype(np.int64) << 32 | symbols[at + 1], word[at]


def summed(codes: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes and the sums of their weights."""
    order = np.argsort(codes, kind="stable")
    codes = codes[order]
    first = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1]))) if len(codes) else order
    return codes[first], np.add.reduceat(weights[order], first) if len(first) else weights


class Block:
    """One block as arrays."""

    def __init__(self, symbols: np.ndarray, counts: np.ndarray):
        """Words without a pair are left out; the index is made from the others."""
        word = word_numbers(symbols)
        paired = np.bincount(word, minlength=len(counts)) > 2
        self.symbols, self.counts = symbols[paired[word]], counts[paired]
        codes, words = pairs_in(self.symbols, word_numbers(self.symbols))
        order = np.argsort(codes, kind="stable")
        codes, words = codes[order], words[order]
        new = np.ones(len(codes), bool)
        new[1:] = (codes[1:] != codes[:-1]) | (words[1:] != words[:-1])
        self.pairs, starts = np.unique(codes[new], return_index=True)
        self.words = words[new].astype(np.int32)
        self.starts = np.append(starts, len(self.words)).astype(np.int32)

    @classmethod
    def read(cls, row: dict[str, bytes | pa.Buffer]) -> Block:
        block = cls.__new__(cls)
        kinds = {"symbols": np.int32, "counts": np.int64, "pairs": np.int64, "starts": np.int32, "words": np.int32}
        for name, kind in kinds.items():
            setattr(block, name, np.frombuffer(row[name], kind))
        return block

    def row(self) -> tuple[bytes, ...]:
        return tuple(getattr(self, name).tobytes() for name in ("symbols", "counts", "pairs", "starts", "words"))

    def found(self, code: int) -> np.ndarray:
        """The words that held a pair when the block was written."""
        at = int(np.searchsorted(self.pairs, code))
        if at == len(self.pairs) or self.pairs[at] != code:
            return self.words[:0]
        return self.words[self.starts[at] : self.starts[at + 1]]

    def changes(self, pending: Sequence[Merge], steps: Sequence[Merge]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Step, pair and difference of its count, for each of the ``steps`` taken after the ``pending`` merges."""
        run = Run(self, [*pending, *steps])
        for merge in pending:
            run.take(merge)
        found = [(np.empty(0, np.int64),) * 3]
        for step, merge in enumerate(steps):
            old, old_words, new, new_words = run.take(merge)
            if not len(old):
                continue
            weights = np.concatenate((-self.counts[old_words], self.counts[new_words]))
            codes, sums = summed(np.concatenate((old, new)), weights)
            moved = sums != 0
            found.append((np.full(int(moved.sum()), step), codes[moved], sums[moved]))
        return tuple(np.concatenate(x) for x in zip(*found))

    def _symbols_after(self, pending: Sequence[Merge]) -> np.ndarray:
        run = Run(self, pending)
        for merge in pending:
            run.take(merge)
        return run.flat()

    def after(self, pending: Sequence[Merge]) -> Block:
        return Block(self._symbols_after(pending), self.counts)

    def pair_counts(self, pending: Sequence[Merge]) -> tuple[np.ndarray, np.ndarray]:
        symbols = self._symbols_after(pending)
        codes, words = pairs_in(symbols, word_numbers(symbols))
        return summed(codes, self.counts[words])


class Run:
    """A block's words while a known run of merges is taken one after the other.

    A word keeps its place in the flat array and gets shorter there. Only pairs with the symbol
    that a merge makes can be new, so the words of those that the run still needs are noted then.
    """

    def __init__(self, block: Block, merges: Sequence[Merge]):
        self.block = block
        self.symbols = block.symbols.copy()
        ends = np.flatnonzero(self.symbols == END)
        self.begin = np.append(0, ends[:-1] + 1)[: len(ends)]
        self.size = ends - self.begin
        self.needed: dict[int, set[int]] = {}
        for l, r, _ in merges:
            for symbol in (l, r):
                self.needed.setdefault(symbol, set()).add(pair_code(l, r))
        self.noted: dict[int, list[np.ndarray]] = {}

    def places(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the words' symbols, word after word, and which of the words each belongs to."""
        sizes = self.size[words]
        ends = np.cumsum(sizes)
        which = np.repeat(np.arange(len(words)), sizes)
        return np.arange(len(which)) + (self.begin[words] - ends + sizes)[which], which

    def take(self, merge: Merge) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Merge left to right without overlaps. Pairs and words of the changed words, before and after."""
        l, r, made = merge
        code = pair_code(l, r)
        words = self.block.found(code)
        if code in self.noted:
            words = np.unique(np.concatenate([words, *self.noted[code]]))
        place, which = self.places(words)
        symbols = self.symbols[place]
        hit = np.flatnonzero((symbols[:-1] == l) & (symbols[1:] == r) & (which[:-1] == which[1:]))
        if not len(hit):
            return (np.empty(0, np.int64),) * 4
        changed = np.zeros(len(words), bool)
        changed[which[hit]] = True
        if not changed.all():
            words = words[changed]
            kept = changed[which]
            where = np.cumsum(kept) - 1
            hit, symbols, place = where[hit], symbols[kept], place[kept]
            which = np.repeat(np.arange(len(words)), self.size[words])
        if l == r:
            first = np.diff(hit, prepend=-2) != 1
            hit = hit[(hit - np.maximum.accumulate(np.where(first, hit, 0))) % 2 == 0]
        old, old_words = self._pairs(symbols, which, words)
        symbols[hit] = made
        kept = np.ones(len(symbols), bool)
        kept[hit + 1] = False
        self.size[words] -= np.bincount(which[hit], minlength=len(words))
        symbols, which = symbols[kept], which[kept]
        self.symbols[self.places(words)[0]] = symbols
        new, new_words = self._pairs(symbols, which, words)
        for code in self.needed.get(made, ()):
            at = new_words[new == code]
            if len(at):
                self.noted.setdefault(code, []).append(at)
        return old, old_words, new, new_words

    @staticmethod
    def _pairs(symbols: np.ndarray, which: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(which[:-1] == which[1:])
        return symbols[at].astype(np.int64) << 32 | symbols[at + 1], words[which[at]]

    def flat(self) -> np.ndarray:
        """The symbols as they are now, every word closed by ``END``."""
        place, which = self.places(np.arange(len(self.size)))
        out = np.full(len(place) + len(self.size), END, np.int32)
        out[np.arange(len(place)) + which] = self.symbols[place]
        return out


def make_blocks(words: DataFrame, partitions: int) -> DataFrame:
    """Blocks of the words of ``words (word, n)`` that hold a pair."""
    names = [part.split()[0] for part in BLOCK_SCHEMA.split(", ")]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[str] = []
        counts: list[int] = []
        size = 0

        def block() -> pa.RecordBatch:
            row = Block(flat_symbols(held), np.array(counts, np.int64)).row()
            return pa.record_batch([pa.array([value], pa.binary()) for value in row], names=names)

        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.append(word)
                counts.append(n)
                size += len(word) + 1
                if len(held) >= BLOCK_WORDS or size >= BLOCK_SYMBOLS:
                    yield block()
                    held, counts, size = [], [], 0
        if held:
            yield block()

    several = words.where(F.length("word") > 1).select("word", F.col("n").cast("bigint").alias("n"))
    return several.repartition(partitions, "word").mapInArrow(build, BLOCK_SCHEMA)


def map_blocks(blocks: DataFrame, schema: str, function: Callable[[Block], tuple]) -> DataFrame:
    """The columns that ``function`` gives for each block, one table after the other."""
    kinds = {"bigint": pa.int64(), "binary": pa.binary()}
    fields = pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in schema.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                columns = function(Block.read({name: batch.column(name)[i].as_buffer() for name in batch.schema.names}))
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=fields)

    return blocks.mapInArrow(run, schema)
