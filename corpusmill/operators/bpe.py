"""Byte-pair vocabulary learning in exact batched rounds.

A word is held as one string in which every symbol stands between two blanks, for example
`` 104  105 `` for two symbols. Words contain no white space, so merging the pair (l, r) is
the plain string replacement of `` l  r `` by `` m ``: left to right, without overlaps.
A symbol is a number: the code point of a character, or ``FIRST_MERGED + k`` for the k-th
merged token. Numeric order of symbols therefore equals the order of token ids.
"""

from __future__ import annotations

import heapq
import json
import math
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.constants import MIN_FREQUENCY, SPECIAL_TOKENS, VOCAB_SIZE
from corpusmill.operators.bpe_blocks import BLOCK_SCHEMA, Merge, make_blocks, map_blocks, pair_code
from corpusmill.operators.words import alphabet
from corpusmill.session import delete_scratch, write_scratch
from corpusmill.sources.tokenizer_store import Tokenizer

FIRST_MERGED = 0x110000
# Pairs whose counts the driver holds after a count of all, and pairs looked at in one round.
PAIRS_HELD = 1 << 16
PAIRS_PER_ROUND = 1024
# Merges tried ahead in one round: a few more than the last round confirmed, up to a limit.
MERGES_AHEAD = 64
MORE_AHEAD = 8
# Merges that wait before the blocks are written again: few at first, as the first ones change most
# words and every round takes the waiting ones again; later more, up to a limit.
MERGES_PER_WRITE = 96
LEAST_PER_WRITE = 8
WORDS_PER_TASK = 10_000


def symbols_of(word) -> Column:
    """Character symbols of a word in the blank-delimited form."""
    word = F.col(word) if isinstance(word, str) else word
    wrapped = F.transform(F.split(word, ""), lambda ch: F.concat(F.lit(" "), F.ascii(ch), F.lit(" ")))
    return F.array_join(wrapped, "")


def symbol_words(words: DataFrame) -> DataFrame:
    """``(symbols, n)`` for the words that hold at least one pair."""
    return words.where(F.length("word") > 1).select(symbols_of("word").alias("symbols"), "n")


def _adjacent(symbols: DataFrame, *keep: str) -> DataFrame:
    """``(*keep, l, r)``: one row per adjacent symbol pair of each word."""
    pieces = symbols.select(*keep, F.split(F.btrim("symbols"), "  ").cast("array<int>").alias("s"))
    last = F.size("s") - 1
    zipped = F.arrays_zip(F.slice("s", F.lit(1), last).alias("l"), F.slice("s", F.lit(2), last).alias("r"))
    # The outer form keeps Spark from adding a filter that would split every word twice.
    return pieces.select(*keep, F.inline_outer(zipped)).toDF(*keep, "l", "r").where(F.col("l").isNotNull())


def pair_counts(symbols: DataFrame) -> DataFrame:
    """``(l, r, c)``: how often symbol ``r`` follows ``l``, weighted by the word count."""
    return _adjacent(symbols, "n").groupBy("l", "r").agg(F.sum("n").alias("c"))


def best_pairs(pairs: DataFrame, k: int = 1) -> DataFrame:
    """The ``k`` most frequent pairs; equal counts in order of the left, then the right symbol."""
    return pairs.orderBy(F.desc("c"), "l", "r").limit(k)


def _merge_steps(merges: Sequence[Merge]) -> Column:
    steps = [{"step": i, "pair": f" {l}  {r} ", "merged": f" {m} "} for i, (l, r, m) in enumerate(merges, 1)]
    return F.from_json(F.lit(json.dumps(steps)), "array<struct<step:int,pair:string,merged:string>>")


def apply_merges(symbols, merges: Sequence[Merge]) -> Column:
    """Symbols after the merges ``(l, r, merged)``, applied one after the other."""
    symbols = F.col(symbols) if isinstance(symbols, str) else symbols
    return F.aggregate(_merge_steps(merges), symbols, lambda acc, step: F.replace(acc, step["pair"], step["merged"]))


def independent_prefix(
    pairs: Iterable[tuple[int, int, int]], spell: dict[int, str], known: set[str], room: int, min_count: int
) -> list[tuple[int, int]]:
    """Longest run of best pairs that merging one at a time would also take, in this order.

    A merge (a, b) only lowers counts of pairs that end in ``a`` or start with ``b``; a new
    pair is never more frequent than the pair it came from. So pairs are taken until one
    starts where an earlier one ends or the reverse. A doubled symbol is taken alone, and a
    merge that spells an existing token closes the run, because that token's pairs may gain.
    """
    batch: list[tuple[int, int]] = []
    lefts: set[int] = set()
    rights: set[int] = set()
    spelled: set[str] = set()
    for l, r, count in pairs:
        if count < min_count or l in rights or r in lefts or len(spelled) >= room:
            break
        if l == r:
            if not batch:
                batch.append((l, r))
            break
        batch.append((l, r))
        lefts.add(l)
        rights.add(r)
        text = spell[l] + spell[r]
        if text in known or text in spelled:
            break
        spelled.add(text)
    return batch


@dataclass
class Vocabulary:
    """Tokens learned so far, and the symbols that stand for them in the word table."""

    tokens: list[str]
    symbol: dict[str, int]
    spell: dict[int, str]
    merges: list[tuple[str, str]]
    learned: int = 0
    # The symbol that the last merge made, if its spelling was new.
    made: int | None = None

    @classmethod
    def start(cls, specials: Sequence[str], chars: Sequence[str]) -> Vocabulary:
        symbol = {token: i - len(specials) for i, token in enumerate(specials)} | {ch: ord(ch) for ch in chars}
        return cls([*specials, *chars], symbol, {s: token for token, s in symbol.items()}, [])

    def copy(self) -> Vocabulary:
        return Vocabulary(list(self.tokens), dict(self.symbol), dict(self.spell), list(self.merges), self.learned)

    def learn(self, l: int, r: int) -> Merge:
        """Record a merge; a spelling that exists already keeps its symbol and id."""
        text = self.spell[l] + self.spell[r]
        self.merges.append((self.spell[l], self.spell[r]))
        self.made = None
        if text not in self.symbol:
            self.symbol[text] = self.made = FIRST_MERGED + self.learned
            self.spell[self.made] = text
            self.tokens.append(text)
            self.learned += 1
        return l, r, self.symbol[text]


class PairCounts:
    """Counts of the pairs that may be best, held by the driver and kept exact through merges.

    Only the ``PAIRS_HELD`` best pairs of a count are held, and every pair that a merge makes.
    A pair that is not held ranks behind the last one of that count: it can only lose, unless a
    merge spells an existing token and so adds to its pairs; what such a pair may have
    reached at most is ``unsure``. A pair in front of all this is certain.
    """

    def __init__(self, codes: Iterable[int], counts: Iterable[int], whole: bool):
        self.count = dict(zip(codes, counts))
        self.heap = [(-c, code) for code, c in self.count.items()]
        self.border = None if whole else max(self.heap)
        heapq.heapify(self.heap)
        self.gains: dict[int, int] = {}
        self.unsure = 0

    def best(self) -> int | None:
        while self.heap and self.count[self.heap[0][1]] != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return self.heap[0][1] if self.heap else None

    def ranked(self, k: int) -> list[tuple[int, int]]:
        """The ``k`` best pairs and their counts."""
        found = []
        while len(found) < k and (code := self.best()) is not None:
            found.append((code, self.count[code]))
            while self.heap and self.heap[0] == (-self.count[code], code):
                heapq.heappop(self.heap)
        for code, count in found:
            heapq.heappush(self.heap, (-count, code))
        return found

    def certain(self, code: int, min_count: int) -> bool:
        count = self.count[code]
        known = self.border is None or ((-count, code) <= self.border and count > self.unsure)
        return count >= min_count and known

    def change(self, code: int, difference: int, made: int | None) -> None:
        """Add a difference; ``made`` is the symbol that the merge has made, if it is a new one."""
        count = self.count.get(code)
        if count is None:
            if difference <= 0:
                return
            if self.border is not None and made not in (code >> 32, code & 0xFFFFFFFF):
                self.gains[code] = self.gains.get(code, -self.border[0]) + difference
                self.unsure = max(self.unsure, self.gains[code])
                return
            count = 0
        self.count[code] = count + difference
        if count + difference > 0:
            heapq.heappush(self.heap, (-count - difference, code))


def predict_merges(counts: dict[tuple[int, int], float], vocabulary: Vocabulary, ahead: int) -> list[Merge]:
    """Likely next merges. A wrong guess costs time only, the next round checks every one."""
    counts, draft, predicted = dict(counts), vocabulary.copy(), []
    for _ in range(ahead):
        best = min(counts, key=lambda pair: (-counts[pair], pair), default=None)
        if best is None or counts[best] <= 0:
            break
        predicted.append(draft.learn(*best))
        _move_counts(counts, predicted[-1])
    return predicted


def _move_counts(counts: dict[tuple[int, int], float], merge: Merge) -> None:
    """Guess the counts after a merge, as if the neighbours of a pair were independent of it."""
    l, r, merged = merge
    count = counts.pop((l, r))
    if count <= 0:
        return
    before_r = count + sum(c for (_, y), c in counts.items() if y == r)
    after_l = count + sum(c for (x, _), c in counts.items() if x == l)
    for (x, y), c in list(counts.items()):
        if x == r:
            moved, target = c * count / before_r, (merged, y)
        elif y == l:
            moved, target = c * count / after_l, (x, merged)
        else:
            continue
        counts[x, y] -= moved
        counts[target] = counts.get(target, 0) + moved


def train_bpe(
    words: DataFrame,
    vocab_size: int = VOCAB_SIZE,
    specials: Sequence[str] = SPECIAL_TOKENS,
    min_frequency: int = MIN_FREQUENCY,
) -> Tokenizer:
    """Learn merges from a word table ``(word, n)``, best a written one: it is read three times.

    The words are written once as blocks with an index from pairs to words. The driver holds
    the counts of the best pairs. A round tries a run of merges, those that are certain and a
    few predicted ones behind them, on the words of the merged pairs alone, and brings back
    how each step changes the counts. A predicted merge is kept while it is the best pair of
    the exact counts in front of it; behind the last one the independent run of best pairs
    is certain for the next round. Kept merges wait until the blocks are written again. All
    pairs are counted at the start and when the held ones no longer decide.
    """
    # The alphabet is bounded by Unicode, the merge list by ``vocab_size``.
    chars = [row.ch for row in alphabet(words, len(specials)).orderBy("token_id").collect()]
    vocabulary = Vocabulary.start(specials, chars)
    blocks = WrittenBlocks(words)
    learn_merges(blocks, vocabulary, vocab_size, max(1, min_frequency))
    blocks.delete()
    return Tokenizer(tuple(vocabulary.tokens), tuple(vocabulary.merges), tuple(specials))


class WrittenBlocks:
    """The words as blocks in a written table, and the jobs that run on them."""

    def __init__(self, words: DataFrame):
        self.spark = words.sparkSession
        most = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        self._write(make_blocks(words, max(1, min(most, math.ceil(words.count() / WORDS_PER_TASK)))))

    def _write(self, blocks: DataFrame) -> None:
        self.path = write_scratch(blocks, "blocks")
        self.table = self.spark.read.schema(BLOCK_SCHEMA).parquet(self.path)

    def delete(self) -> None:
        delete_scratch(self.spark, self.path)

    def merge(self, pending: Sequence[Merge]) -> None:
        """Write the blocks again, after the merges."""
        previous = self.path
        self._write(map_blocks(self.table, BLOCK_SCHEMA, lambda block: tuple([value] for value in block.after(pending).row())))
        delete_scratch(self.spark, previous)

    def changes(self, pending: Sequence[Merge], steps: Sequence[Merge]) -> list[list[tuple[int, int]]]:
        """For every step the pairs whose count it changes, and by how much.

        A step changes pairs with the neighbours of its two symbols, so at most as many rows
        reach the driver as there are symbols, for each of the few steps.
        """
        parts = map_blocks(self.table, "step bigint, code bigint, w bigint", lambda block: block.changes(pending, steps))
        table = parts.groupBy("step", "code").agg(F.sum("w").alias("w")).where("w <> 0").toArrow()
        found: list[list[tuple[int, int]]] = [[] for _ in steps]
        for step, code, w in zip(*(table.column(name).to_pylist() for name in ("step", "code", "w"))):
            found[step].append((code, w))
        return found

    def counts(self, pending: Sequence[Merge]) -> PairCounts:
        """The best pairs of a count of all."""
        parts = map_blocks(self.table, "code bigint, c bigint", lambda block: block.pair_counts(pending))
        counts = parts.groupBy("code").agg(F.sum("c").alias("c"))
        table = counts.orderBy(F.desc("c"), "code").limit(PAIRS_HELD).toArrow()
        return PairCounts(table.column("code").to_pylist(), table.column("c").to_pylist(), table.num_rows < PAIRS_HELD)


def learn_merges(blocks: WrittenBlocks, vocabulary: Vocabulary, vocab_size: int, min_count: int) -> None:
    """Add merges to the vocabulary until it is full or no pair is left."""
    pending: list[Merge] = []
    sure: list[tuple[Merge, int | None]] = []
    counts: PairCounts | None = None
    ahead = MORE_AHEAD
    while len(vocabulary.tokens) < vocab_size:
        counted = counts is None
        if counts is None:
            pending, sure = pending + [merge for merge, _ in sure], []
            counts = blocks.counts(pending)
        else:
            confirmed = _confirm(blocks, pending, sure, counts, vocabulary, vocab_size, min_count, ahead)
            ahead = min(MERGES_AHEAD, confirmed + MORE_AHEAD)
        ranked = []
        for code, count in counts.ranked(PAIRS_PER_ROUND):
            if not counts.certain(code, min_count):
                break
            ranked.append((code >> 32, code & 0xFFFFFFFF, count))
        room = vocab_size - len(vocabulary.tokens)
        batch = independent_prefix(ranked, vocabulary.spell, set(vocabulary.symbol), room, min_count)
        sure = [(vocabulary.learn(l, r), vocabulary.made) for l, r in batch]
        if not sure and len(vocabulary.tokens) < vocab_size:
            if counted:
                break
            counts = None
        if len(pending) >= min(MERGES_PER_WRITE, LEAST_PER_WRITE + len(vocabulary.merges) // 16):
            blocks.merge(pending)
            pending = []


def _confirm(
    blocks: WrittenBlocks, pending: list[Merge], sure: list[tuple[Merge, int | None]], counts: PairCounts,
    vocabulary: Vocabulary, vocab_size: int, min_count: int, ahead: int,
) -> int:
    """Try the sure merges and predicted ones; add what holds to ``counts`` and ``pending``. Predictions kept."""
    likely = {(code >> 32, code & 0xFFFFFFFF): count for code, count in counts.ranked(PAIRS_PER_ROUND)}
    for merge, _ in sure:
        _move_counts(likely, merge)
    steps = [*(merge for merge, _ in sure), *predict_merges(likely, vocabulary, ahead)]
    changes = blocks.changes(list(pending), steps)
    for step, merge in enumerate(steps):
        if step < len(sure):
            made = sure[step][1]
        else:
            best = counts.best()
            right = best is not None and best == pair_code(*merge[:2]) and counts.certain(best, min_count)
            if not right or len(vocabulary.tokens) >= vocab_size:
                return step - len(sure)
            vocabulary.learn(*merge[:2])
            made = vocabulary.made
        for code, difference in changes[step]:
            counts.change(code, difference, made)
        pending.append(merge)
    return len(steps) - len(sure)
