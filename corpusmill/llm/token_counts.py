"""Exact token counts of every prefix of a text by dynamic programming over prefixes.

A byte-pair encoding is determined by its neighbours: a sequence of pieces is the encoding of
its text exactly if every two neighbouring pieces stay apart when encoded together. The last
piece of a prefix's encoding is therefore the one piece that ends there and stays apart from
the last piece of the shorter prefix in front of it, and the count grows by one. One pass
over a text gives the count of each prefix; truncation and budget questions are lookups.

Defined results: a null or empty text has 0 tokens; a character outside the vocabulary counts
one token per UTF-8 byte; any other columns of the input are ignored; repeated rows stay.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_batches

SPACE = "▁"
# Words, and pairs of pieces, that a task remembers; beyond that it forgets all and goes on.
REMEMBERED = 600_000
# Longer words are not remembered.
LONG_WORD = 48


class Pieces:
    """Vocabulary of a model and the question whether two neighbouring pieces stay apart."""

    def __init__(self, model: bytes):
        library = sentencepiece.SentencePieceProcessor(model_proto=model)
        ids = [i for i in range(library.get_piece_size())
               if not (library.is_control(i) or library.is_unknown(i) or library.is_byte(i) or library.is_unused(i))]
        self.score = {library.id_to_piece(i): library.get_score(i) for i in ids}
        self.tails = {piece[i:] for piece in self.score for i in range(len(piece))}
        self.joining = {c for piece in self.score if len(piece) > 1 for c in piece}
        self.splits: dict[str, tuple[str, str] | None] = {}
        self.spines: dict[tuple[str, bool], list[tuple[str, float]]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}
        inner = any(SPACE in piece.lstrip(SPACE) for piece in self.score)
        alone = "".join(re.escape(c) for c in "\n\t\r" if c not in self.joining)
        solo = f"|[{alone}]" if alone else ""
        # Pieces never continue over a space that follows another character, so words are independent.
        self.words = re.compile(r"(?s).+" if inner else f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+{solo}").findall

    def split(self, piece: str) -> tuple[str, str] | None:
        """The two pieces that the last merge joins to ``piece``; None if merging never makes it."""
        if piece not in self.splits:
            parts, last = list(piece), None
            while len(parts) > 1:
                made = [(-self.score[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.score]
                if not made:
                    break
                i = min(made)[1]
                last = (parts[i], parts[i + 1])
                parts[i : i + 2] = ["".join(last)]
            self.splits[piece] = last if len(parts) == 1 else None
        return self.splits[piece]

    def spine(self, piece: str, right: bool) -> list[tuple[str, float]]:
        """Pieces at one end of ``piece`` while it is merged, smallest first, with the score that ends each."""
        key = (piece, right)
        if key not in self.spines:
            chain, end, node = [], -np.inf, piece
            while node is not None:
                chain.append((node, end))
                end = self.score.get(node, -np.inf)
                children = self.split(node) if len(node) > 1 else None
                node = children[right] if children else None
            self.spines[key] = chain[::-1]
        return self.spines[key]

    def apart(self, left: str, right: str) -> bool:
        """Whether encoding ``left + right`` gives these two pieces: no merge across comes first.

        An empty ``left`` asks whether encoding ``right`` gives this one piece.
        """
        if len(self.pairs) >= REMEMBERED:
            self.pairs.clear()
        fits = len(right) == 1 or self.split(right) is not None
        if fits and left:
            fits = self._apart(self.spine(left, True), self.spine(right, False))
        self.pairs[left, right] = fits
        return fits

    def _apart(self, lefts, rights) -> bool:
        i = j = 0
        while True:
            (a, a_end), (b, b_end) = lefts[i], rights[j]
            across = self.score.get(a + b)
            # Equal scores merge from the left: inside the left piece first, across before the right piece.
            if across is not None and across > a_end and across >= b_end:
                return False
            if i + 1 == len(lefts) and j + 1 == len(rights):
                return True
            if j + 1 == len(rights) or (i + 1 < len(lefts) and a_end >= b_end):
                i += 1
            else:
                j += 1


class PrefixCounter:
    """Token counts of all prefixes of texts, under one model."""

    def __init__(self, model: bytes):
        self.pieces = Pieces(model)
        self.tables: dict[str, bytes] = {}

    def _table(self, word: str) -> bytes:
        """Counts of the prefixes of one word, each from the state of one shorter prefix."""
        pieces = self.pieces
        score, tails, pairs, apart = pieces.score, pieces.tails, pieces.pairs, pieces.apart
        lasts, counts = [""], [0]
        for end in range(1, len(word) + 1):
            for start in range(end - 1, -1, -1):
                piece = word[start:end]
                if piece not in tails:
                    break
                if piece in score:
                    key = (lasts[start], piece)
                    fits = pairs.get(key)
                    if apart(*key) if fits is None else fits:
                        lasts.append(piece)
                        counts.append(counts[start] + 1)
                        break
            if len(lasts) == end:
                # A character outside the vocabulary: one token per byte, never merged.
                lasts.append("")
                counts.append(counts[-1] + len(word[end - 1].encode()))
        return array("I", counts[1:]).tobytes()

    def prefixes(self, text: str | None) -> np.ndarray:
        """``counts[k]``: tokens of ``text[:k]``, for k from 0 to the length of the text."""
        if not text:
            return np.zeros(1, np.int64)
        words = self.pieces.words(SPACE + text.replace(" ", SPACE))
        tables, parts = self.tables, []
        for word in words:
            table = tables.get(word)
            if table is None:
                table = self._table(word)
                if len(word) <= LONG_WORD:
                    if len(tables) > REMEMBERED:
                        tables.clear()
                    tables[word] = table
            parts.append(table)
        counts = np.frombuffer(b"".join(parts), np.uint32)
        lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
        totals = counts[np.cumsum(lengths) - 1].astype(np.int64)
        counts = counts + np.repeat(np.cumsum(totals) - totals, lengths)
        counts[0] = 0
        return counts


def longest_within(counts: np.ndarray, budget: int) -> int:
    """Characters of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(counts <= budget)[-1])


def read_model(path: str) -> bytes:
    with open(path, "rb") as file:
        return file.read()


def prefix_counts(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, counts array<int>)``: the token count of every prefix of each text."""
    blob = read_model(model)

    def start():
        counter = PrefixCounter(blob)
        return lambda batch: (batch.column(0), [counter.prefixes(t) for t in batch.column(1).to_pylist()])

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, "doc_id bigint, counts array<int>", start)


def token_budget(
    docs: DataFrame, model: str, limit: int, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit, fit_chars)`` of every whole text.

    ``n_tokens`` is the prefix table's last entry; ``fit_chars`` is the length of the longest
    prefix within ``limit`` tokens, read from the same table without encoding again. The model
    file is read by the driver and travels with the job.
    """
    blob = read_model(model)

    def start():
        counter = PrefixCounter(blob)

        def answer(batch):
            texts = batch.column(1).to_pylist()
            n_tokens, over, fits = [], [], []
            for text in texts:
                counts = counter.prefixes(text)
                total = int(counts[-1])
                n_tokens.append(total)
                over.append(total > limit)
                fits.append(len(counts) - 1 if total <= limit else longest_within(counts, limit))
            return batch.column(0), [len(t.encode()) if t else 0 for t in texts], n_tokens, over, fits

        return answer

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean, fit_chars bigint"
    return map_batches(rows, schema, start)
