"""Packing documents into sequences along a space-filling curve.

A document's token ids are counted in hashed buckets, the vector is scaled to unit length and
projected to ``AXES`` dimensions by a fixed random matrix. Standardised coordinates become a
cell, the cell's place on a Hilbert curve becomes the document's key, and the documents are
range-sorted by key. Laid end to end in that order they are one stream, cut every ``length``
ids, so neighbours on the curve share a sequence and only the last sequence has padding.

The ids are made once and written, compressed, because both the order and the pieces need
them. Only keys and lengths are sorted; the ids are joined to their places afterwards.

Defined results: a null or empty text is its end id alone; equal texts have equal keys and lie
side by side; repeated rows are rows of their own; a document longer than a sequence runs
over several; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import tokenizers
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import map_batches, per_worker, running_total, with_row_id
from corpusmill.operators.encode import laid_out
from corpusmill.session import materialize

LENGTH = 2048
END_ID = 1
AXES = 3
CELL_BITS = 10
HASHED = 1024
SEED = 97
# Chunks a worker remembers, and the longest chunk worth remembering.
REMEMBERED = 500_000
LONG_CHUNK = 64
# Bytes of text cut into chunks at once.
BLOCK = 1 << 21
# Marks at the end of a chunk, behind an ASCII letter or digit.
CLOSING = re.compile(rb"([.,;:!?](?<=[A-Za-z0-9].)[.,;:!?]*)(?=\s|\Z)")
# A capital that the tokenizer may compose with the mark behind it before it ignores case.
COMPOSED = re.compile(rb"[A-Z][\x80-\xff]")
# Small letters of ASCII and Latin-1: a word that nothing normalises and nothing cuts.
SMALL_LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ"
SMALL_WORD = re.compile(rb"(?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+")


class ChunkEncoder:
    """Token ids of whole texts from those of their chunks between ASCII white space.

    The tokenizer drops white space and never joins anything across it, so a text's ids are
    its chunks' ids one after the other; every distinct chunk is encoded once.
    """

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = tokenizers.Tokenizer.from_str(tokenizer_json)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.model = self.library.model
        cut = self.library.pre_tokenizer
        shown = {c: cut.pre_tokenize_str(c) for c in SMALL_LETTERS} if cut else {}
        self.spelled = {ord(c): parts[0][0] for c, parts in shown.items() if len(parts) == 1}
        # Whole words may go to the model alone if that gives what the library gives.
        probes = [*SMALL_LETTERS, SMALL_LETTERS, "internationalisation", "été", "straße", "the"]
        self.direct = all(self._model_ids(p) == self.library.encode(p, add_special_tokens=False).ids for p in probes)

    def _model_ids(self, word: str) -> list[int]:
        return [token.id for token in self.model.tokenize(word.translate(self.spelled))]

    def _look_up(self, chunks: list[bytes]) -> dict[bytes, bytes]:
        """Remember the short chunks' ids; give back those of the long ones.

        When the memory is half full it becomes the older half, from which chunks that occur again return.
        """
        if len(self.known) > REMEMBERED // 2:
            self.older, self.known = self.known, {}
        new = [c for c in chunks if c not in self.known]
        if self.older:
            again = {c: self.older[c] for c in new if c in self.older}
            self.known.update(again)
            new = [c for c in new if c not in again]
        whole: list[bytes] = []
        rest: list[bytes] = []
        for c in new:
            (whole if self.direct and SMALL_WORD.fullmatch(c) else rest).append(c)
        found = self.library.encode_batch_fast([c.decode() for c in rest], add_special_tokens=False)
        ids = {c: array("I", e.ids).tobytes() for c, e in zip(rest, found)}
        ids.update((c, array("I", self._model_ids(c.decode())).tobytes()) for c in whole)
        long = {c: ids.pop(c) for c in new if len(c) > LONG_CHUNK}
        self.known.update(ids)
        return long

    def ids(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, the end id last; texts are taken together up to a bounded size."""
        group, size = [], 0
        for text in texts:
            raw = text.encode() if text else b""
            group.append(raw)
            size += len(raw)
            if size >= BLOCK:
                yield from self._group(group)
                group, size = [], 0
        yield from self._group(group)

    def _group(self, raws: list[bytes]) -> Iterator[np.ndarray]:
        """Ids of each text: Arrow cuts and numbers the chunks, so that Python looks at every different one only once."""
        chunks = pc.ascii_split_whitespace(pa.array([self._cleaned(raw) for raw in raws], pa.string()))
        coded = chunks.flatten().dictionary_encode()
        names = coded.dictionary.cast(pa.binary()).to_pylist()
        long = self._look_up(names)
        pieces = [long[c] if c in long else self.known[c] for c in names] if long else [self.known[c] for c in names]
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        ids, ends = laid_out(coded.indices.to_numpy(zero_copy_only=False), sizes, np.frombuffer(b"".join(pieces), np.uint32))
        borders = ends[np.append(0, np.cumsum(chunks.value_lengths().to_numpy(zero_copy_only=False)))].tolist()
        end = np.array([END_ID], np.uint32)
        for start, stop in zip(borders, borders[1:]):
            yield np.concatenate((ids[start:stop], end))

    def _cleaned(self, raw: bytes) -> bytes:
        """The text with white space where it may be cut, so that as few chunks differ as is safe.

        The tokenizer ignores case and parts letters and digits from the marks behind them. A
        text that may hold a special token, which is looked for first, is only cut at white space.
        Marks are composed before case is ignored, so a chunk with one behind a capital stays as it is.
        """
        if b"<|" in raw:
            return raw
        cut = CLOSING.sub(rb" \1", raw)
        low = cut.lower()
        if raw.isascii() or not COMPOSED.search(raw):
            return low
        return b" ".join([l if c == l or not COMPOSED.search(c) else c for c, l in zip(cut.split(), low.split())])


def hilbert_key(cells: np.ndarray, bits: int = CELL_BITS) -> np.ndarray:
    """Place of each cell (one row of coordinates) on the Hilbert curve, by the transposition method."""
    x = cells.astype(np.int64).T.copy()
    axes, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(axes):
            inverted = (x[i] & q) != 0
            swap = np.where(inverted, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(inverted, q - 1, swap)
            if i:
                x[i] ^= swap
        q >>= 1
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn, q = np.zeros_like(x[0]), top
    while q > 1:
        turn ^= np.where(x[-1] & q, q - 1, 0)
        q >>= 1
    x ^= turn
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def projected(ids: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    buckets = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)).astype(np.int64)
    vector = np.log1p(np.bincount(buckets, minlength=HASHED))
    return vector / np.sqrt(vector @ vector) @ matrix


def encoded(docs: DataFrame, tokenizer: str) -> DataFrame:
    """``(row_id, doc_id, ids, n, x0, x1, x2)``, written; ``ids`` are compressed 32-bit integers."""
    with open(tokenizer) as file:
        blob = file.read()
    matrix = np.random.default_rng(SEED).standard_normal((HASHED, AXES))
    digest = hashlib.sha256(blob.encode()).hexdigest()

    def start():
        encoder = per_worker(f"chunks-{digest}", lambda: ChunkEncoder(blob))
        squeeze = zstandard.ZstdCompressor(level=1)

        def encode(batch):
            packed, sizes, places = [], [], []
            for ids in encoder.ids(batch.column(1).to_pylist()):
                small = ids.astype(np.uint16) if ids.max() < 1 << 16 else ids
                packed.append(squeeze.compress(small.tobytes()))
                sizes.append(len(ids))
                places.append(projected(ids, matrix))
            return batch.column(0), packed, sizes, *np.array(places).T

        return encode

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    axes = ", ".join(f"x{i} double" for i in range(AXES))
    return materialize(with_row_id(map_batches(rows, f"doc_id bigint, ids binary, n bigint, {axes}", start)), "ids")


def along_curve(rows: DataFrame) -> DataFrame:
    """``(row_id, n, key)``: the Hilbert key of each row's standardised coordinates."""
    names = [f"x{i}" for i in range(AXES)]
    stats = rows.agg(*[f(c).alias(f"{f.__name__}_{c}") for c in names for f in (F.avg, F.stddev_pop)]).first()
    middle = np.array([stats[f"avg_{c}"] or 0.0 for c in names])
    spread = np.array([stats[f"stddev_pop_{c}"] or 1.0 for c in names])

    @F.pandas_udf("bigint")
    def key(x0: pd.Series, x1: pd.Series, x2: pd.Series) -> pd.Series:
        standard = (np.column_stack([x0, x1, x2]) - middle) / spread
        share = 1.0 / (1.0 + np.exp(-1.7 * standard))
        cells = np.minimum((share * (1 << CELL_BITS)).astype(np.int64), (1 << CELL_BITS) - 1)
        return pd.Series(hilbert_key(cells))

    return rows.select("row_id", "n", key(*names).alias("key"))


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, keep_ids: bool = True) -> DataFrame:
    """``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids)``, one row per piece.

    Without ``keep_ids`` the pieces' ids, ``ids``, stay out of the result.
    """
    rows = encoded(docs, tokenizer)
    places = running_total(along_curve(rows), ["key", "row_id"], "n").select("row_id", "before")
    placed = rows.select("row_id", "doc_id", "ids", "n").join(places, "row_id").select("doc_id", "ids", "n", "before")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, raw, n, before in zip(*(batch.column(i).to_pylist() for i in range(4))):
                data = expand.decompress(raw)
                ids = np.frombuffer(data, np.uint16 if len(data) == 2 * n else np.uint32).astype("<u4")
                start = 0
                while start < n:
                    offset = (before + start) % length
                    size = min(length - offset, n - start)
                    piece = ids[start : start + size]
                    out.append((doc_id, start, size, zlib.crc32(piece.tobytes()), n, (before + start) // length, offset, piece)[:width])
                    start += size
            if out:
                kinds = ([pa.int64()] * 7 + [pa.list_(pa.int32())])[:width]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)

    schema = ("doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, "
              "offset bigint" + (", ids array<int>" if keep_ids else ""))
    names = [part.split()[0] for part in schema.split(", ")]
    width = len(names)
    return placed.mapInArrow(cut, schema)
