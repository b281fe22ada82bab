"""Encoding, decoding and token-length profiles."""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusmill.constants import BLOCK_SIZE, UNKNOWN_ID
from corpusmill.functions.text import pretokenize
from corpusmill.operators.skew import fits_broadcast
from corpusmill.session import materialize, write_table
from corpusmill.sources.tokenizer_store import Tokenizer

# Words whose ids one task remembers; the memory is emptied when full.
REMEMBERED_WORDS = 1 << 18
# Words that are laid out together, which bounds a task's memory however long its batches are.
PART_WORDS = 1 << 18
GONE = -1


def merge_word(symbols: list[int], ranks: dict[tuple[int, int], int], merged: list[int]) -> list[int]:
    """Ids of one word: keep merging the adjacent pair that was learned first, the leftmost of equal ones.

    Pairs wait in a heap and symbols are linked by position, so a long word takes n log n steps.
    """
    symbols = list(symbols)
    after = [*range(1, len(symbols)), -1]
    before = list(range(-1, len(symbols) - 1))
    waiting = [(rank, i) for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := ranks.get(pair)) is not None]
    heapq.heapify(waiting)
    while waiting:
        rank, i = heapq.heappop(waiting)
        j = after[i]
        # An entry is stale if one of its symbols has been merged since.
        if symbols[i] < 0 or j < 0 or ranks.get((symbols[i], symbols[j])) != rank:
            continue
        symbols[i], symbols[j] = merged[rank], GONE
        after[i] = after[j]
        if after[i] >= 0:
            before[after[i]] = i
        for left, right in ((before[i], i), (i, after[i])):
            if left >= 0 and right >= 0 and (found := ranks.get((symbols[left], symbols[right]))) is not None:
                heapq.heappush(waiting, (found, left))
    return [s for s in symbols if s != GONE]


def word_encoder(tokenizer: Tokenizer) -> Callable[[str], list[int]]:
    """The ids of one word. The vocabulary and the merges travel with the function; both are bounded by the vocabulary size."""
    ids = {token: i for i, token in enumerate(tokenizer.vocab)}
    ranks = {(ids[l], ids[r]): rank for rank, (l, r) in enumerate(tokenizer.merges)}
    merged = [ids[l + r] for l, r in tokenizer.merges]
    whole = {token: [ids[token]] for token in tokenizer.specials}

    def encode_word(word: str) -> list[int]:
        if word in whole:
            return whole[word]
        return merge_word([ids.get(ch, UNKNOWN_ID) for ch in word], ranks, merged)

    return encode_word


def piece_encoder(tokenizer: Tokenizer) -> Callable[[Column], Column]:
    """Column function from ``ARRAY<STRING>`` pieces to ``ARRAY<INT>`` ids.

    Row-local: documents are never shuffled. A task encodes each distinct word of a part of an
    Arrow batch once and lays the ids out with array arithmetic, one part after the other.
    """
    encode_word = word_encoder(tokenizer)

    @F.arrow_udf("array<int>")
    def encode_pieces(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        remembered: dict[str, list[int]] = {}

        def encoded(part: pa.Array) -> pa.Array:
            if len(remembered) > REMEMBERED_WORDS:
                remembered.clear()
            words = part.flatten().dictionary_encode()
            pieces = []
            for word in words.dictionary.to_pylist():
                piece = remembered.get(word)
                if piece is None:
                    piece = remembered[word] = encode_word(word)
                pieces.append(piece)
            ids, ends = laid_out(words.indices.to_numpy(zero_copy_only=False), *_flat(pieces))
            return rows_of(part, ids, ends)

        for batch in batches:
            yield pa.concat_arrays([encoded(batch.slice(start, size)) for start, size in list_parts(batch)])

    return encode_pieces


def list_parts(lists: pa.Array, size: int | None = None) -> Iterator[tuple[int, int]]:
    """Start and number of the rows of each part: rows in order with ``size`` entries at most, or a single row."""
    ends, start = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64), 0
    while True:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + (size or PART_WORDS), side="right")))
        yield start, min(stop, len(lists)) - start
        start = stop
        if start >= len(lists):
            return


def _flat(pieces: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of the pieces, and all of them one after the other."""
    sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
    return sizes, np.fromiter((i for piece in pieces for i in piece), np.int32, int(sizes.sum()))


def laid_out(
    word_of: np.ndarray, sizes: np.ndarray, flat: np.ndarray, starts: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The ids of a sequence of words, given by number, and where each of them ends, from 0.

    ``starts`` says where a word's ids begin in ``flat``, if they do not stand there in order.
    """
    if starts is None:
        starts = np.cumsum(sizes) - sizes
    word_sizes = sizes[word_of]
    ends = np.concatenate(([0], np.cumsum(word_sizes)))
    source = np.arange(ends[-1]) + np.repeat(starts[word_of] - ends[:-1], word_sizes)
    return flat[source], ends


def rows_of(words: pa.Array, ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The ids of each row of the list array ``words``, keeping row borders and nulls."""
    row_sizes = words.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    row_ends = ends[np.concatenate(([0], np.cumsum(row_sizes)))]
    valid = words.is_valid().to_numpy(zero_copy_only=False)
    offsets = pa.array(row_ends.astype(np.int32), mask=np.append(~valid, False))
    return pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))


def encode(df: DataFrame, tokenizer: Tokenizer, text: str = "text", out: str = "input_ids") -> DataFrame:
    """Add the token ids of ``text``. Works on batch and streaming tables alike."""
    return df.withColumn(out, piece_encoder(tokenizer)(pretokenize(text, keep_specials=True)))


def word_pieces(words: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``(word, n, ids)``: the dictionary of distinct words, each encoded once."""
    return words.withColumn("ids", piece_encoder(tokenizer)(F.array("word")))


def encode_by_dictionary(
    df: DataFrame, words: DataFrame, tokenizer: Tokenizer, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``(key, input_ids)`` by joining the words of the documents with the word dictionary.

    Documents are taken in parts of up to ``PART_WORDS`` words, written as numbers into the part's
    list of distinct words. A word is joined once for each part it occurs in, which also bounds
    how often a frequent word is, and the found ids go back to their part. Words the dictionary
    lacks, such as special tokens, are encoded there. Rows that share a key become one, their words
    in the order of their places. Prefer :func:`encode` unless the dictionary exists anyway: this
    form moves the ids of every document.
    """
    parts = materialize(_coded(df.select(key, pretokenize(text, keep_specials=True).alias("words")), key)
                        .withColumn("part", F.monotonically_increasing_id()), "coded")
    dictionary = write_table(word_pieces(words, tokenizer).select("word", "ids"), "pieces")
    asked = parts.select("part", F.posexplode("words").alias("number", "word"))
    joined = asked.join(F.broadcast(dictionary.df) if fits_broadcast(dictionary) else dictionary.df, "word")
    found = joined.groupBy("part").agg(F.collect_list(F.struct("number", "ids")).alias("found"))
    rows = _put_back(parts.join(found, "part", "left"), key, word_encoder(tokenizer))

    @F.arrow_udf("array<int>")
    def interleave(repeated: pa.Array) -> pa.Array:
        return pa.array([rows and _interleaved(rows) for rows in repeated.to_pylist()], pa.list_(pa.int32()))

    placed = rows.groupBy(key).agg(F.collect_list(F.struct("ids", "sizes")).alias("rows"))
    several = interleave(F.when(F.size("rows") > 1, F.col("rows")))
    return placed.select(key, F.coalesce(several, F.col("rows")[0]["ids"]).alias("input_ids"))


def _interleaved(rows: list[dict]) -> list[int]:
    """The words of several rows in the order of their places, equal places in the order of their ids."""
    placed = []
    for row in rows:
        ends = np.cumsum(row["sizes"], dtype=np.int64).tolist()
        placed += [(place, row["ids"][start:end]) for place, (start, end) in enumerate(zip([0, *ends], ends))]
    return [i for _, ids in sorted(placed) for i in ids]


def _coded(rows: DataFrame, key: str) -> DataFrame:
    """``(keys, sizes, numbers, words)``: one row per part, with the words of its rows as numbers into ``words``."""
    schema = T.StructType([
        T.StructField("keys", T.ArrayType(rows.schema[key].dataType)), T.StructField("sizes", T.ArrayType(T.IntegerType())),
        T.StructField("numbers", T.BinaryType()), T.StructField("words", T.ArrayType(T.StringType()))])

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for start, size in list_parts(batch.column(1)) if batch.num_rows else ():
                words = batch.column(1).slice(start, size)
                coded = words.flatten().dictionary_encode()
                lists = [batch.column(0).slice(start, size), words.value_lengths().fill_null(0), coded.dictionary]
                keys, sizes, distinct = (pa.ListArray.from_arrays([0, len(x)], x) for x in lists)
                numbers = pa.array([coded.indices.to_numpy(zero_copy_only=False).astype("<i4").tobytes()], pa.binary())
                columns = [keys, sizes, numbers, distinct]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.mapInArrow(code, schema)


def _put_back(parts: DataFrame, key: str, encode_word: Callable[[str], list[int]]) -> DataFrame:
    """``(key, ids, sizes)``: the rows of the parts with the ids of their words, and how many each word has."""
    kind = parts.schema["keys"].dataType.elementType
    schema = T.StructType([
        T.StructField(key, kind), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("sizes", T.ArrayType(T.IntegerType()))])

    def put_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                keys, row_sizes, words, found = (batch.column(name)[i].values for name in ("keys", "sizes", "words", "found"))
                sizes, flat = np.full(len(words), -1, np.int64), [np.empty(0, np.int32)]
                starts = np.zeros(len(words), np.int64)
                if found is not None:
                    number, ids = (found.field(j) for j in (0, 1))
                    number = number.to_numpy(zero_copy_only=False)
                    sizes[number] = ids.value_lengths().to_numpy(zero_copy_only=False)
                    starts[number] = np.cumsum(sizes[number]) - sizes[number]
                    flat.append(ids.flatten().to_numpy(zero_copy_only=False))
                lacking = np.flatnonzero(sizes < 0)
                own, rest = _flat([encode_word(words[j].as_py()) for j in lacking.tolist()])
                sizes[lacking], starts[lacking] = own, sum(map(len, flat)) + np.cumsum(own) - own
                word_of = np.frombuffer(batch.column("numbers")[i].as_buffer(), "<i4")
                ids, ends = laid_out(word_of, sizes, np.concatenate([*flat, rest]), starts)
                row_ends = np.concatenate(([0], np.cumsum(row_sizes.to_numpy(zero_copy_only=False)))).astype(np.int32)
                columns = [
                    keys, pa.ListArray.from_arrays(pa.array(ends[row_ends], pa.int32()), pa.array(ids, pa.int32())),
                    pa.ListArray.from_arrays(pa.array(row_ends), pa.array(sizes[word_of], pa.int32()))]
                yield pa.record_batch([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return parts.select("keys", "sizes", "numbers", "words", "found").mapInArrow(put_back, schema)


def token_usage(words: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """``(token_id, token, n)``: how often each token occurs, from the dictionary alone."""
    spark = words.sparkSession
    # The outer form keeps Spark from adding a filter that would encode every word twice.
    pieces = word_pieces(words, tokenizer).select(F.explode_outer("ids").alias("token_id"), "n")
    used = pieces.where(F.col("token_id").isNotNull()).groupBy("token_id").agg(F.sum("n").alias("n"))
    # The vocabulary table has exactly ``vocab_size`` rows, a parameter of the training.
    return used.join(F.broadcast(tokenizer.vocab_table(spark)), "token_id").select("token_id", "token", "n")


def decode(ids, tokenizer: Tokenizer) -> Column:
    """Tokens joined by one blank, special tokens left out."""
    ids = F.col(ids) if isinstance(ids, str) else ids
    # Tokens hold no white space, so one blank-separated literal carries the vocabulary.
    tokens = F.split(F.lit(" ".join(tokenizer.vocab)), " ")
    plain = F.filter(ids, lambda i: i >= len(tokenizer.specials))
    return F.array_join(F.transform(plain, lambda i: F.get(tokens, i)), " ")


def exact_quantile(counts: DataFrame, value: str, q: float, by: Sequence[str], n: str = "n") -> DataFrame:
    """``(*by, quantile)``: the smallest value with at least the share ``q`` of a group's rows at or below it.

    ``counts (*by, value, n)`` is a histogram; the running sum sees one row per distinct value.
    """
    group = Window.partitionBy(*by)
    reached = F.sum(n).over(group.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumn("_reached", reached).withColumn("_total", F.sum(n).over(group))
    return placed.where(F.col("_reached") >= F.col("_total") * F.lit(q)).groupBy(*by).agg(F.min(value).alias("quantile"))


def length_stats(df: DataFrame, tokens: str = "input_ids", n: int = BLOCK_SIZE, by: str = "split") -> DataFrame:
    """Unpadded lengths per group: mean, median, maximum, rows cut at ``n``, share of padding.

    Everything comes exactly from the histogram of lengths, which has at most as many rows as the
    longest row has tokens; a null row has no length.
    """
    size = F.when(F.col(tokens).isNotNull(), F.size(tokens))
    counts = materialize(df.select(by, size.alias("size")).groupBy(by, "size").agg(F.count(F.lit(1)).alias("n")), "lengths")
    medians = exact_quantile(counts.where("size is not null"), "size", 0.5, [by]).select(by, F.col("quantile").alias("median_tokens"))
    length, rows = F.col("size").cast("bigint"), F.col("n")
    known = F.when(F.col("size").isNotNull(), rows)
    stats = counts.groupBy(by).agg(
        F.sum(rows).alias("n_rows"),
        (F.sum(length * rows) / F.sum(known)).alias("mean_tokens"),
        F.max("size").alias("max_tokens"),
        F.coalesce(F.sum(F.when(F.col("size") > n, rows)), F.lit(0)).alias("n_truncated"),
        (F.sum(F.greatest(F.lit(0), n - length) * rows) / (F.sum(known) * n)).alias("pad_share"),
    )
    # One row per group on either side; a group may be null.
    joined = stats.alias("s").join(medians.alias("m"), F.col(f"s.{by}").eqNullSafe(F.col(f"m.{by}")), "left")
    return joined.select(f"s.{by}", "n_rows", "mean_tokens", "median_tokens", "max_tokens", "n_truncated", "pad_share")
