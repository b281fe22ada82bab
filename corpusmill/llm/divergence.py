"""Divergence of sources within a language, from term counts by sorted pointers.

Terms are runs of letters: ASCII letters, lower-cased, and everything beyond ASCII. A task lays
the texts of an Arrow batch out by language and source, sets a pointer to every place in the
buffer where a term starts, and sorts the pointers by the bytes they point to: a multikey
quicksort whose keys are slices of eight bytes, where only runs that are still equal go on to
the next slice. An equal run is a term; the pointers in it give its documents and its count
in every source. Spark adds up the counts of all buffers.

Every (language, source) gives a kept term the smoothed share ``p``. Two shares p and q differ by
``(p - q)^2 / q``, rounded down. The sum over all kept terms splits into what it would be if
neither source held any term, a correction for each term of one source, and one for each term
that both hold, so absent terms cost nothing and a term costs the square of its sources only.

Defined results: null text, language and source count as empty; a document is a row, so repeated
rows are documents of their own; groups without terms have all pairs; a language without kept
terms has pairs of value 0; equal values rank by the item's bytes; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.operators.skew import keyed_join
from corpusmill.session import materialize, write_table

MIN_DOCUMENTS = 3
SCALE = 1_000_000_000
TERM_RANKS = 200
# Bytes of text whose pointers are sorted together.
BLOCK = 1 << 23
# Counts of terms per cell of the pair sums, pairs held at once, and sources packed into one row.
CELL_ROWS = 1 << 12
PAIRS = 1 << 20
PACKED = 1024

_byte = np.arange(256)
_upper = (_byte >= 0x41) & (_byte <= 0x5A)
IN_TERM = _upper | ((_byte >= 0x61) & (_byte <= 0x7A)) | (_byte >= 0x80)
LOWERED = np.where(_upper, _byte + 32, _byte).astype(np.uint8)


def pointers(data: np.ndarray, borders: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where terms start and end in ``data``; none runs across the ``borders`` of the texts."""
    inside = IN_TERM[data]
    joined = inside[1:] & inside[:-1]
    inner = borders[(borders > 0) & (borders < len(data))]
    joined[inner - 1] = False
    starts = np.flatnonzero(inside & ~np.concatenate(([False], joined)))
    ends = np.flatnonzero(inside & ~np.concatenate((joined, [False]))) + 1
    return starts, ends


def _slices(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, depth: int) -> np.ndarray:
    """Eight bytes of every term as one number that sorts like them; 0 stands behind a term's end."""
    view = np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))
    at = starts + 8 * depth
    left = ends - at
    found = view[np.minimum(at, len(view) - 1)].astype(np.uint64)
    cut = (8 * np.clip(8 - left, 0, 7)).astype(np.uint64)
    return np.where(left > 0, found >> cut << cut, np.uint64(0))


def sorted_pointers(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the pointers by their terms, and which of them in that order start a new run of equal terms.

    ``data`` ends with at least eight spare bytes; terms hold no zero byte.
    """
    keys = _slices(data, starts, ends, 0)
    order = np.argsort(keys)
    keys = keys[order]
    fresh = np.concatenate(([True], keys[1:] != keys[:-1])) if len(keys) else np.empty(0, bool)
    at, depth = np.arange(len(order)), 0
    while True:
        # A slice without a zero byte may go on; runs of one are settled.
        alone = fresh[at] & np.concatenate((fresh, [True]))[at + 1]
        open_ = ((keys & np.uint64(0xFF)) != 0) & ~alone
        at = at[open_]
        if not len(at):
            return order, fresh
        depth += 1
        run = np.cumsum(fresh)[at]
        keys = _slices(data, starts[order[at]], ends[order[at]], depth)
        inner = np.lexsort((keys, run))
        keys, order[at] = keys[inner], order[at][inner]
        fresh[at[1:]] |= (keys[1:] != keys[:-1]) | (run[1:] != run[:-1])


def _gathered(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    lengths = ends - starts
    offsets = np.concatenate(([0], np.cumsum(lengths)))
    places = np.arange(offsets[-1]) + np.repeat(starts - offsets[:-1], lengths)
    buffers = [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[places])]
    return pa.StringArray.from_buffers(len(lengths), *buffers[1:])


def buffer_counts(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms, their group, occurrences and documents; ``group``, in ascending order, numbers each text's."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    borders = offsets - offsets[0]
    data = np.concatenate((LOWERED[raw], np.zeros(8, np.uint8)))
    starts, ends = pointers(data[:-8], borders)
    order, fresh = sorted_pointers(data, starts, ends)
    term = np.cumsum(fresh) - 1
    text = np.searchsorted(borders, starts[order], side="right") - 1
    both = np.sort(term * len(texts) + text)
    term, text = both // len(texts), both % len(texts)
    new_text = np.concatenate(([True], both[1:] != both[:-1])) if len(both) else np.empty(0, bool)
    new_group = new_text & np.concatenate(
        ([True], (term[1:] != term[:-1]) | (group[text[1:]] != group[text[:-1]]))) if len(both) else new_text
    first = np.flatnonzero(new_group)
    counts = np.diff(np.append(first, len(both)))
    documents = np.add.reduceat(new_text.astype(np.int64), first) if len(first) else np.empty(0, np.int64)
    distinct = _gathered(data, starts[order[fresh]], ends[order[fresh]])
    return distinct.take(pa.array(term[first])), group[text[first]], counts, documents


def _pieces(text: str) -> pa.Array:
    """A very long text in pieces that no term crosses."""
    raw = np.frombuffer(text.encode(), np.uint8)
    borders, at = [0], 0
    while at < len(raw):
        at = min(len(raw), at + BLOCK)
        while at < len(raw) and IN_TERM[raw[at - 1]] and IN_TERM[raw[at]]:
            outside = np.flatnonzero(~IN_TERM[raw[at : at + BLOCK]])
            at = at + int(outside[0]) if len(outside) else min(len(raw), at + BLOCK)
        borders.append(at)
    buffers = [None, pa.py_buffer(np.array(borders, np.int32)), pa.py_buffer(raw)]
    return pa.StringArray.from_buffers(len(borders) - 1, *buffers[1:])


def _blocks(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of texts with a bounded number of bytes; a longer text is a range of its own."""
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offsets, offsets[start] + BLOCK, side="right")) - 1)
        yield start, stop
        start = stop


def term_counts(docs: DataFrame) -> DataFrame:
    """``(lang, source, term, n, documents)`` over all rows of ``docs``, written."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name)

    names = ["lang", "source", "term", "n", "documents"]

    def table(langs, sources, group, terms, counts, documents) -> pa.RecordBatch:
        at = pa.array(group)
        columns = [langs.take(at), sources.take(at), terms, pa.array(counts, pa.int64()), pa.array(documents, pa.int64())]
        return pa.record_batch(columns, names=names)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            lang, source = (batch.column(i).dictionary_encode() for i in (0, 1))
            group = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
            order = np.argsort(group, kind="stable")
            numbers, group = np.unique(group[order], return_inverse=True)
            langs = lang.dictionary.take(pa.array(numbers // len(source.dictionary)))
            sources = source.dictionary.take(pa.array(numbers % len(source.dictionary)))
            texts = batch.column(2).cast(pa.string()).take(pa.array(order))
            for start, stop in _blocks(texts):
                if stop - start > 1 or len(texts[start].as_buffer() or b"") <= BLOCK:
                    terms, groups, counts, documents = buffer_counts(texts.slice(start, stop - start), group[start:stop])
                    yield table(langs, sources, groups, terms, counts, documents)
                    continue
                total: dict[str, int] = {}
                pieces = _pieces(texts[start].as_py())
                for i in range(len(pieces)):
                    terms, _, counts, _ = buffer_counts(pieces.slice(i, 1), np.zeros(1, np.int64))
                    for term, n in zip(terms.to_pylist(), counts.tolist()):
                        total[term] = total.get(term, 0) + n
                ones = np.ones(len(total), np.int64)
                yield table(langs, sources, ones * group[start], pa.array(list(total), pa.string()), list(total.values()), ones)

    schema = "lang string, source string, term string, n bigint, documents bigint"
    found = docs.select(text("lang"), text("source"), text("text")).mapInArrow(count, schema)
    summed = found.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))
    return materialize(summed, "term-counts")


def share(n: str, total: str, size: str) -> Column:
    """``1 + floor(SCALE * (n + 1) / (total + size))``, exact."""
    return F.expr(f"1 + cast({n} + 1 as decimal(20,0)) * {SCALE} div greatest({total} + {size}, 1)")


def difference(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def _summed(left: np.ndarray, right: np.ndarray, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of ``values`` per pair of numbers below ``size``."""
    codes, at = np.unique(left * size + right, return_inverse=True)
    sums = np.zeros(len(codes), np.int64)
    np.add.at(sums, at, values)
    return codes, sums


def _shared_terms(cell: pa.Table) -> pa.Table:
    """Corrections for the terms that two sources hold both, summed over the terms of one cell."""
    sources = cell.column("source").combine_chunks().dictionary_encode()
    term = cell.column("term").combine_chunks().dictionary_encode().indices.to_numpy()
    order = np.argsort(term, kind="stable")
    term, source = term[order].astype(np.int64), sources.indices.to_numpy()[order].astype(np.int64)
    p, p0 = (cell.column(c).to_numpy()[order] for c in ("p", "p0"))
    first = np.searchsorted(term, term)
    many = np.searchsorted(term, term, side="right") - first
    size, parts, start = len(sources.dictionary), [], 0
    ends = np.cumsum(many)
    while start < len(term):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + PAIRS, side="right")))
        number = many[start:stop]
        a = np.repeat(np.arange(start, stop), number)
        b = np.arange(len(a)) - np.repeat(np.cumsum(number) - number, number) + np.repeat(first[start:stop], number)
        a, b = a[source[a] != source[b]], b[source[a] != source[b]]
        values = difference(p[a], p[b]) - difference(p[a], p0[b]) - difference(p0[a], p[b]) + difference(p0[a], p0[b])
        parts.append(_summed(source[a], source[b], values, size))
        start = stop
    codes, sums = (np.concatenate(x) for x in zip(*parts))
    codes, sums = _summed(codes // size, codes % size, sums, size)
    name = sources.dictionary.take
    lang = pa.array([cell.column("lang")[0].as_py()] * len(codes), pa.string())
    return pa.table({"lang": lang, "source": name(pa.array(codes // size)), "item": name(pa.array(codes % size)), "value": sums})


def _single_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a row ``(lang, source, p0, size, p, terms, others)`` adds to the pairs of its source with the others.

    A row without ``p`` stands for the whole vocabulary as if no term occurred; any other for
    the ``terms`` of the source that have the share ``p``.
    """
    names = ["lang", "source", "item", "value"]
    for batch in batches:
        for row in batch.to_pylist():
            others = [o for o in row["others"] if o["source"] != row["source"]]
            if not others:
                continue
            item = [o["source"] for o in others]
            q0, p0 = np.array([o["p0"] for o in others], np.int64), np.int64(row["p0"])
            own, langs = [row["source"]] * len(item), [row["lang"]] * len(item)
            if row["p"] is None:
                yield pa.record_batch([langs, own, item, row["size"] * difference(p0, q0)], names=names)
                continue
            p = np.int64(row["p"])
            there = row["terms"] * (difference(p, q0) - difference(p0, q0))
            back = row["terms"] * (difference(q0, p) - difference(q0, p0))
            yield pa.record_batch([langs * 2, own + item, item + own, np.concatenate([there, back])], names=names)


def source_pairs(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``(lang, source, item, value)``: every source against every other of its language.

    ``kept (lang, source, term, n, p)`` holds the kept terms a source has, ``groups (lang, source,
    total, size, p0)`` every source, with the share of a term it does not have.
    """
    held = kept.join(groups.select("lang", "source", "p0"), ["lang", "source"]).select("lang", "source", "term", "p", "p0")
    held = materialize(held, "held")
    cells = held.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    cells = cells.withColumn("cells", F.ceil(F.col("rows") / CELL_ROWS))
    dealt = keyed_join(held, cells, "lang", weight="rows").withColumn("cell", F.pmod(F.xxhash64("term"), F.col("cells")))
    schema = "lang string, source string, item string, value bigint"
    shared = dealt.select("lang", "cell", "source", "term", "p", "p0").groupBy("lang", "cell").applyInArrow(_shared_terms, schema)

    place = F.row_number().over(Window.partitionBy("lang").orderBy("source"))
    numbered = materialize(groups.withColumn("pack", F.floor((place - 1) / PACKED)), "sources")
    packs = numbered.groupBy("lang", "pack").agg(F.collect_list(F.struct("source", "p0")).alias("others"))
    amounts = numbered.groupBy("lang").agg(F.max("pack").alias("last"), F.count(F.lit(1)).alias("sources"))
    shares = held.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("terms"))
    rows = shares.join(groups.select("lang", "source", "p0", "size"), ["lang", "source"])
    none = groups.select("lang", "source", "p0", "size", F.lit(None).cast("bigint").alias("p"), F.lit(0).cast("bigint").alias("terms"))
    rows = keyed_join(rows.unionByName(none), amounts, "lang", weight="sources")
    rows = rows.withColumn("pack", F.explode(F.sequence(F.lit(0).cast("bigint"), "last"))).drop("last", "sources")
    weighed = packs.withColumn("sources", F.size("others"))
    rows = keyed_join(rows, weighed, ["lang", "pack"], weight="sources")
    single = rows.select("lang", "source", "p0", "size", "p", "terms", "others").mapInArrow(_single_terms, schema)
    return shared.unionByName(single).groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))


def divergence(docs: DataFrame, min_documents: int = MIN_DOCUMENTS, term_ranks: int = TERM_RANKS) -> DataFrame:
    """``(lang, source, part, item, value, rank)``.

    Part ``pair`` compares a source with every other of its language, part ``term`` lists the
    terms that a source uses more than its language does, up to ``term_ranks``.
    """
    counts = term_counts(docs)
    words = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("documents"))
    words = materialize(words.where(F.col("documents") >= min_documents).drop("documents"), "kept-terms")
    sizes = materialize(words.groupBy("lang").agg(F.count(F.lit(1)).alias("size"), F.sum("lang_n").alias("lang_total")), "languages")
    terms = materialize(counts.join(words, ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-counts")

    every = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    totals = terms.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    groups = every.join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").select(
        "lang", "source", *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("total", "size", "lang_total")])
    groups = write_table(groups.withColumn("p0", share("0", "total", "size")), "groups")

    weighed = groups.df.join(terms.groupBy("lang", "source").agg(F.count(F.lit(1)).alias("rows")), ["lang", "source"])
    shared = keyed_join(terms, weighed, ["lang", "source"], weight="rows")
    shared = shared.withColumns({"p": share("n", "total", "size"), "q": share("lang_n", "lang_total", "size")})
    shared = materialize(shared.select("lang", "source", "term", "n", "p", "q"), "shares")

    pairs = source_pairs(shared, groups.df).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    over = shared.where("p > q").select(
        "lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), F.expr("(p - q) * (p - q) div q").alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    top = over.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= term_ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)
