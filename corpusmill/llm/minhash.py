"""Near-duplicate documents by b-bit MinHash.

A document is the set of its 5-word shingles. Of ``PERMUTATIONS`` hash minima, the lowest
``BITS`` bits of each are packed into a signature, and groups of ``ROWS`` whole minima are band
keys. Documents with a common band key are candidates; equal packed fields, less those equal
by chance, estimate their similarity; links are confirmed on the full sets.

Equal sets are one class from the start. In a band's bucket every class is compared with the
smallest class only, so a bucket of any size costs one pair per member. Members that end up
in the same component need no further comparison. What is left over, members of one bucket in
different components, is compared inside a join by size and signature, in two rounds: first
those that are most alike, one pair for two components, then every pair still in different
components, by ``WIDE`` further minima as well. What may be a link is confirmed on full sets.

A pair with similarity 0.75 shares a band with probability 1 - (1 - 0.75 ** 4) ** 32, about
0.999995; an estimate below ``LOOK`` or ``LOOK_WIDE`` is five standard errors off.

Defined results: null, empty and blank texts have an empty set and link with nothing; a text
with fewer words than a shingle is one shingle; repeated rows link with each other; a null
id stays null and is never the smallest; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.common import connected_components, map_batches, with_row_id
from corpusmill.session import materialize, materialize_alone

WORDS = 5
PERMUTATIONS = 128
ROWS = 4
BANDS = PERMUTATIONS // ROWS
BITS = 4
PER_LONG = 64 // BITS
LOOK = 0.55
# Minima of the texts that are left over after the first comparisons, and the estimate they must reach.
WIDE = 1024
LOOK_WIDE = 0.68
SEED = 20_011
# Shingles whose hashes under ``PERMUTATIONS`` functions are held at once.
BLOCK = 2048


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct shingles of the lower-cased (A-Z) words."""
    tokens = text.encode().lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, tokens), np.uint64, len(tokens))
    width = min(words, len(tokens))
    total = np.full(len(tokens) - width + 1, width, np.uint64)
    for i in range(width):
        total = _mixed(total + hashes[i : len(hashes) - width + 1 + i])
    return np.unique(total)


class Signer:
    """Minima of fixed random hash functions over a shingle set."""

    def __init__(self, permutations: int = PERMUTATIONS, seed: int = SEED):
        random = np.random.default_rng(seed)
        self.factor = random.integers(0, 1 << 63, permutations, np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
        self.offset = random.integers(0, 1 << 63, permutations, np.uint64)[:, None]
        self.block = BLOCK * PERMUTATIONS // permutations

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        found = np.full(len(self.factor), np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), self.block):
            found = np.minimum(found, (shingles[None, i : i + self.block] * self.factor + self.offset).min(axis=1))
        return found

    def packed(self, minima: np.ndarray) -> np.ndarray:
        """The lowest bits of the minima, ``PER_LONG`` to a 64-bit integer."""
        low = _mixed(minima) & np.uint64((1 << BITS) - 1)
        shifts = np.arange(PER_LONG, dtype=np.uint64) * np.uint64(BITS)
        return (low.reshape(-1, PER_LONG) << shifts).sum(axis=1, dtype=np.uint64).view(np.int64)

    def bands(self, minima: np.ndarray) -> np.ndarray:
        keys = np.arange(BANDS, dtype=np.uint64)
        for column in minima.reshape(BANDS, ROWS).T:
            keys = _mixed(keys * np.uint64(0x9E3779B97F4A7C15) + column)
        return keys.view(np.int64)


def estimated(a: Column, b: Column, permutations: int = PERMUTATIONS) -> Column:
    """Similarity from two packed signatures: share of equal fields, corrected for chance."""
    def unequal(x: Column, y: Column) -> Column:
        bits = x.bitwiseXOR(y)
        folded = bits.bitwiseOR(F.shiftrightunsigned(bits, 1))
        folded = folded.bitwiseOR(F.shiftrightunsigned(folded, 2))
        return F.bit_count(folded.bitwiseAND(F.lit(0x1111111111111111)))

    n = F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda total, x: total + x)
    chance = 1.0 / (1 << BITS)
    return (F.lit(1.0) - n / F.lit(float(permutations)) - chance) / (1.0 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """``(row_id, doc_id, text_key, n_shingles, set_key, packed, bands)``, written; one row per row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    keyed = rows.select("doc_id", F.xxhash64("doc_id", "text").alias("text_key"), "text")

    def start():
        signer = Signer()

        def sign(batch):
            sets = [shingle_set(t) for t in batch.column(2).to_pylist()]
            minima = [signer.minima(s) if len(s) else None for s in sets]
            return (
                batch.column(0), batch.column(1), [len(s) for s in sets],
                [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                [None if m is None else signer.packed(m) for m in minima],
                [None if m is None else signer.bands(m) for m in minima],
            )

        return sign

    schema = "doc_id bigint, text_key bigint, n_shingles bigint, set_key binary, packed array<bigint>, bands array<bigint>"
    return materialize(with_row_id(map_batches(keyed, schema, start)), "signatures")


def _full_sets(wanted: DataFrame, classes: DataFrame, docs: DataFrame, wide: bool = False) -> DataFrame:
    """``(class, shingles, wide)`` of the ``wanted`` classes, made again from the texts, written."""
    names = wanted.join(classes.select("class", "doc_id", "text_key"), "class")
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("_key", F.xxhash64("_doc", "text"))
    same = (F.col("_key") == F.col("text_key")) & F.col("_doc").eqNullSafe(F.col("doc_id"))
    found = rows.join(names, same).select("class", "text").dropDuplicates(["class"])

    def start():
        signer = Signer(WIDE, SEED + 1)

        def read(batch):
            sets = [shingle_set(t) for t in batch.column(1).to_pylist()]
            packed = [signer.packed(signer.minima(s)) if wide else None for s in sets]
            return batch.column(0), [s.tobytes() for s in sets], packed

        return read

    return materialize(map_batches(found, "class bigint, shingles binary, wide array<bigint>", start), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """``(a, b)``: the components of those ``pairs (a, b, left, right)`` of classes whose full sets are similar, written."""
    first = sets.select(F.col("class").alias("a"), F.col("shingles").alias("_left"))
    second = sets.select(F.col("class").alias("b"), F.col("shingles").alias("_right"))
    both = pairs.join(first, "a").join(second, "b").select("left", "right", "_left", "_right")

    def confirm():
        def similar(batch):
            chosen: list[int] = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3))):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = len(np.intersect1d(x, y, assume_unique=True))
                if common >= similarity * (len(x) + len(y) - common):
                    chosen.append(i)
            at = pa.array(chosen, pa.int64())
            return batch.column(0).take(at), batch.column(1).take(at)

        return similar

    return materialize(map_batches(both, "a bigint, b bigint", confirm), "confirmed")


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots (class, root)`` with the linked components made one, written."""
    if links.isEmpty():
        return roots
    found = connected_components(links).select(F.col("node").alias("root"), F.col("root").alias("_new"))
    joined = roots.join(found, "root", "left").select("class", F.coalesce("_new", "root").alias("root"))
    return materialize(joined, "grouped")


def near_duplicates(docs: DataFrame, similarity: float = 0.75) -> DataFrame:
    """``(row_id, text_key, doc_id, n_shingles, component_id, kept, chosen)``, one row per row of ``docs``.

    ``component_id`` is the smallest id of the documents reachable by links; ``kept`` is true
    for that document, ``chosen`` for one row of it, even if its row is repeated.
    """
    rows = materialize_alone(docs.sparkSession, lambda: _rooted(docs, similarity), "rooted")
    # The smallest id decides; among repeated rows of it, the first row.
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row_id")
    first = rows.groupBy("root").agg(F.min(order).alias("_first"))
    joined = rows.join(first, "root")
    return joined.select(
        "row_id", "text_key", "doc_id", "n_shingles", F.col("_first.doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.col("_first.doc_id")).alias("kept"),
        (F.col("row_id") == F.col("_first.row_id")).alias("chosen"),
    )


def _rooted(docs: DataFrame, similarity: float) -> DataFrame:
    """``(row_id, text_key, doc_id, n_shingles, root)``: rows linked with each other have one root."""
    signed = signatures(docs)
    named = signed.where(F.col("set_key").isNotNull())
    class_of = materialize(named.groupBy("set_key").agg(F.min("row_id").alias("class")), "classes")
    heads = signed.select(F.col("row_id").alias("class"), "doc_id", "text_key", "n_shingles", "packed", "bands")
    classes = materialize(heads.join(class_of.select("class"), "class"), "class-heads")

    exploded = classes.select("class", F.explode("bands").alias("band"))
    shared = exploded.groupBy("band").agg(F.min("class").alias("centre"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    members = materialize(exploded.join(shared.select("band", "centre"), "band"), "members")
    ends = classes.select("class", "packed")
    first = ends.select(F.col("class").alias("a"), F.col("packed").alias("_left"))
    second = ends.select(F.col("class").alias("b"), F.col("packed").alias("_right"))
    stars = members.where("class <> centre").select(F.col("class").alias("a"), F.col("centre").alias("b")).distinct()
    stars = stars.join(first, "a").join(second, "b").where(estimated(F.col("_left"), F.col("_right")) >= LOOK)
    stars = materialize(stars.select("a", "b", F.col("a").alias("left"), F.col("b").alias("right")), "stars")
    wanted = stars.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    links = _confirmed(stars, _full_sets(wanted, classes, docs), similarity)
    roots = _merged(classes.select("class", F.col("class").alias("root")), links)

    # Members of one bucket in different components, neither of them the centre.
    def several(rows: DataFrame) -> DataFrame:
        """The rows of buckets that hold more than one component."""
        ends = rows.groupBy("band").agg(F.min("root").alias("_low"), F.max("root").alias("_high")).where("_low < _high")
        return rows.join(ends.select("band"), "band")

    def across(rows: DataFrame, test: Callable[[Callable[[str], Column], Callable[[str], Column]], Column]) -> DataFrame:
        """Pairs in different components that pass ``test``, which belongs to the join: no other pair becomes a row."""
        a, b = (lambda c: F.col(f"_a.{c}")), (lambda c: F.col(f"_b.{c}"))
        # Sizes bound the similarity.
        sizes = F.least(a("n_shingles"), b("n_shingles")) >= F.lit(similarity) * F.greatest(a("n_shingles"), b("n_shingles"))
        # A pair that meets in several buckets comes out of one of them.
        once = F.array_min(F.array_intersect(a("bands"), b("bands"))) == a("band")
        apart = (a("band") == b("band")) & (a("root") < b("root")) & sizes & test(a, b) & once
        return rows.alias("_a").join(rows.alias("_b"), apart).select(
            a("class").alias("a"), b("class").alias("b"), a("root").alias("left"), b("root").alias("right"),
            estimated(a("packed"), b("packed")).alias("score"))

    left_over = materialize(several(members.where("class <> centre").select("band", "class").join(roots, "class")), "left-over")
    sets = _full_sets(left_over.select("class").distinct(), classes, docs, wide=True)
    known = sets.select("class", "wide").join(classes.select("class", "n_shingles", "packed", "bands"), "class")
    left_over = materialize(left_over.join(known, "class"), "left-over")

    near = across(left_over, lambda a, b: estimated(a("packed"), b("packed")) >= similarity)
    best = near.groupBy("left", "right").agg(F.max(F.struct("score", "a", "b")).alias("_best"))
    roots = _merged(roots, _confirmed(best.select("_best.a", "_best.b", "left", "right"), sets, similarity))

    rest = several(left_over.drop("root").join(roots, "class"))
    rest = across(rest, lambda a, b: (estimated(a("packed"), b("packed")) >= LOOK)
                  & (estimated(a("wide"), b("wide"), WIDE) >= LOOK_WIDE))
    roots = _merged(roots, _confirmed(rest, sets, similarity))

    keys = class_of.join(roots, "class").select("set_key", "root")
    rows = signed.select("row_id", "text_key", "doc_id", "n_shingles", "set_key").join(keys, "set_key", "left")
    return rows.withColumn("root", F.coalesce("root", "row_id")).drop("set_key")


def one_of_each(docs: DataFrame, similarity: float = 0.75) -> DataFrame:
    """The rows of ``docs`` that stay when one document of each component is kept, all columns unchanged."""
    kept = near_duplicates(docs, similarity).where("chosen").select(F.col("text_key").alias("_key"))
    key = F.xxhash64(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).alias("_key")
    rows = docs.select(F.struct("*").alias("_row"), key).join(kept, "_key")
    # Equal rows share their key, and one of them stays.
    return rows.dropDuplicates(["_key"]).select("_row.*")
