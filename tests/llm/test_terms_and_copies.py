"""Source divergence, exact copies and spelling variants against SQL and brute force, with every kind of odd row."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import divergence, exact_copies, spelling
from corpusmill.llm.queries import ORACLE, QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, term string, row_id string, hash string, n long, first long"


def odd_rows():
    pick = random.Random(5)
    words = ["stone", "stones", "Stone", "bridge", "brigde", "été", "ÉTÉ", "naïve", "naive", "a", "internationally",
             "internationalize", "internationalise", "internationalized", "中文字", "x9y", "_under_score_"]
    rows = []
    for i in range(120):
        text = pick.choice([" ", "\n", "  ", "-"]).join(pick.choice(words) for _ in range(pick.randrange(0, 40)))
        rows.append((i, text, pick.choice(["en", "fr", None, ""]), pick.choice(["a", "b", "c", "é", None])))
    rows += [
        (200, None, "en", "a"), (201, "", "en", "b"), (202, " \t\n", None, None), (203, "  ", "en", "a"), (204, "stone  bridge", "en", "a"),
        (205, "stone bridge", "fr", "b"), (205, "stone bridge", "fr", "b"), (None, "stone\tbridge", "en", None),
        (206, "stone bridge " * 5000, "en", "long"), (207, "q" * 30_000 + " end", "en", "long"), (208, "nothing kept here", "xx", "y"),
        (209, "other tongue", "xx", "z"), (210, None, "yy", "only"), (None, None, None, None),
        (211, "stone bridge", "en", "a"), (212, "stone bridge ", "en", "a"),
    ]
    return [(*row, "x", "y", "z", 7, 9) for row in rows]


@pytest.fixture(scope="module")
def rows():
    return odd_rows()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def by_sql(name, rows):
    columns = list(zip(*rows))
    documents = pa.table({"doc_id": pa.array(columns[0], pa.int64()), **{
        c: pa.array(columns[i], pa.string()) for i, c in ((1, "text"), (2, "lang"), (3, "source"))}})
    connection = duckdb.connect()
    connection.register("documents", documents)
    found = connection.sql(ORACLE[name])
    return found.columns, Counter(found.fetchall())


def test_divergence_equals_sql(docs, rows):
    columns, expected = by_sql("op11_divergence", rows)
    assert Counter(map(tuple, divergence.divergence(docs).select(columns).collect())) == expected


def test_divergence_in_small_blocks(docs, rows, monkeypatch):
    """Texts longer than a block, several cells and packs, and broadcasts that do not fit."""
    for name, value in {"BLOCK": 300, "CELL_ROWS": 20, "PAIRS": 7, "PACKED": 2}.items():
        monkeypatch.setattr(divergence, name, value)
    monkeypatch.setattr("corpusmill.operators.skew.BROADCAST_ROWS", 1)
    columns, expected = by_sql("op11_divergence", rows)
    assert Counter(map(tuple, divergence.divergence(docs).select(columns).collect())) == expected


def test_sorted_pointers():
    """Terms that share their first slices, end inside a slice or at its border."""
    terms = ["a", "abcdefgh", "abcdefghi", "abcdefgh", "abcdefghabcdefgh", "abcdefghabcdefghz", "é", "b", "abcdefghi"] * 3
    texts = pa.array([" ".join(terms[:10]), "", "abcdefgh", " ".join(terms[10:]), "9 9"])
    found, group, counts, documents = divergence.buffer_counts(texts, np.array([0, 0, 1, 1, 2]))
    split = [terms[:10], [], ["abcdefgh"], terms[10:], []]
    expected = {}
    for text, g in zip(split, [0, 0, 1, 1, 2]):
        for term, n in Counter(text).items():
            a, b = expected.get((term, g), (0, 0))
            expected[term, g] = (a + n, b + 1)
    assert {(t, g): (n, d) for t, g, n, d in zip(found.to_pylist(), group.tolist(), counts.tolist(), documents.tolist())} == expected
    assert [t.encode() for t in dict.fromkeys(found.to_pylist())] == sorted({t.encode() for t in terms})


def test_shares_are_exact(spark):
    big = 9_000_000_000_000
    row = spark.range(1).select(F.lit(big).alias("n"), F.lit(big * 3 + 1).alias("t"), F.lit(77).alias("v"))
    assert row.select(divergence.share("n", "t", "v").alias("p")).first().p == 1 + 10**9 * (big + 1) // (big * 3 + 78)


@pytest.mark.parametrize("hash_of", [
    exact_copies.hash128, lambda text: F.substring(F.md5(text.cast("binary")), 1, 1), lambda text: F.lit("same")])
def test_exact_copies(docs, rows, hash_of):
    """Also with hashes that collide: the texts decide."""
    columns, expected = by_sql("op12_exact_copies", rows)
    found = exact_copies.exact_copies(docs, hash_of).select(columns).collect()
    assert Counter(map(tuple, found)) == expected


def test_copies_without_broadcast(docs, rows, monkeypatch):
    monkeypatch.setattr("corpusmill.operators.skew.BROADCAST_ROWS", 0)
    monkeypatch.setattr("corpusmill.operators.skew.HOT_SHARE", 0.01)
    columns, expected = by_sql("op12_exact_copies", rows)
    assert Counter(map(tuple, exact_copies.exact_copies(docs).select(columns).collect())) == expected


def test_one_of_each(docs, rows):
    found = exact_copies.one_of_each(docs)
    assert found.columns == docs.columns
    texts = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in found.collect()]
    assert sorted(texts) == sorted({re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "") for r in rows})


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(counts):
    found = {}
    for word, n in counts.items():
        near = [w for w in counts if one_edit(w, word)]
        best = min(near, key=lambda w: (-counts[w], w), default=None)
        form = best if best is not None and counts[best] >= 2 * n else None
        found[word] = (n, len(near), form, counts.get(form))
    for word, values in found.items():
        root = word
        while found[root][2] is not None:
            root = found[root][2]
        found[word] = (*values, root)
    return found


def brute_words(rows):
    counts = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}


def variants(table):
    return {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in table.collect()}


def test_words(docs, rows, spark, sf_dir):
    assert {r.word: r.n for r in spelling.vocabulary(docs).collect()} == brute_words(rows)
    given = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    found = QUERIES["op13_spelling_variants"](spark, sf_dir)
    words = brute_words(given)
    assert found.count() == len(words)
    chosen = dict(sorted(words.items(), key=lambda w: zlib.crc32(w[0].encode()))[:400])
    got = variants(found)
    for word in chosen:
        assert got[word][1] == sum(one_edit(word, w) for w in words)


@pytest.fixture(scope="module")
def lexicon():
    """Random words over few letters, many of them near each other, with ties, short and very long ones."""
    pick = random.Random(3)
    words = {"".join(pick.choice("abé") for _ in range(pick.randrange(1, 8))) for _ in range(500)}
    words |= {"pre" + w for w in list(words)[:100]} | {"z" * n for n in (1, 2, 3, 4, 900, 901, 902)} | {"z" * 450 + "y" + "z" * 450}
    return {w: pick.choice([3, 3, 4, 7, 16, 40, 100, 1000]) for w in sorted(words)}


def test_variants_equal_brute_force(spark, lexicon):
    words = spark.createDataFrame(list(lexicon.items()), "word string, n long").repartition(3)
    assert variants(spelling.variant_groups(words)) == brute_variants(lexicon)


def test_variants_in_grids(spark, lexicon, monkeypatch):
    """Ends with more words than a cell holds, and joins without broadcasts."""
    for name, value in {"CELL_WORDS": 6, "LEAST_CELL": 2, "MATRIX": 3}.items():
        monkeypatch.setattr(spelling, name, value)
    monkeypatch.setattr("corpusmill.operators.skew.BROADCAST_ROWS", 0)
    words = spark.createDataFrame(list(lexicon.items()), "word string, n long").repartition(3)
    assert variants(spelling.variant_groups(words)) == brute_variants(lexicon)


def test_empty_tables(docs):
    none = docs.limit(0)
    assert divergence.divergence(none).count() == exact_copies.exact_copies(none).count() == 0
    assert spelling.variant_groups(spelling.vocabulary(none)).count() == exact_copies.one_of_each(none).count() == 0
    blank = docs.where("text is null")
    assert spelling.variant_groups(spelling.vocabulary(blank)).count() == 0
    assert exact_copies.exact_copies(blank).count() == blank.count()
    assert {r.value for r in divergence.divergence(blank).collect()} <= {0}


@pytest.mark.parametrize("name", ["op11_divergence", "op12_exact_copies"])
def test_queries_equal_sql(spark, sf_dir, name):
    connection = duckdb.connect()
    connection.sql(f"create view documents as select * from '{sf_dir}/documents.parquet'")
    expected = connection.sql(ORACLE[name])
    found = QUERIES[name](spark, sf_dir)
    assert Counter(map(tuple, found.select(expected.columns).collect())) == Counter(expected.fetchall())
