import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ngram, pair_parts
from corpusmill.operators.words import explode_words
from corpusmill.plans.registry import md5_ids
from corpusmill.session import materialize, release_shuffles


@pytest.fixture(params=["whole", "cut"])
def sizes(monkeypatch, request):
    """One part and many buckets, or rows cut into small parts, few buckets and messages taken one by one."""
    if request.param == "cut":
        for name, value in {"PART_PAIRS": 5, "GRID": 2, "BUCKETS": 4, "HELD_PAIRS": 1, "OUT_ROWS": 2}.items():
            monkeypatch.setattr(pair_parts, name, value)


def rows_of(kind):
    draw = random.Random(3)
    make = (lambda: draw.choice("a bb ccc é zz q".split())) if kind == "string" else (lambda: draw.choice([-5, 0, 7, 1 << 27]))
    rows = [(i % 9 or None, [make() for _ in range(draw.choice([0, 1, 2, 5, 23]))]) for i in range(30)]
    return rows + [(77, None), (78, []), (79, [make(), None, make(), make()])]


def pairs_of(tokens):
    return [(a, b) for a, b in zip(tokens or [], (tokens or [])[1:])]


@pytest.mark.parametrize("kind", ["string", "int"])
def test_losses_equal_plain_sums(spark, sizes, kind):
    rows = rows_of(kind)
    table = spark.createDataFrame(rows, f"doc_id long, tokens array<{kind}>").repartition(3)
    train = table.where("doc_id % 2 = 0")
    counts, totals = Counter(), Counter()
    for key, tokens in rows:
        for a, b in pairs_of(tokens):
            if key is not None and key % 2 == 0 and a is not None and b is not None:
                counts[a, b] += 1
                totals[a] += 1
    n, nll = Counter(), Counter()
    for key, tokens in rows:
        n[key] += 0
        for a, b in pairs_of(tokens):
            if a is not None and b is not None:
                n[key] += 1
                nll[key] -= math.log((counts[a, b] + 1) / (totals[a] + 11))
    known = [ngram.bigrams(train), ngram.bigrams(ngram.adjacent_pairs(train, "doc_id"), packed=True),
             ngram.counted(ngram.row_pairs(train, "doc_id", *ngram.adjacent("tokens"), packed=True))]
    pairs = [table, pair_parts.written(ngram.adjacent_pairs(table, "doc_id"))]
    for df, found in [(pairs[0], known[0]), (pairs[1], known[1]), (pairs[1], known[2])]:
        scored = ngram.doc_cross_entropy(df, found, F.lit(11)).collect()
        assert {r.doc_id: r.n for r in scored} == dict(n) and len(scored) == len(n)
        assert all(r.nll == pytest.approx(nll[r.doc_id]) for r in scored)
        assert all((r.loss is None) == (r.n == 0) for r in scored)


@pytest.mark.parametrize("kind", ["string", "int"])
def test_counts_keep_nulls_and_words_every_token(spark, sizes, kind):
    rows = rows_of(kind)
    table = spark.createDataFrame(rows, f"doc_id long, tokens array<{kind}>")
    expected = Counter(pair for _, tokens in rows for pair in pairs_of(tokens))
    packed = ngram.adjacent_pairs(table, "doc_id")
    for found in (ngram.bigrams(table), ngram.bigrams(packed)):
        found = found.collect()
        assert {(r.ctx, r.nxt): r.c for r in found} == dict(expected) and len(found) == len(expected)
    without = {pair: c for pair, c in expected.items() if None not in pair}
    assert {(r.ctx, r.nxt): r.c for r in ngram.counted(packed).collect()} == without
    words = {r.word for r in explode_words(packed).distinct().collect()}
    assert words == {token for _, tokens in rows for token in tokens or []}


def test_pairs_are_not_moved_as_rows(spark):
    """A shuffle of ``(ctx, nxt)`` rows took four times the input on disk."""
    table = spark.createDataFrame([(1, "a b a b".split())], "doc_id long, tokens array<string>")
    counts = ngram.bigrams(table)
    plans = [df._jdf.queryExecution().executedPlan().toString() for df in (counts, ngram.doc_cross_entropy(table, counts, 3))]
    assert "hashpartitioning(bucket" in plans[0] and not any("hashpartitioning(ctx" in plan for plan in plans)


def test_released_shuffles_leave_the_disk(spark):
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    names = lambda: {files.getAllFiles().apply(i).getName() for i in range(files.getAllFiles().size())}
    release_shuffles(spark)
    before = names()
    table = spark.createDataFrame([(i, ["a", str(i)]) for i in range(50)], "doc_id long, tokens array<string>")
    materialize(ngram.bigrams(table))
    made = {name for name in names() - before if name.startswith("shuffle_")}
    assert made
    release_shuffles(spark)
    end = time.time() + 3
    while made & names() and time.time() < end:
        time.sleep(0.1)
    assert not made & names()


def test_numbers_and_bytes_come_back():
    arrays = [np.array([0, 1, 1 << 40, -3]), np.zeros(0, np.int64), np.frombuffer(b"abc", np.uint8), np.array([255])]
    assert [a.tolist() for a in pair_parts._unpacked(pair_parts._packed(*arrays))] == [a.tolist() for a in arrays]
    for words in (pa.array(["b", "", None, "é"]), pa.array([3, None, -9], pa.int32()), pa.array([1.5, None]), pa.array([], pa.string())):
        for part in (words, words.slice(1)):
            assert pair_parts._words(pair_parts._plain(part), words.type).equals(part)


def test_ids_of_words_are_those_of_sql(spark):
    table = spark.createDataFrame([(["a", "é", "a", "x" * 50],), ([],), (None,)], "tokens array<string>").coalesce(1)
    plain = F.transform("tokens", lambda w: F.conv(F.substring(F.md5(w), 1, 7), 16, 10).cast("int"))
    assert all(r.a == r.b for r in table.select(md5_ids()("tokens").alias("a"), plain.alias("b")).collect())
