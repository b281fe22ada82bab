import hashlib

import pytest
from pyspark.sql import functions as F

from corpusmill.operators.ranking import range_rank
from corpusmill.operators.sampling import (
    Permutation, batches, epoch_order, epoch_permutation, first_by_priority, limit_batches, numbered_rows, sample_n, total_steps,
)


def _corpus(spark, n=200, parts=3):
    split = F.when(F.col("doc_id") % 10 == 0, "validation").otherwise("train")
    return spark.range(0, n, 1, parts).toDF("doc_id").withColumn("split", split)


def _expected(seed, ids, k):
    return sorted(ids, key=lambda i: hashlib.md5(f"{seed}:{i}".encode()).hexdigest())[:k]


@pytest.mark.parametrize("parts", [1, 4, 16])
@pytest.mark.parametrize("k", [0, 1, 17, 180])
def test_sample_is_the_head_of_the_seeded_order(spark, k, parts):
    rows = sample_n(_corpus(spark, parts=parts), {"train": k, "validation": 5}, 42).collect()
    for split, size, ids in (
        ("train", k, [i for i in range(200) if i % 10]), ("validation", 5, [i for i in range(200) if not i % 10]),
    ):
        got = sorted((r.sample_pos, r.doc_id) for r in rows if r.split == split)
        assert [i for _, i in got] == _expected(42, ids, size)
        assert [p for p, _ in got] == list(range(1, size + 1))


@pytest.mark.parametrize("k", [None, -1, 181])
def test_sample_keeps_a_whole_split_unshuffled(spark, k):
    rows = sample_n(_corpus(spark), {"train": k, "validation": 20}).collect()
    train = [r for r in rows if r.split == "train"]
    assert len(train) == 180 and all(r.sample_pos is None for r in train)
    assert sorted(r.sample_pos for r in rows if r.split == "validation") == list(range(1, 21))


def test_only_named_splits_are_sampled(spark):
    assert {r.split for r in sample_n(_corpus(spark), {"train": -1}).collect()} == {"train"}
    assert {r.split for r in sample_n(_corpus(spark), {"validation": 3}).collect()} == {"validation"}


def test_sample_sends_only_chosen_rows_into_the_shuffle(spark):
    plan = sample_n(_corpus(spark), {"train": 3, "validation": 3})._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "substring(md5" in plan


def test_epoch_orders(spark):
    docs = _corpus(spark).select("doc_id")
    orders = [[r.doc_id for r in epoch_order(docs, 42, e).orderBy("pos").collect()] for e in (0, 1)]
    assert orders[0] != orders[1] and all(sorted(o) == list(range(200)) for o in orders)
    fixed = epoch_order(docs, 42, 0, shuffle=False).orderBy("pos").collect()
    assert [(r.doc_id, r.pos) for r in fixed] == [(i, i + 1) for i in range(200)]


def test_range_rank_splits_a_value_that_fills_most_rows(spark):
    rows = spark.range(0, 2000, 1, 7).select((F.when(F.col("id") % 3 > 0, 5).otherwise(F.col("id"))).alias("ts"), "id")
    ranked = range_rank(rows, ["ts", "id"])
    expected = sorted((5 if i % 3 else i, i) for i in range(2000))
    assert [(r.ts, r.id) for r in ranked.orderBy("pos").collect()] == expected
    assert sorted(r.pos for r in ranked.collect()) == list(range(1, 2001))


def test_batches_and_steps(spark):
    docs = spark.range(33).toDF("doc_id")
    rows = batches(epoch_order(docs, 1, 1, shuffle=False)).collect()
    sizes = {b: sum(r.batch_id == b for r in rows) for b in {r.batch_id for r in rows}}
    assert sizes == {0: 32, 1: 1}
    assert limit_batches(batches(epoch_order(docs, 1, 1)), 1).count() == 32
    assert total_steps(docs, 20).first().total_steps == 40


def test_first_by_priority(spark):
    table = spark.createDataFrame([("x", "b"), ("x", "c"), ("y", "c"), ("z", "q")], "g string, name string")
    assert {tuple(r) for r in first_by_priority(table, "name", ["a", "b", "c"], ["g"]).collect()} == {("x", "b"), ("y", "c")}
    assert first_by_priority(table, "name", ["c", "b"]).first().name == "c"
    assert first_by_priority(table, "name", ["nothing"]).first().name is None


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 100, 1023, 5000])
def test_permutations_reach_every_place(spark, n):
    rows = spark.range(n)
    orders = []
    for seed, epoch in ((42, 0), (42, 1), (7, 0)):
        found = [r.p for r in rows.select("id", Permutation(n, seed, epoch).of(F.col("id")).alias("p")).orderBy("id").collect()]
        assert sorted(found) == list(range(n))
        orders.append(tuple(found))
    assert n < 16 or len(set(orders)) == 3
    if n == 5000:
        # Neighbours are far from each other, and every tenth of the rows is spread over all places.
        steps = [abs(a - b) for a, b in zip(orders[0], orders[0][1:])]
        assert 1200 < sum(steps) / len(steps) < 2200
        for i in range(10):
            assert 2000 < sum(orders[0][i::10]) / 500 < 3000


def test_epochs_of_numbered_rows_are_projections(spark):
    rows = spark.createDataFrame([(i * 7 % 101, i) for i in range(101)], "doc_id long, other long")
    numbered, n = numbered_rows(rows.repartition(5))
    assert n == 101 and [r.row for r in numbered.orderBy("doc_id").collect()] == list(range(101))
    epoch = epoch_permutation(numbered, n, 42, 3)
    assert "Exchange" not in epoch._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.pos for r in epoch.collect()) == list(range(1, 102))
    again, _ = numbered_rows(rows.repartition(2))
    assert {r.doc_id: r.pos for r in epoch_permutation(again, n, 42, 3).collect()} == {r.doc_id: r.pos for r in epoch.collect()}
