import hashlib
import math
import pickle
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpusmill.operators import ngram, skew
from corpusmill.operators.candidates import argmax, sample_one, softmax, top_k_ties
from corpusmill.operators.ngram import (
    bigrams, continue_batch, doc_cross_entropy, draw_cells, evaluate, next_candidates,
)
from corpusmill.operators.skew import keyed_join
from corpusmill.session import materialize, write_table

ROWS = [("a", f"c{i}", float(v)) for i, v in enumerate([3, 2, 2, 1])] + [("b", "x", -800.0), ("b", "y", -801.0), ("c", "z", 900.0)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(ROWS, "context string, candidate string, logit double")


@pytest.fixture(params=[True, False], ids=["broadcast", "salted"])
def broadcasting(request, monkeypatch):
    """Small per-key tables broadcast, or treated like large ones."""
    if not request.param:
        monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)


def test_softmax(table, broadcasting):
    got = {(r.context, r.candidate): r.p for r in softmax(table, 0.8).collect()}
    for context in "abc":
        scores = {c: v / 0.8 for k, c, v in ROWS if k == context}
        total = sum(math.exp(v - max(scores.values())) for v in scores.values())
        for c, v in scores.items():
            assert got[context, c] == pytest.approx(math.exp(v - max(scores.values())) / total)
        assert sum(p for (k, _), p in got.items() if k == context) == pytest.approx(1)


@pytest.mark.parametrize("k, kept", [(1, 1), (2, 3), (3, 3), (4, 4), (50, 4)])
def test_top_k_keeps_ties(table, k, kept, broadcasting):
    assert top_k_ties(table, k).where("context = 'a'").count() == kept


def test_argmax_prefers_the_lowest_candidate(spark):
    table = spark.createDataFrame([("a", 5, 1.0), ("a", 3, 1.0), ("a", 1, 0.5)], "context string, candidate int, logit double")
    assert argmax(table).first().candidate == 3


def test_draws_follow_the_probabilities(spark):
    weights = {"x": 0.6, "y": 0.3, "z": 0.1}
    rows = spark.range(6000).select(F.col("id").cast("string").alias("context"))
    options = spark.createDataFrame([(c, math.log(p)) for c, p in weights.items()], "candidate string, logit double")
    every = rows.join(F.broadcast(options))
    drawn = Counter(r.candidate for r in sample_one(every, temperature=1.0).collect())
    for c, p in weights.items():
        assert drawn[c] / 6000 == pytest.approx(p, abs=0.03)
    again = sample_one(every.repartition(11), temperature=1.0)
    assert again.exceptAll(sample_one(every, temperature=1.0)).count() == 0


@pytest.mark.parametrize("how", ["inner", "left"])
def test_keyed_join_is_the_plain_join(spark, how, broadcasting):
    """One key holds a third of the rows; some keys have no partner."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    left = spark.range(6000).select("id", key.alias("k"))
    right = left.where("k < 400").groupBy("k").agg(F.count("*").alias("n")).withColumn("v", F.col("k") * 2)
    plain = left.join(right, "k", how).select("id", "k", "n", "v")
    keyed = keyed_join(left, right, "k", "n", how).select("id", "k", "n", "v")
    assert sorted(map(tuple, keyed.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)


def test_hot_keys_are_spread(spark, monkeypatch):
    monkeypatch.setattr(skew, "BROADCAST_BYTES", -1)
    left = spark.range(9000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id")).alias("k"))
    right = left.groupBy("k").agg(F.count("*").alias("n"))
    salted = keyed_join(left, right, "k", "n")
    plan = salted._jdf.queryExecution().optimizedPlan().toString()
    assert "_salt" in plan and salted.count() == 9000
    # A third of all rows and a share of 0.01 per task: 34 salts; no other key is hot.
    few = keyed_join(left, right, "k", "n", hot_share=0.01).where("k = -1")
    assert few.count() == 3000 and few.select("id").distinct().count() == 3000


def test_packed_tables_of_many_rows_are_not_broadcast(spark, monkeypatch):
    table = write_table(spark.range(1000))
    assert skew.fits_broadcast(table)
    monkeypatch.setattr(skew, "BROADCAST_ROWS", 999)
    assert not skew.fits_broadcast(table)


DOCS = [(0, "a b a b c"), (1, "a b c"), (2, "b a"), (3, "a z q a b")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t.split()) for i, t in DOCS], "doc_id long, tokens array<string>")


def test_cross_entropy_and_report(docs, broadcasting):
    train, validation = docs.where("doc_id < 3"), docs.where("doc_id in (0, 3)")
    pairs = Counter(p for i, t in DOCS if i < 3 for p in zip(t.split(), t.split()[1:]))
    totals = Counter()
    for (l, _), c in pairs.items():
        totals[l] += c
    losses = defaultdict(list)
    for i, t in DOCS:
        if i in (0, 3):
            for l, r in zip(t.split(), t.split()[1:]):
                losses[i].append(-math.log((pairs[l, r] + 1) / (totals[l] + 4)))
    got = {r.doc_id: r.loss for r in doc_cross_entropy(validation, bigrams(train), 4).collect()}
    assert got == pytest.approx({i: sum(v) / len(v) for i, v in losses.items()})
    report = evaluate(train, validation, 4, batch_size=1).first()
    macro = sum(sum(v) / len(v) for v in losses.values()) / 2
    assert report.macro_loss == pytest.approx(macro) and report.perplexity == pytest.approx(math.exp(macro))
    assert report.micro_loss == pytest.approx(sum(map(sum, losses.values())) / sum(map(len, losses.values())))


def test_short_documents_have_no_loss_and_keep_their_place(spark, docs, broadcasting):
    train = docs.where("doc_id < 3")
    short = spark.createDataFrame([(5, ["a"]), (6, []), (7, None), (8, ["a", "b"])], "doc_id long, tokens array<string>")
    scored = {r.doc_id: (r.n, r.loss) for r in doc_cross_entropy(short, bigrams(train), 4).collect()}
    assert [scored[i] for i in (5, 6, 7)] == [(0, None)] * 3 and scored[8][0] == 1
    report = evaluate(train, short, 4, batch_size=3).first()
    assert report.n_pairs == 1 and report.macro_loss == pytest.approx(scored[8][1])


@pytest.mark.parametrize("per_cell", [256, 1])
def test_cells_cover_the_grid_without_gaps(docs, monkeypatch, per_cell):
    monkeypatch.setattr(ngram, "PER_CELL", per_cell)
    cells = draw_cells(next_candidates(bigrams(docs))).collect()
    by_context = defaultdict(dict)
    for row in cells:
        assert row.lo >> row.shift <= row.cell <= (row.hi - 1) >> row.shift
        by_context[row.ctx][row.nxt] = (row.lo, row.hi)
    for intervals in by_context.values():
        borders = sorted(intervals.values())
        assert borders[0][0] == 0 and borders[-1][1] == 1 << 32
        assert all(a[1] == b[0] for a, b in zip(borders, borders[1:]))


def test_continuation(spark, docs, broadcasting):
    prompts = spark.createDataFrame(
        [(1, ["a"]), (2, ["q", "b"]), (3, ["nothing"]), (4, []), (5, ["c"])], "conv_id long, tokens array<string>"
    )
    pairs = {p for _, t in DOCS for p in zip(t.split(), t.split()[1:])}
    candidates = next_candidates(bigrams(docs))
    rows = {r.conv_id: r for r in continue_batch(prompts, candidates, 12, n=5).collect()}
    assert set(rows) == {1, 2, 3, 4, 5}
    assert rows[3].generated == rows[4].generated == rows[5].generated == []
    for i in (1, 2):
        chain = rows[i].tokens[-1:] + rows[i].generated
        assert all(p in pairs for p in zip(chain, chain[1:]))
        assert len(rows[i].generated) == 12 or chain[-1] not in {l for l, _ in pairs}
        assert rows[i].context == (rows[i].tokens + rows[i].generated)[-5:]
    again = {r.conv_id: r.generated for r in continue_batch(prompts.repartition(5), candidates, 12, n=5).collect()}
    assert again == {i: r.generated for i, r in rows.items()}


def test_walks_are_the_same_whatever_travels(spark, docs, monkeypatch, broadcasting):
    """Places that travel and places that prompts move to; one cell a context or several."""
    prompts = spark.createDataFrame([(i, [w]) for i, w in enumerate("abqzxc" * 5)] + [(None, ["a"])], "conv_id long, tokens array<string>")
    counts = spark.createDataFrame(
        [(a, b, (i * 7 + j * 3) % 11 + 1) for i, a in enumerate("abqz") for j, b in enumerate("abqzc") if (i + j) % 4], "ctx string, nxt string, c long")
    candidates = next_candidates(counts)
    found = []
    for head, places, per_cell in ((1 << 20, 1 << 20, 256), (0, 10, 256), (5, 1, 1), (7, 100, 1)):
        monkeypatch.setattr(ngram, "HEAD_CANDIDATES", head)
        monkeypatch.setattr(ngram, "HEAD_PLACES", places)
        monkeypatch.setattr(ngram, "PER_CELL", per_cell)
        rows = continue_batch(prompts, candidates, 9).collect()
        found.append(sorted((repr(r.conv_id), tuple(r.tokens), tuple(r.generated)) for r in rows))
    assert found[0] == found[1] == found[2] == found[3] and len(found[0]) == 31
    assert any(len(g) == 9 for *_, g in found[0]) and any(g == () for *_, g in found[0])


@pytest.mark.parametrize("include_pad", [True, False])
def test_loss_of_fixed_rows(spark, include_pad, broadcasting):
    rows = [(0, [5, 6, 5, 2, 2], [6, 5, 2, 2, 2], 3), (1, [2, 2, 2, 2, 2], [2] * 5, 0), (2, [5, 5, 6, 7, 5], [5, 6, 7, 5, 2], 9), (3, None, None, None)]
    table = spark.createDataFrame(rows, "doc_id long, input_ids array<int>, targets array<int>, n_tokens int")
    pairs = {i: list(zip(a, b))[: None if include_pad else n] for i, a, b, n in rows if a}
    counts = Counter(p for i in (0, 1) for p in pairs[i])
    totals = Counter(a for i in (0, 1) for a, _ in pairs[i])
    losses = {i: [-math.log((counts[p] + 1) / (totals[p[0]] + 9)) for p in found] for i, found in pairs.items()}
    places = ngram.padded("input_ids", "targets", "n_tokens", include_pad)
    train = ngram.counted(ngram.row_pairs(table.where("doc_id < 2"), "doc_id", *places))
    scored = {r.doc_id: r for r in ngram.cross_entropy(ngram.row_pairs(table, "doc_id", *places), train, 9, "doc_id").collect()}
    for i, values in losses.items():
        assert scored[i].n == len(values) and scored[i].nll == pytest.approx(sum(values))
    assert scored[3].n == 0 and scored[3].loss is None
    report = ngram.evaluate_fixed(table.where("doc_id < 2"), table, 9, include_pad, batch_size=2).first()
    batches = [losses[0] + losses[1], losses[2]]
    assert report.macro_loss == pytest.approx(sum(sum(b) / len(b) for b in batches) / 2)
    assert report.n_pairs == sum(map(len, batches))


def test_pairs_are_combined_in_bounded_parts(spark, monkeypatch):
    rows = [(i, [i % 3, 1, 2, 1, 2][: i % 6], [1, 2, 1, 2, i % 3][: i % 6]) for i in range(40)] + [(40, None, None), (41, [7] * 9, [7] * 9)]
    table = spark.createDataFrame(rows, "doc_id long, inputs array<int>, targets array<int>").coalesce(1)
    places, found = (F.col("inputs"), F.col("targets")), []
    coded = ngram._coded_pairs

    def bounded(inputs, targets):
        assert len(inputs) == 1 or len(inputs.flatten()) <= most
        return coded(inputs, targets)

    monkeypatch.setattr(ngram, "_coded_pairs", bounded)
    for most in (8, 1000):
        monkeypatch.setattr(ngram, "PART_PAIRS", most)
        found.append(Counter(map(tuple, ngram.row_pairs(table, "doc_id", *places).collect())))
    expected = Counter((i, a, b) for i, left, right in rows for a, b in zip(left or [], right or []))
    assert found[0] == found[1]
    assert {(i, a, b): m for i, a, b, whole, m in found[0] if not whole} == expected


def test_pairs_are_moved_once(spark, docs, broadcasting, request):
    scored = doc_cross_entropy(docs, bigrams(docs), 4)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    # The rows of pairs come from one pass over the documents and meet one table.
    assert plan.count("MapInArrow") <= 2 and plan.count("posexplode") == 0


def test_softmax_of_masked_and_odd_logits(spark, broadcasting):
    inf, nan = math.inf, math.nan
    rows = [("m", 1, 1.0), ("m", 2, -inf), ("m", 3, 1.0), ("all", 1, -inf), ("nan", 1, nan), ("nan", 2, 0.0),
            ("inf", 1, inf), ("none", 1, None), ("none", 2, 3.0)]
    table = spark.createDataFrame(rows, "context string, candidate int, logit double")
    got = {(r.context, r.candidate): r.p for r in softmax(table).collect()}
    assert [got["m", i] for i in (1, 2, 3)] == [0.5, 0.0, 0.5]
    assert all(math.isnan(got[key]) for key in (("all", 1), ("nan", 1), ("nan", 2), ("inf", 1)))
    assert got["none", 1] is None and got["none", 2] == 1.0


@pytest.mark.parametrize("per_cell", [256, 2])
def test_intervals_are_scaled_in_whole_numbers(spark, monkeypatch, per_cell):
    """Totals below and above the border from which a product needs more than 64 bits."""
    monkeypatch.setattr(ngram, "PER_CELL", per_cell)
    weights = {"small": [0.5, 0.3, 0.2], "large": [1.0, 3.0, 7.0, 0.1], "one": [1.0]}
    rows = [(ctx, f"{ctx}{i}", 1, p) for ctx, ps in weights.items() for i, p in enumerate(ps)]
    got = {(r.ctx, r.nxt): (r.lo, r.hi) for r in draw_cells(spark.createDataFrame(rows, "ctx string, nxt string, c long, p double")).collect()}
    for ctx, ps in weights.items():
        total, end = sum(round(p * 2 ** 30) for p in ps), 0
        for _, nxt, p in sorted((hashlib.md5(f"{ctx}{i}".encode()).hexdigest()[:2], f"{ctx}{i}", p) for i, p in enumerate(ps)):
            start, end = end, end + round(p * 2 ** 30)
            assert got[ctx, nxt] == ((start << 32) // total, (end << 32) // total)


def test_places_of_one_cell_take_one_shuffle(docs):
    candidates = materialize(next_candidates(bigrams(docs)))
    one, _ = ngram._cell_parts(candidates, ngram.several_cells(candidates).df)
    plan = one.groupBy("ctx", "cell").agg(F.collect_list("nxt"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_travelling_candidates_need_no_package_on_the_executors(spark, docs, monkeypatch):
    sent, kept = [], type(spark.sparkContext).broadcast
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, value: sent.append(pickle.dumps(value)) or kept(self, value))
    prompts = spark.createDataFrame([(1, ["a"])], "conv_id long, tokens array<string>")
    assert continue_batch(prompts, next_candidates(bigrams(docs)), 3).count() == 1
    assert sent and not any(b"corpusmill" in data for data in sent)
