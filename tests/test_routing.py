import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import routing as r


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(v) for v in rng.normal(size=6)], i % 5) for i in range(80)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")


@pytest.fixture(scope="module")
def plain(vectors):
    rows = vectors.orderBy("vec_id").collect()
    x = np.array([v.embedding for v in rows])
    labels = np.array([v.label for v in rows])
    w = np.array([x[labels == e].mean(axis=0) for e in range(5)])
    return x, w, x @ w.T


@pytest.mark.parametrize("entries", [1 << 18, 12])
def test_routing_equals_numpy(vectors, plain, entries):
    x, w, logits = plain
    experts = r.centroids(vectors)
    blocks = r.expert_blocks(experts, entries)
    assert len(blocks) == (1 if entries > 100 else 3)
    assert np.allclose([v for b in blocks for v in b.weights], w)
    gated = r.route_top_k(vectors, blocks).withColumn("gates", r.gate_weights())
    rows = r.combine(gated, blocks).orderBy("vec_id").collect()
    for i, row in enumerate(rows):
        best = np.argsort(-logits[i])[:2]
        assert [g.expert_id for g in row.gates] == list(best)
        e = np.exp(logits[i][best] - logits[i][best].max())
        assert np.allclose([g.gate for g in row.gates], e / e.sum())
        assert np.allclose(row.combined, (e / e.sum()) @ w[best])
    load = {v.expert_id: v for v in r.expert_load(gated, experts).collect()}
    sent = r.dispatch(gated).groupBy("expert_id").count().collect()
    assert {v.expert_id: v["count"] for v in sent} == {e: v.n_rows for e, v in load.items() if not v.unused}
    assert sum(v.share for v in load.values()) == pytest.approx(1)
    assert sum(v.sum_gate for v in load.values()) == pytest.approx(80)


def test_lower_expert_wins_a_tie_and_idle_experts_are_reported(spark):
    experts = spark.createDataFrame([(0, [1.0]), (1, [1.0]), (2, [1.0]), (3, [0.5])], "expert_id int, weights array<double>")
    rows = spark.createDataFrame([(i, [2.0]) for i in range(4)], "vec_id long, embedding array<double>")
    blocks = r.expert_blocks(experts, 2)
    gated = r.route_top_k(rows, blocks).withColumn("gates", r.gate_weights())
    assert [g.expert_id for g in gated.first().gates] == [0, 1]
    load = {v.expert_id: v for v in r.expert_load(gated, experts).collect()}
    assert (load[2].unused, load[2].n_rows, load[2].share, load[2].sum_gate) == (True, 0, 0.0, 0.0)


def test_noise_is_seeded_and_normal(spark):
    logits = F.array(F.struct(F.lit(1).alias("expert_id"), F.lit(0.0).alias("logit")))
    rows = spark.range(4000).withColumn("logits", logits)
    noisy = rows.select("id", F.inline(r.add_noise("logits", "logits", "id", 5))).orderBy("id")
    draws = np.array([v.logit for v in noisy.collect()]) / np.log(2)
    assert abs(draws.mean()) < 0.06 and abs(draws.std() - 1) < 0.05
    again = rows.repartition(9).select("id", F.inline(r.add_noise("logits", "logits", "id", 5))).orderBy("id")
    assert np.array_equal([v.logit for v in again.collect()], draws * np.log(2))


def test_noise_of_all_blocks_and_of_large_logits(spark, vectors):
    blocks = r.expert_blocks(r.centroids(vectors), 12)
    rows = vectors.withColumn("logits", r.all_logits(blocks))
    noisy = rows.withColumn("noisy", r.add_noise("logits", "logits", "vec_id")).collect()
    assert len(blocks) == 3 and all(len(row.noisy) == 5 for row in noisy)
    values = spark.createDataFrame([(x,) for x in (-800.0, 0.0, 800.0)], "x double")
    assert [v[0] for v in values.select(r.softplus(F.col("x"))).collect()] == pytest.approx([0.0, np.log(2.0), 800.0])


def test_null_labels_are_no_experts_and_an_empty_table_routes_nowhere(spark):
    experts = spark.createDataFrame([(None, [9.0]), (0, [1.0]), (1, [2.0])], "expert_id int, weights array<double>")
    rows = spark.createDataFrame([(0, [2.0])], "vec_id long, embedding array<double>")
    assert [b.ids for b in r.expert_blocks(experts, 1)] == [(0,), (1,)]
    none = r.expert_blocks(experts.where("expert_id > 5"))
    gates = rows.withColumn("gates", F.array().cast("array<struct<expert_id:int,logit:double,gate:double>>"))
    assert none == [] and r.combine(gates, none).first().combined == []


def test_means_do_not_depend_on_the_partitions(spark, vectors, monkeypatch):
    odd = [(None, 1.0), ([], 2.0), ([1.0, None], 3.0), ([5.0, 7.0, 9.0], 3.0), ([3.0], None), ([4.0, 1.0], None)]
    rows = spark.createDataFrame([(v, None if k is None else int(k)) for v, k in odd], "embedding array<float>, label int")
    found = {w.expert_id: w.weights for w in r.centroids(rows).collect()}
    assert found == {2: [], 3: [3.0, 7.0, 9.0], None: [3.5, 1.0]}
    many = spark.range(3000).select((F.col("id") % 7).cast("int").alias("label"), F.transform(
        F.sequence(F.lit(1), F.lit(5)), lambda i: F.sin(F.col("id") * i)).cast("array<float>").alias("embedding"))
    results = []
    for parts, held in ((1, 4096), (4, 2), (16, 4096)):
        monkeypatch.setattr(r, "LABELS_HELD", held)
        results.append({w.expert_id: w.weights for w in r.centroids(many.repartition(parts)).collect()})
    plan = r.centroids(many)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan
    for other in results[1:]:
        assert all(np.allclose(other[k], results[0][k], rtol=1e-12, atol=1e-15) for k in range(7))


@pytest.mark.parametrize("round_bytes", [1 << 20, 8 * 6 * 50])
def test_block_routes_equal_numpy(spark, round_bytes, monkeypatch):
    """Experts of very different lengths, ties, several rounds and blocks, vectors that cannot be scored."""
    monkeypatch.setattr(r, "BLOCK_EXPERTS", 16)
    rng = np.random.default_rng(8)
    weights = np.round(rng.normal(size=(230, 6)), 1) * rng.choice([0.01, 1.0, 5.0], 230)[:, None]
    weights[50:60] = weights[40]
    x = rng.normal(size=(90, 6))
    experts = spark.createDataFrame([(i, w.tolist()) for i, w in enumerate(weights)], "expert_id int, weights array<double>")
    rows = [(i, v.tolist(), "kept") for i, v in enumerate(x)] + [(900, None, "a"), (901, [1.0], "b"), (902, [None] * 6, "c"), (903, [0.0] * 6, "d")]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, other string").repartition(3)
    found = {row.vec_id: row for row in r.block_routes(table, experts, 3, round_bytes=round_bytes).collect()}
    logits = x @ weights.T
    for i in range(90):
        best = sorted(range(230), key=lambda e: (-round(logits[i, e], 9), e))[:3]
        assert [g.expert_id for g in found[i].routes] == best and found[i].other == "kept"
        assert np.allclose([g.logit for g in found[i].routes], logits[i, best])
    assert [found[i].routes for i in (900, 901, 902)] == [[], [], []]
    assert [g.expert_id for g in found[903].routes] == [0, 1, 2]
    none = r.block_routes(table, experts.limit(0), 3)
    assert none.where("size(routes) > 0").count() == 0 and none.count() == 94


def test_rows_are_scored_in_bounded_blocks(spark, monkeypatch):
    monkeypatch.setattr(r, "BLOCK_ROWS", 8)
    scored = r.best_of_blocks

    def bounded(x, *rest):
        assert len(x) <= 8
        return scored(x, *rest)

    monkeypatch.setattr(r, "best_of_blocks", bounded)
    experts = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(5)], "expert_id int, weights array<double>")
    table = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(20)], "vec_id long, embedding array<double>").coalesce(1)
    found = r.block_routes(table, experts, 2).collect()
    assert len(found) == 20 and all([g.expert_id for g in row.routes] == [4, 3] for row in found)


def test_short_experts_are_left_out():
    """Once the bound proves it, no product is made with the blocks to come."""
    class Counted(np.ndarray):
        products = 0

        @property
        def T(self):
            Counted.products += 1
            return np.asarray(self).T

    blocks = [(np.arange(4) + 4 * i, (np.eye(4) * 10.0 ** -i).view(Counted), 10.0 ** -i) for i in range(5)]
    best = r.best_of_blocks(np.array([[1.0, 0.9, 0.8, 0.7]]), blocks, 2, [[]])
    assert [e for e, _ in best[0]] == [0, 1] and Counted.products == 1
