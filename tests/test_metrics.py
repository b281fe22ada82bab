import math

import pytest

from corpusmill.operators import metrics as m


@pytest.fixture(scope="module")
def log(spark):
    rows = [(s, s // 20, "val" if s % 4 == 0 else "train", s // 32, float(s % 7) + 0.5) for s in range(33)]
    return spark.createDataFrame(rows, "step long, epoch int, phase string, batch_id long, loss double")


def test_short_batch_counts_fully(log):
    losses = [float(s % 7) + 0.5 for s in range(33)]
    expected = (sum(losses[:32]) / 32 + losses[32]) / 2
    assert m.macro_loss(log).first().macro_loss == pytest.approx(expected)
    assert m.train_loss(log, 1).first().train_loss == pytest.approx(sum(losses[:32]) / 32)
    assert m.train_loss(log, 4).first().train_loss == pytest.approx(expected)
    assert m.train_loss(log, 4, compat=True).first().train_loss == pytest.approx(expected * 2 / 4)


def test_buckets_and_reports(log):
    rows = {r.bucket: (r.mean_value, r.n_steps) for r in m.bucket_mean(log).collect()}
    assert rows[1][1] == 8 and rows[0][1] == 25
    assert rows[1][0] == pytest.approx(sum(s % 7 + 0.5 for s in range(25, 33)) / 8)
    assert sorted(r.step for r in m.every_n(log, 10).collect()) == [0, 10, 20, 30]
    assert log.select(m.log10_loss()).first()[0] == pytest.approx(math.log10(0.5))


def test_logarithm_of_odd_losses(spark):
    table = spark.createDataFrame([(0.0,), (-1.0,), (None,), (100.0,)], "loss double")
    zero, below, missing, hundred = [r[0] for r in table.select(m.log10_loss()).collect()]
    assert zero == float("-inf") and math.isnan(below) and missing is None and hundred == 2.0


def test_epochs(log):
    summary = m.epoch_summary(log)
    rows = {r.epoch: r for r in summary.collect()}
    assert rows[1].val_loss == pytest.approx((sum(s % 7 + 0.5 for s in (20, 24, 28)) / 3 + 32 % 7 + 0.5) / 2)
    best = m.best_by(summary, "val_loss").first()
    assert best.epoch == min(rows, key=lambda e: rows[e].val_loss)
    assert m.perplexity(log).first().perplexity == pytest.approx(math.exp(sum(s % 7 + 0.5 for s in range(33)) / 33))


def test_throughput_is_a_mean_of_ratios(spark):
    rows = [("a", 10, 1.0), ("a", 20, 2.0), ("b", 30, 1.0), ("c", 5, 0.0)]
    per_prompt = m.throughput(spark.createDataFrame(rows, "prompt string, tokens long, seconds double"))
    assert {r.prompt: r.tokens_per_second for r in per_prompt.collect()} == {"a": 10.0, "b": 30.0}
    total = m.throughput_summary(per_prompt).first()
    assert (total.avg_seconds, total.avg_tokens_per_second, total.total_seconds) == (2.0, 20.0, 4.0)


def test_usage(spark):
    log = spark.createDataFrame([("x", "l0"), ("x", "l1"), ("x", "l0"), ("y", "l1")], "g string, layer string")
    rows = {r.g: r for r in m.usage(log, "layer", ["g"]).collect()}
    assert rows["x"].uses == {"l0": 2, "l1": 1} and rows["x"].names == ["l0", "l1"] and rows["x"].n_uses == 3
    assert m.usage(log, "layer").first().n_names == 2


def test_most_used_names_are_a_short_list(spark):
    rows = [("g", f"n{i:04}") for i in range(3000)] + [("g", "n0007")] * 5 + [("g", "n0003")] * 5 + [("h", "x"), (None, "y"), (None, None)]
    log = spark.createDataFrame(rows, "grp string, name string")
    found = {r.grp: r for r in m.usage_top(log, "name", ["grp"], 3).collect()}
    assert [(e.name, e.n) for e in found["g"].top] == [("n0003", 6), ("n0007", 6), ("n0000", 1)]
    assert (found["g"].n_names, found["g"].n_uses, found["g"].n_rest) == (3000, 3010, 2997)
    assert [(e.name, e.n) for e in found["h"].top] == [("x", 1)] and found["h"].n_rest == 0
    assert found[None].n_names == 2 and found[None].n_rest == 0


def test_epoch_report_by_batch_means(spark):
    """Three validation batches, the first three of four training batches; an epoch without validation."""
    rows = [(0, "val", b, float(x)) for b, x in ((0, 1), (0, 3), (1, 4), (9, 10))]
    rows += [(0, "train", b, float(x)) for b, x in ((2, 1), (2, 2), (3, 6), (4, 8), (5, 100))] + [(1, "train", 12, 5.0)]
    rows += [(2, "val", 20, 1.0), (2, "val", 21, 2.0), (2, "train", 22, 3.0)]
    log = spark.createDataFrame(rows, "epoch int, phase string, batch_id long, loss double")
    found = {r.epoch: (r.val_loss, r.train_loss) for r in m.epoch_summary(log).collect()}
    assert found == {0: (pytest.approx(16 / 3), pytest.approx(15.5 / 3)), 1: (None, None), 2: (1.5, 3.0)}
    assert {r.epoch: r.train_loss for r in m.epoch_summary(log, compat=True).collect()}[2] == 1.5
