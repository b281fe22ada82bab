from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from corpusmill.functions.arrays import crop_last, pad, shift_targets, truncate
from corpusmill.operators.targets import mask_targets, target_pairs, with_targets


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.integers(0, 99), max_size=12), min_size=1, max_size=20), st.integers(1, 9))
def test_array_functions(spark, arrays, n):
    table = spark.createDataFrame([(i, a) for i, a in enumerate(arrays)], "i int, ids array<int>")
    rows = table.select(
        "ids", truncate("ids", n).alias("cut"), pad(truncate("ids", n), n).alias("fixed"),
        crop_last("ids", n).alias("last"), shift_targets("ids").alias("targets"),
    ).collect()
    for row in rows:
        assert row.cut == row.ids[:n] and row.last == row.ids[-n:]
        assert row.fixed == (row.ids + [2] * n)[:n]
        assert row.targets == (row.ids[1:] + [2] if row.ids else [])


def test_pairs_and_mask(spark):
    table = with_targets(spark.createDataFrame([(7, [5, 6, 2, 2], 2)], "doc_id long, input_ids array<int>, n_tokens int"))
    pairs = target_pairs(table, ["doc_id", "n_tokens"])
    rows = sorted((r.pos, r.input, r.target) for r in pairs.collect())
    assert rows == [(0, 5, 6), (1, 6, 2), (2, 2, 2), (3, 2, 2)]
    assert mask_targets(pairs).count() == 4
    assert sorted(r.pos for r in mask_targets(pairs, include_pad=False).collect()) == [0, 1]
