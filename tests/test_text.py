import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.functions.text import clamp, normalize_text, preview, pretokenize


def _pieces(spark, text, **options):
    return spark.createDataFrame([(text,)], "text string").select(pretokenize("text", **options)).first()[0]


@pytest.mark.parametrize(
    "text, pieces",
    [
        ("Héllo, wörld_1!! x", ["Héllo", ",", "wörld_1", "!!", "x"]),
        ("", []),
        (" \t\r\n  ", []),
        ("a‍b café", ["a‍b", "café"]),
        ("中文 😀😀", ["中文", "😀😀"]),
    ],
)
def test_pieces(spark, text, pieces):
    assert _pieces(spark, text) == pieces


def test_special_tokens_are_kept_whole(spark):
    text = "x!!<|im_end|>!!y <|im_start|><|unknown|>z<|im_end"
    expected = ["x", "!!", "<|im_end|>", "!!", "y", "<|im_start|>", "<|unknown|>", "z", "<|", "im_end"]
    assert _pieces(spark, text, keep_specials=True) == expected


def test_long_punctuation_run(spark):
    assert _pieces(spark, "=" * 100_000, keep_specials=True) == ["=" * 100_000]


def test_missing_text_follows_a_pandas_csv_read(spark, tmp_path):
    texts = ["", "NA", "None", "null", "nan", "NaN", "n/a", " NA", "na", "NONE", "a", "<NA>", "#N/A", "nul"]
    path = tmp_path / "texts.csv"
    pd.DataFrame({"text": texts}).to_csv(path)
    expected = [str(text) for text in pd.read_csv(path)["text"]]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "i int, text string")
    assert [r.text for r in normalize_text(rows, null_policy="nan").orderBy("i").collect()] == [*expected, "nan"]
    kept = [r.text for r in normalize_text(rows).orderBy("i").collect()]
    assert kept == [t for t, e in zip(texts, expected) if e != "nan"]
    with pytest.raises(ValueError):
        normalize_text(rows, null_policy="other")


def test_preview_matches_slicing(spark):
    rows = [("ab", "ab \t cd \r\n"), ("😀", "😀" + "x" * 200), ("a", "a"), ("abc", "ab")]
    table = spark.createDataFrame(rows, "prompt string, result string")
    got = [r[0] for r in table.select(preview("prompt", "result")).collect()]
    assert got == [result[len(prompt):].strip()[:100] for prompt, result in rows]


def test_clamp_keeps_nulls(spark):
    table = spark.createDataFrame([(0,), (7,), (900,), (None,)], "v int")
    assert [r[0] for r in table.select(clamp("v", 1, 500)).collect()] == [1, 7, 500, None]
    assert spark.range(1).select(clamp(F.lit(5.0), 0.1, 2.0)).first()[0] == 2.0
