import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_bpe import library_tokenizer

from corpusmill.functions.text import pretokenize
from corpusmill.operators import encode as encode_module
from corpusmill.operators.bpe import train_bpe
from corpusmill.operators.encode import (
    decode, encode, encode_by_dictionary, exact_quantile, length_stats, token_usage,
)
from corpusmill.operators.words import word_counts
from corpusmill.plans.prepare import fixed_length, learn_tokenizer, prepare
from corpusmill.session import materialize
from corpusmill.sources.tokenizer_store import Tokenizer

EDGES = [
    "a <|im_end|> b", "中文 😀😀", "", None, "x!!<|im_end|>!!y <|im_start|><|unknown|>z<|im_end", "=" * 30_000,
    "Hi there!", "<|im_end|>", "two\nlines\r\n",
]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return materialize(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@pytest.fixture(scope="module")
def library(docs):
    return library_tokenizer([r.text for r in docs.orderBy("doc_id").collect()], 600)


@pytest.fixture(scope="module")
def tokenizer(library):
    import json

    model = json.loads(library.to_str())["model"]
    return Tokenizer(tuple(sorted(model["vocab"], key=model["vocab"].get)), tuple(map(tuple, model["merges"])))


@pytest.fixture(scope="module")
def edges(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(EDGES)], "doc_id long, text string")


def _by_id(df, column):
    return [r[column] for r in df.orderBy("doc_id").collect()]


def test_encode_equals_the_library(docs, edges, library, tokenizer):
    texts = _by_id(docs, "text")
    expected = [e.ids for e in library.encode_batch(texts)]
    for parts in (1, 5):
        assert _by_id(materialize(encode(docs.repartition(parts), tokenizer)), "input_ids") == expected
    expected = [None if t is None else library.encode(t).ids for t in EDGES]
    assert _by_id(materialize(encode(edges, tokenizer)), "input_ids") == expected


def test_encode_by_dictionary_equals_the_row_local_form(docs, edges, tokenizer):
    both = docs.unionByName(edges.withColumn("doc_id", F.col("doc_id") + 1_000_000).where("text is not null"))
    words = both.select(F.explode(pretokenize("text", keep_specials=True)).alias("word")).groupBy("word")
    joined = encode_by_dictionary(both, words.agg(F.count(F.lit(1)).alias("n")), tokenizer)
    assert _by_id(joined, "input_ids") == _by_id(encode(both, tokenizer), "input_ids")


def test_a_word_is_joined_once_per_part_and_parts_may_be_small(spark, docs, edges, tokenizer, monkeypatch):
    both = docs.limit(40).unionByName(edges.withColumn("doc_id", F.col("doc_id") + 1_000_000))
    words = word_counts(docs.limit(20))
    expected = [ids or [] for ids in _by_id(encode(both, tokenizer), "input_ids")]
    assert _by_id(encode_by_dictionary(both, words, tokenizer), "input_ids") == expected
    coded = encode_module._coded(both.select("doc_id", pretokenize("text", keep_specials=True).alias("words")).coalesce(1), "doc_id")
    assert coded.count() == 1 and all(len(r.words) == len(set(r.words)) for r in coded.collect())
    monkeypatch.setattr(encode_module, "PART_WORDS", 50)
    parts = list(encode_module.list_parts(pa.array([["a"] * n for n in (20, 30, 1, 80, 0, 50)] + [None])))
    assert parts == [(0, 2), (2, 1), (3, 1), (4, 3)]
    assert list(encode_module.list_parts(pa.array([], pa.list_(pa.string())))) == [(0, 0)]


def test_rows_with_one_key_are_encoded_as_one(spark, tokenizer):
    rows = spark.createDataFrame([(1, "b c a"), (1, "a d"), (None, "x"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: r.input_ids for r in encode_by_dictionary(rows, word_counts(rows), tokenizer).collect()}
    a, b, c, d, x = (tokenizer.vocab.index(ch) for ch in "abcdx")
    assert found == {1: [a, b, c, d, a], None: [x], 2: []}


def test_decode_equals_the_library(docs, library, tokenizer):
    encoded = materialize(fixed_length(encode(docs, tokenizer), 300))
    decoded = encoded.withColumn("decoded", decode("input_ids", tokenizer))
    rows = decoded.orderBy("doc_id").collect()
    assert [r.decoded for r in rows] == library.decode_batch([r.input_ids for r in rows])


def test_token_usage_counts_every_token(docs, tokenizer):
    used = {r.token_id: r.n for r in token_usage(word_counts(docs), tokenizer).collect()}
    exploded = encode(docs, tokenizer).select(F.explode("input_ids").alias("i")).groupBy("i").count().collect()
    assert used == {r.i: r["count"] for r in exploded}


@pytest.mark.parametrize("n", [4, 5, 6])
def test_fixed_length(spark, tokenizer, n):
    rows = fixed_length(spark.createDataFrame([(0, [9, 8, 7, 6, 5])], "doc_id long, input_ids array<int>"), n).first()
    assert rows.input_ids == ([9, 8, 7, 6, 5] + [2] * n)[:n] and rows.n_tokens == 5


def test_length_profile(spark):
    rows = [("train", list(range(k))) for k in (0, 2, 4, 10)]
    stats = length_stats(spark.createDataFrame(rows, "split string, input_ids array<int>"), n=4).first()
    assert (stats.n_rows, stats.mean_tokens, stats.max_tokens, stats.n_truncated) == (4, 4.0, 10, 1)
    assert stats.pad_share == pytest.approx(6 / 16)


def test_medians_are_exact(spark):
    lengths = spark.range(30_001).select(F.lit("train").alias("split"), (F.col("id") % 997).cast("int").alias("size"))
    counts = lengths.groupBy("split", "size").agg(F.count(F.lit(1)).alias("n"))
    ordered = sorted(i % 997 for i in range(30_001))
    for q in (0.0, 0.25, 0.5, 0.999, 1.0):
        at = max(0, -(-int(q * 1000) * 30_001 // 1000) - 1)
        assert exact_quantile(counts, "size", q, ["split"]).first().quantile == ordered[at]
    rows = spark.createDataFrame([(None, [1, 2]), (None, None), ("a", []), ("a", None)], "split string, input_ids array<int>")
    found = {r.split: r for r in length_stats(rows, n=4).collect()}
    assert (found[None].n_rows, found[None].median_tokens, found["a"].median_tokens, found["a"].pad_share) == (2, 2, 0, 1.0)


def test_preparation_samples_before_encoding(docs, tokenizer, library):
    corpus = docs.withColumn("split", F.when(F.col("doc_id") % 100 == 0, "validation").otherwise("train"))
    rows = prepare(corpus, tokenizer, 200, train_count=20, validation_count=-1).collect()
    library.enable_padding(pad_id=2, pad_token="<|im_end|>", length=200)
    library.enable_truncation(max_length=200)
    try:
        texts = {r.doc_id: r.text for r in docs.collect()}
        assert sum(r.split == "train" for r in rows) == 20
        assert sum(r.split == "validation" for r in rows) == sum(i % 100 == 0 for i in texts)
        for row in rows:
            assert row.input_ids == library.encode(texts[row.doc_id]).ids
    finally:
        library.no_padding()
        library.no_truncation()


def test_learning_from_a_corpus_drops_missing_texts(spark):
    corpus = spark.createDataFrame([("ab ab",), (None,), ("NA",), ("ab",)], "text string")
    assert learn_tokenizer(corpus, 100).vocab[3:] == ("a", "b", "ab")
    kept = learn_tokenizer(corpus, 100, null_policy="nan").vocab
    assert "n" in kept and train_bpe(word_counts(corpus.where("text = 'ab'")), 100).vocab[3:] == ("a", "b", "ab")


def test_long_words_merge_quickly_and_alike():
    import random
    import time

    from corpusmill.operators.encode import merge_word

    rng = random.Random(4)
    for _ in range(300):
        merges, merged = {}, []
        for rank in range(12):
            pair = (rng.randrange(3 + rank), rng.randrange(3 + rank))
            if pair not in merges:
                merges[pair] = len(merged)
                merged.append(3 + len(merged))
        word = [rng.randrange(3) for _ in range(rng.randrange(30))]
        plain = list(word)
        while ranks := [(merges[p], i) for i, p in enumerate(zip(plain, plain[1:])) if p in merges]:
            rank, i = min(ranks)
            plain[i : i + 2] = [merged[rank]]
        assert merge_word(word, merges, merged) == plain
    start = time.perf_counter()
    assert len(merge_word([0] * 1_000_000, {(0, 0): 0, (1, 1): 1}, [1, 2])) == 250_000
    assert time.perf_counter() - start < 60


def test_dictionary_without_special_tokens_loses_nothing(edges, tokenizer):
    words = materialize(word_counts(edges))
    joined = {row.doc_id: row.input_ids for row in encode_by_dictionary(edges, words, tokenizer).collect()}
    for row in encode(edges, tokenizer).collect():
        assert joined[row.doc_id] == (row.input_ids or [])


def test_prepared_rows_of_missing_texts_are_full(edges, tokenizer):
    corpus = edges.withColumn("split", F.lit("train"))
    rows = prepare(corpus, tokenizer, 50, train_count=-1).collect()
    assert len(rows) == len(EDGES) and all(len(row.input_ids) == 50 for row in rows)
