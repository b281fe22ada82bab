import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm.token_counts import PrefixCounter, longest_within, prefix_counts, read_model, token_budget

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
COUNTER = PrefixCounter(read_model(MODEL))
PARTS = ["a", "b", "th", "ing", "tion", " ", "  ", " the", "\n", "\t", "▁", "é", "中", "😀", "</s>", "=", "--", "1"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), max_size=20).map("".join))
def test_every_prefix_equals_the_library(text):
    assert list(COUNTER.prefixes(text)) == [len(LIBRARY.encode(text[:k])) for k in range(len(text) + 1)]


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=60))
def test_any_text(text):
    assert COUNTER.prefixes(text)[-1] == len(LIBRARY.encode(text))


def test_long_word_is_linear():
    assert COUNTER.prefixes("ab" * 100_000)[-1] == len(LIBRARY.encode("ab" * 100_000))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "one two three", "x"), (2, None, "x"), (3, "", "x"), (1, "one two three", "x"), (None, "a" * 9000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, counts string")


def test_budget(docs):
    rows = sorted(token_budget(docs, MODEL, 100).collect(), key=repr)
    found = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in rows}
    n = len(LIBRARY.encode("one two three"))
    assert len(rows) == 5
    assert found == {
        (1, 13, n, False), (2, 0, 0, False), (3, 0, 0, False), (None, 9000, len(LIBRARY.encode("a" * 9000)), True)
    }
    cut = next(r.fit_chars for r in rows if r.doc_id is None)
    assert len(LIBRARY.encode("a" * cut)) <= 100 < len(LIBRARY.encode("a" * (cut + 16)))


def test_prefix_table(docs):
    counts = {r.doc_id: r.counts for r in prefix_counts(docs, MODEL).collect()}
    assert counts[2] == [0] and counts[1][3] == len(LIBRARY.encode("one"))
    assert longest_within(COUNTER.prefixes("one two"), 1) == 3


def test_empty_table(docs):
    assert token_budget(docs.limit(0), MODEL, 5).count() == 0


def test_query_counts_as_the_library(spark, sf_dir):
    from corpusmill.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for row in QUERIES["op1_token_counts"](spark, sf_dir).collect():
        assert row.n_tokens == len(LIBRARY.encode(texts[row.doc_id]))
