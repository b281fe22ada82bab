"""The queries with the whole vocabulary against the public library and a plain walk."""

import hashlib
import json
import math
from collections import Counter, defaultdict

import __spark_entry__ as contract
import pytest
from test_bpe import _library_merges, library_tokenizer

from corpusmill.constants import BLOCK_SIZE, PAD_ID, SPECIAL_TOKENS, VOCAB_SIZE
from corpusmill.plans.registry import tokenizer


@pytest.fixture(scope="module")
def texts(spark, sf_dir):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def library(texts):
    return library_tokenizer([texts[i] for i in sorted(texts)], VOCAB_SIZE)


@pytest.fixture(scope="module")
def ids(texts, library):
    return {i: library.encode(t).ids for i, t in texts.items()}


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    return lambda name: contract.queries()[name](spark, sf_dir).collect()


def fixed(row):
    return " ".join(map(str, (row + [PAD_ID] * BLOCK_SIZE)[:BLOCK_SIZE]))


def test_merges(run, library):
    rows = sorted(run("learned_merges"))
    expected = _library_merges(library)
    assert len(expected) > 1900
    assert [tuple(r) for r in rows] == [(i, l, r, l + r) for i, (l, r) in enumerate(expected)]
    assert run("vocabulary_size")[0].vocab_size == VOCAB_SIZE


def test_stores(run, library):
    vocab = {i: t for t, i in library.get_vocab().items()}
    rows = [("token", i, t, "special" if t in SPECIAL_TOKENS else "plain") for i, t in vocab.items()]
    rows += [("merge", i, l, r) for i, (l, r) in enumerate(_library_merges(library))]
    assert {tuple(r) for r in run("tokenizer_round_trip")} == {(store, *r) for store in ("tables", "json") for r in rows}


@pytest.mark.parametrize("name", ["encoded_documents", "encoded_by_dictionary"])
def test_encoding(run, ids, name):
    assert {r.doc_id: r.ids for r in run(name)} == {i: " ".join(map(str, v)) for i, v in ids.items()}


def test_decoding(run, library, ids):
    assert {r.doc_id: r.decoded for r in run("decoded_documents")} == {i: library.decode(v) for i, v in ids.items()}


def test_usage_and_lengths(run, ids):
    used = Counter(i for v in ids.values() for i in v)
    assert {r.token_id: r.n for r in run("token_frequencies")} == used
    for row in run("token_length_profile"):
        sizes = sorted(len(v) for i, v in ids.items() if (i % 100 == 0) == (row.split == "validation"))
        assert (row.n_rows, row.max_tokens, row.n_truncated) == (len(sizes), sizes[-1], sum(s > BLOCK_SIZE for s in sizes))
        assert row.median_tokens == sizes[math.ceil(len(sizes) / 2) - 1]
        assert row.mean_tokens == pytest.approx(sum(sizes) / len(sizes))


def test_datasets(run, ids):
    assert {r.doc_id: r.input_ids for r in run("streamed_documents")} == {i: fixed(v) for i, v in ids.items()}
    validation = {i: fixed(v) for i, v in ids.items() if i % 100 == 0}
    assert {r.doc_id: r.input_ids for r in run("dataset_split_scan")} == validation
    rows = run("prepared_dataset")
    assert {r.doc_id: r.input_ids for r in rows if r.split == "validation"} == validation
    train = sorted((i for i in ids if i % 100), key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))[:100]
    assert {r.doc_id: (r.input_ids, r.n_tokens) for r in rows if r.split == "train"} == {i: (fixed(ids[i]), len(ids[i])) for i in train}


def test_generation_from_text_to_text(spark, sf_dir, run, library, ids):
    """Draws from the 50 most frequent next ids, ties kept, at temperature 0.8, step by step."""
    counts = defaultdict(Counter)
    for i, row in ids.items():
        if i % 100:
            for a, b in zip(row, row[1:]):
                counts[a][b] += 1
    grids = {}
    for ctx, found in counts.items():
        border = sorted(found.values(), reverse=True)[:50][-1]
        weights = {t: c ** (1 / 0.8) for t, c in found.items() if c >= border}
        total = sum(weights.values())
        order = sorted(weights, key=lambda t: (hashlib.md5(str(t).encode()).hexdigest()[:2], t))
        sizes = [max(1, round(weights[t] / total * (1 << 30))) for t in order]
        ends = [sum(sizes[: i + 1]) * (1 << 32) // sum(sizes) for i in range(len(sizes))]
        grids[ctx] = list(zip(ends, order))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'").collect()
    expected = {}
    for turn in turns:
        key = turn.conv_id * 1000 + turn.turn
        prompt = library.encode(turn.text).ids[-BLOCK_SIZE:]
        new = []
        while prompt and len(new) < 100 and (prompt + new)[-1] in grids:
            draw = int(hashlib.md5(f"42:{len(new)}:{key}".encode()).hexdigest()[:8], 16)
            new.append(next(t for end, t in grids[(prompt + new)[-1]] if draw < end))
        shown = library.decode(prompt + new)[len(library.decode(prompt)) :].strip(" \t\r\n")[:100]
        expected[key] = (len(new), shown)
    assert {r.prompt_id: (r.n_new, r.preview) for r in run("generated_previews")} == expected
    assert any(n == 100 for n, _ in expected.values())


def test_library_reads_the_stored_json(spark, sf_dir, library, texts):
    from tokenizers import Tokenizer

    from corpusmill.sources.tokenizer_store import tokenizer_json

    stored = Tokenizer.from_str(tokenizer_json(tokenizer(spark, sf_dir)))
    assert json.loads(stored.to_str())["model"]["merges"] == json.loads(library.to_str())["model"]["merges"]
    text = texts[min(texts)]
    assert stored.encode(text).ids == library.encode(text).ids
