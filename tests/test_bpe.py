import json
import random
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer as LibraryTokenizer
from tokenizers.models import BPE
from tokenizers.pre_tokenizers import Whitespace
from tokenizers.trainers import BpeTrainer

from corpusmill.constants import SPECIAL_TOKENS
from corpusmill.operators import bpe, bpe_blocks
from corpusmill.operators.bpe_blocks import Block, flat_symbols
from corpusmill.operators.words import alphabet, word_counts
from corpusmill.session import materialize
from corpusmill.sources.tokenizer_store import (
    load_tokenizer, read_tokenizer_json, save_tokenizer, tokenizer_from_json, tokenizer_json, write_tokenizer_json,
)


def library_tokenizer(texts, vocab_size):
    tokenizer = LibraryTokenizer(BPE(unk_token=SPECIAL_TOKENS[0]))
    tokenizer.pre_tokenizer = Whitespace()
    trainer = BpeTrainer(
        special_tokens=list(SPECIAL_TOKENS), vocab_size=vocab_size, min_frequency=1, show_progress=False
    )
    tokenizer.train_from_iterator(texts, trainer)
    return tokenizer


def _library_merges(tokenizer):
    return [tuple(pair) for pair in json.loads(tokenizer.to_str())["model"]["merges"]]


def _random_text(rng, letters, words=60):
    return " ".join("".join(rng.choice(letters) for _ in range(rng.randint(1, 14))) for _ in range(words))


def _merges_on_plain_lists(text, vocab_size):
    """The rounds of the learner with pair counting and merging done on Python lists."""
    words = Counter(text.split())
    chars = sorted(set(text) - {" "})
    state = {word: [ord(ch) for ch in word] for word in words}
    spell, merges = {ord(ch): ch for ch in chars}, []
    by_text = {ch: symbol for symbol, ch in spell.items()}
    size = len(chars) + len(SPECIAL_TOKENS)
    while size < vocab_size:
        pairs = _pairs(words, state)
        ranked = [(l, r, c) for (l, r), c in sorted(pairs.items(), key=lambda p: (-p[1], p[0]))]
        batch = bpe.independent_prefix(ranked, spell, set(by_text), vocab_size - size, 1)
        if not batch:
            break
        for l, r in batch:
            merged = spell[l] + spell[r]
            merges.append((spell[l], spell[r]))
            if merged not in by_text:
                by_text[merged] = bpe.FIRST_MERGED + size
                spell[by_text[merged]] = merged
                size += 1
            for symbols in state.values():
                _merge(symbols, l, r, by_text[merged])
    return merges


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh", "abcdefghijklmnop"])
def test_batched_rounds_equal_the_library(letters):
    rng = random.Random(letters)
    for _ in range(60):
        text = _random_text(rng, letters)
        assert _merges_on_plain_lists(text, 60) == _library_merges(library_tokenizer([text], 60))


def _merge(symbols, l, r, merged):
    at = 0
    while at + 1 < len(symbols):
        if (symbols[at], symbols[at + 1]) == (l, r):
            symbols[at : at + 2] = [merged]
        at += 1


def _pairs(words, state):
    pairs = Counter()
    for word, symbols in state.items():
        for pair in zip(symbols, symbols[1:]):
            pairs[pair] += words[word]
    return pairs


class PlainBlocks:
    """The learner's jobs on blocks in memory."""

    def __init__(self, words, per_block):
        items = list(words.items())
        self.blocks = []
        for i in range(0, len(items), per_block):
            part = items[i : i + per_block]
            self.blocks.append(Block(flat_symbols([w for w, _ in part]), np.array([n for _, n in part], np.int64)))

    def merge(self, pending):
        self.blocks = [Block.read(dict(zip(("symbols", "counts", "pairs", "starts", "words"), b.after(pending).row())))
                       for b in self.blocks]

    def changes(self, pending, steps):
        total = [Counter() for _ in steps]
        for block in self.blocks:
            for step, code, w in zip(*(x.tolist() for x in block.changes(pending, steps))):
                total[step][code] += w
        return [[(code, w) for code, w in step.items() if w] for step in total]

    def counts(self, pending):
        total = Counter()
        for block in self.blocks:
            total.update(dict(zip(*(x.tolist() for x in block.pair_counts(pending)))))
        best = sorted(total.items(), key=lambda pair: (-pair[1], pair[0]))[: bpe.PAIRS_HELD]
        return bpe.PairCounts([c for c, _ in best], [n for _, n in best], len(best) < bpe.PAIRS_HELD)


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh", "abcdefghijklmnop"])
@pytest.mark.parametrize("held", [1, 3, 10, 1024])
def test_look_ahead_rounds_equal_the_library(letters, held, monkeypatch):
    monkeypatch.setattr(bpe, "PAIRS_HELD", held)
    monkeypatch.setattr(bpe, "MERGES_PER_WRITE", 7)
    rng = random.Random(letters + str(held))
    for _ in range(25):
        text = _random_text(rng, letters)
        vocabulary = bpe.Vocabulary.start(SPECIAL_TOKENS, sorted(set(text) - {" "}))
        bpe.learn_merges(PlainBlocks(Counter(text.split()), rng.choice([1, 9, 100])), vocabulary, 60, 1)
        assert vocabulary.merges == _library_merges(library_tokenizer([text], 60))


@pytest.mark.parametrize("letters", ["ab", "abc", "abcdefgh"])
def test_changes_of_a_trial_equal_a_recount(letters):
    words = Counter(_random_text(random.Random(5), letters, 200).split())
    state = {word: [ord(ch) for ch in word] for word in words}
    merges = [(97, 98, 1001), (1001, 97, 1002), (98, 98, 1003), (98, 1002, 1004), (97, 97, 1005)]
    found = PlainBlocks(words, 30).changes(merges[:1], merges[1:])
    for step, merge in enumerate(merges):
        before = _pairs(words, state)
        for symbols in state.values():
            _merge(symbols, *merge)
        after = _pairs(words, state)
        moved = {(p[0] << 32) | p[1]: after[p] - before[p] for p in before | after if after[p] != before[p]}
        assert step == 0 or dict(found[step - 1]) == moved
    counts = PlainBlocks(words, 30).counts(merges)
    assert counts.count == {(l << 32) | r: c for (l, r), c in _pairs(words, state).items() if c}


def test_a_run_of_merges_reads_only_the_words_of_their_pairs(monkeypatch):
    read = []
    pairs_of = bpe_blocks.Run.places
    monkeypatch.setattr(bpe_blocks.Run, "places", lambda run, words: (read.append(len(words)), pairs_of(run, words))[1])
    words = [f"{chr(0x4E00 + i)}{chr(0x4E01 + i)}{chr(0x4E02 + i)}" for i in range(0, 3000, 3)]
    block = Block(flat_symbols(words), np.ones(len(words), np.int64))
    steps = [m for i in range(50) for m in ((ord(words[i][0]), ord(words[i][1]), 1 << 21 | i), (1 << 21 | i, ord(words[i][2]), 1 << 22 | i))]
    step, _, difference = block.changes(steps[:40], steps[40:])
    assert len(np.unique(step)) == 60 and difference.min() == -1
    assert sum(read) <= 4 * len(steps)


@pytest.mark.parametrize("letters", ["ab", "abcdé😀"])
def test_training_equals_the_library(spark, letters):
    text = _random_text(random.Random(7), letters)
    words = word_counts(spark.createDataFrame([(text,)], "text string"))
    learned = bpe.train_bpe(materialize(words), 48)
    library = library_tokenizer([text], 48)
    assert list(learned.merges) == _library_merges(library)
    assert {t: i for i, t in enumerate(learned.vocab)} == library.get_vocab()


def test_training_on_documents_equals_the_library_for_any_partitioning(spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    library = library_tokenizer([r.text for r in docs.collect()], 150)
    monkeypatch.setattr(bpe, "MERGES_PER_WRITE", 8)
    monkeypatch.setattr(bpe_blocks, "BLOCK_WORDS", 500)
    for parts in (1, 7):
        learned = bpe.train_bpe(materialize(word_counts(docs.repartition(parts))), 150)
        assert list(learned.merges) == _library_merges(library)
        assert {t: i for i, t in enumerate(learned.vocab)} == library.get_vocab()


def test_training_stops_when_no_pair_is_left(spark):
    words = spark.createDataFrame([("ab", 3), ("c", 1)], "word string, n long")
    learned = bpe.train_bpe(words, 2048)
    assert learned.vocab == (*SPECIAL_TOKENS, "a", "b", "c", "ab")
    assert bpe.train_bpe(words, 2048, min_frequency=4).merges == ()


def test_merges_do_not_overlap(spark):
    words = spark.createDataFrame([("aaaaa",), ("aab",)], "word string")
    symbols = bpe.symbols_of("word")
    rows = words.select(bpe.apply_merges(symbols, [(97, 97, 1)])).collect()
    assert [r[0].split() for r in rows] == [["1", "1", "97"], ["1", "98"]]


def test_alphabet_is_in_code_point_order(spark):
    words = spark.createDataFrame([("zé😀",), ("aZ中",)], "word string")
    rows = alphabet(words).orderBy("token_id").collect()
    assert [r.ch for r in rows] == sorted("zé😀aZ中") and [r.token_id for r in rows] == list(range(3, 9))


def test_store_round_trip_and_library_json(spark, tmp_path):
    words = spark.createDataFrame([("hello", 3), ("help", 2), ("low", 1)], "word string, n long")
    learned = bpe.train_bpe(words, 14)
    save_tokenizer(spark, learned, str(tmp_path / "tokenizer"))
    assert load_tokenizer(spark, str(tmp_path / "tokenizer")) == learned
    library = LibraryTokenizer.from_str(tokenizer_json(learned))
    assert library.get_vocab() == {t: i for i, t in enumerate(learned.vocab)}
    assert _library_merges(library) == list(learned.merges)
    path = str(tmp_path / "tokenizer.json")
    write_tokenizer_json(spark, learned, path)
    assert read_tokenizer_json(spark, path) == learned
    assert LibraryTokenizer.from_file(path).get_vocab() == library.get_vocab()
    assert tokenizer_from_json(library.to_str(pretty=True)) == learned
    with pytest.raises(ValueError):
        tokenizer_from_json(tokenizer_json(learned).replace('"Whitespace"', '"ByteLevel"'))
