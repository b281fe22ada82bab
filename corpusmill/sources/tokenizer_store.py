"""The learned tokenizer and its storage as two Parquet tables or as one JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.constants import SPECIAL_TOKENS
from corpusmill.session import write_file

VOCAB_SCHEMA = "token_id int, token string, is_special boolean"
MERGES_SCHEMA = "rank int, left string, right string, merged string"


@dataclass(frozen=True)
class Tokenizer:
    """Vocabulary (index = token id) and ordered merges; both are bounded by the vocabulary size."""

    vocab: tuple[str, ...]
    merges: tuple[tuple[str, str], ...]
    specials: tuple[str, ...] = SPECIAL_TOKENS

    @property
    def vocab_size(self) -> int:
        return len(self.vocab)

    def vocab_table(self, spark: SparkSession) -> DataFrame:
        rows = [(i, token, i < len(self.specials)) for i, token in enumerate(self.vocab)]
        return spark.createDataFrame(rows, VOCAB_SCHEMA)

    def merges_table(self, spark: SparkSession) -> DataFrame:
        rows = [(rank, l, r, l + r) for rank, (l, r) in enumerate(self.merges)]
        return spark.createDataFrame(rows, MERGES_SCHEMA)


def vocab_size(vocab: DataFrame) -> DataFrame:
    return vocab.agg(F.count(F.lit(1)).alias("vocab_size"))


def save_tokenizer(spark: SparkSession, tokenizer: Tokenizer, path: str) -> None:
    tokenizer.vocab_table(spark).write.mode("overwrite").parquet(f"{path}/vocab")
    tokenizer.merges_table(spark).write.mode("overwrite").parquet(f"{path}/merges")


def load_tokenizer(spark: SparkSession, path: str) -> Tokenizer:
    vocab = spark.read.schema(VOCAB_SCHEMA).parquet(f"{path}/vocab").orderBy("token_id").collect()
    merges = spark.read.schema(MERGES_SCHEMA).parquet(f"{path}/merges").orderBy("rank").collect()
    return Tokenizer(
        tuple(row.token for row in vocab),
        tuple((row.left, row.right) for row in merges),
        tuple(row.token for row in vocab if row.is_special),
    )


def tokenizer_json(tokenizer: Tokenizer) -> str:
    """The tokenizer in the JSON layout that the public ``tokenizers`` library reads."""
    unknown = tokenizer.specials[0] if tokenizer.specials else None
    flags = {"single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": True}
    return json.dumps(
        {
            "version": "1.0",
            "truncation": None,
            "padding": None,
            "added_tokens": [{"id": i, "content": token, **flags} for i, token in enumerate(tokenizer.specials)],
            "normalizer": None,
            "pre_tokenizer": {"type": "Whitespace"},
            "post_processor": None,
            "decoder": None,
            "model": {
                "type": "BPE",
                "dropout": None,
                "unk_token": unknown,
                "continuing_subword_prefix": None,
                "end_of_word_suffix": None,
                "fuse_unk": False,
                "byte_fallback": False,
                "ignore_merges": False,
                "vocab": {token: i for i, token in enumerate(tokenizer.vocab)},
                "merges": [list(pair) for pair in tokenizer.merges],
            },
        },
        ensure_ascii=False,
    )


def tokenizer_from_json(text: str) -> Tokenizer:
    """The tokenizer in such a JSON layout; a layout this package cannot encode with is an error."""
    layout = json.loads(text)
    model = layout["model"]
    cutter = (layout.get("pre_tokenizer") or {}).get("type")
    if model.get("type", "BPE") != "BPE" or cutter != "Whitespace" or layout.get("normalizer"):
        raise ValueError("only byte-pair models over white-space words, without a normalizer, can be read")
    ordered = sorted(model["vocab"].items(), key=lambda entry: entry[1])
    added = sorted(layout.get("added_tokens") or [], key=lambda token: token["id"])
    specials = tuple(token["content"] for token in added if token.get("special"))
    vocab = tuple(token for token, _ in ordered)
    if [i for _, i in ordered] != list(range(len(ordered))) or vocab[: len(specials)] != specials:
        raise ValueError("token ids must run from 0 without gaps, special tokens first")
    # Older files hold a merge as one string.
    merges = (tuple(merge.split(" ")) if isinstance(merge, str) else tuple(merge) for merge in model["merges"])
    return Tokenizer(vocab, tuple(merges), specials)


def write_tokenizer_json(spark: SparkSession, tokenizer: Tokenizer, path: str) -> None:
    write_file(spark, path, tokenizer_json(tokenizer))


def read_tokenizer_json(spark: SparkSession, path: str) -> Tokenizer:
    return tokenizer_from_json(spark.read.text(path, wholetext=True).first().value)
