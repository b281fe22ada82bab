"""Named queries over the test tables, each with its SQL counterpart where SQL can express it."""

from __future__ import annotations

import hashlib
import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.constants import VOCAB_SIZE
from corpusmill.functions.text import pretokenize
from corpusmill.operators.bpe import train_bpe
from corpusmill.operators.encode import list_parts, rows_of
from corpusmill.operators.pair_parts import PART_PAIRS
from corpusmill.operators.ranking import range_rank
from corpusmill.operators.words import word_counts
from corpusmill.plans.oracle_bpe import WORD_PATTERN, encoded_docs, merge_tables
from corpusmill.session import materialize
from corpusmill.sources.corpus import TRAIN, VALIDATION, read_corpus
from corpusmill.sources.tokenizer_store import Tokenizer

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

# SQL learns a merge by a pass over all words, so its counterparts are for a small vocabulary.
SMALL_VOCAB = 192
# Upper bound of merges: specials and at least the ten digits and 52 letters come first.
SMALL_ROUNDS = SMALL_VOCAB - 3 - 62
# The test tables are single files; who runs the queries on them may name a number of tasks.
ONE_FILE_TASKS = int(os.environ.get("CORPUSMILL_TASKS", "0")) or None
# Epoch length of the training log that stands on ``events``.
EPOCH_STEPS = 2000

_tokenizers: dict[tuple[str, str, int], Tokenizer] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def vocabulary_query(sql: str) -> Callable[[Callable[[SparkSession, str, int], DataFrame]], Callable]:
    """Register a query with the whole vocabulary, and, beside its SQL, with a small one."""

    def register(function: Callable[[SparkSession, str, int], DataFrame]) -> Callable:
        QUERIES[function.__name__] = lambda spark, sf_dir: function(spark, sf_dir, VOCAB_SIZE)
        QUERIES["small_" + function.__name__] = lambda spark, sf_dir: function(spark, sf_dir, SMALL_VOCAB)
        ORACLE["small_" + function.__name__] = sql
        return function

    return register


def r9(value) -> Column:
    return F.round(value, 9)


# Tables the queries share -------------------------------------------------------------

SQL_CORPUS = (
    "select case when doc_id % 100 = 0 then 'validation' else 'train' end as split, doc_id, text from documents"
)
SQL_TOKENS = f"select split, doc_id, regexp_extract_all(text, '{WORD_PATTERN}') as tokens from ({SQL_CORPUS})"
SQL_METRICS = f"""
  select step, (step // {EPOCH_STEPS})::int as epoch, case when event_type = 'view' then 'val' else 'train' end as phase,
    step // 32 as batch_id, value as loss
  from (select row_number() over (order by ts, event_id) - 1 as step, event_type, value from events)"""
SQL_GENERATION_LOG = """
  select user_id as prompt, count(*) as tokens, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1000000.0::double as seconds
  from events group by user_id, cast(ts as date)"""


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    split = F.when(F.col("doc_id") % 100 == 0, VALIDATION).otherwise(TRAIN)
    return read_corpus(spark, f"{sf_dir}/documents.parquet", split, tasks=ONE_FILE_TASKS)


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).select("split", "doc_id", pretokenize("text").alias("tokens"))


def word_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids that need no vocabulary: the first seven hex digits of the word's md5."""
    return tokens(spark, sf_dir).select("split", "doc_id", md5_ids()("tokens").alias("input_ids"))


def md5_ids() -> Callable[[str], Column]:
    """Column function from words to the ids of :func:`word_ids`; each distinct word of a part of a batch is hashed once."""

    def hashed(words: pa.Array) -> pa.Array:
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
        ids = (int.from_bytes(hashlib.md5(word).digest()[:4], "big") >> 4 for word in distinct)
        ids = np.fromiter(ids, np.int32, len(coded.dictionary))[coded.indices.to_numpy(zero_copy_only=False)]
        return rows_of(words, ids, np.arange(len(ids) + 1))

    @F.arrow_udf("array<int>")
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.concat_arrays([hashed(batch.slice(start, size)) for start, size in list_parts(batch, PART_PAIRS)])

    return ids_of


SQL_WORD_IDS = f"""
  select split, doc_id, list_transform(tokens, lambda w: ('0x' || left(md5(w), 7))::int) as input_ids
  from ({SQL_TOKENS})"""


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("ts", "event_id", "event_type", "value")
    step = (F.col("pos") - 1).alias("step")
    return range_rank(events, ["ts", "event_id"]).select(
        step,
        F.floor((F.col("pos") - 1) / EPOCH_STEPS).cast("int").alias("epoch"),
        F.when(F.col("event_type") == "view", "val").otherwise("train").alias("phase"),
        F.floor((F.col("pos") - 1) / 32).alias("batch_id"),
        F.col("value").alias("loss"),
    )


def generation_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    grouped = events.groupBy(F.col("user_id").alias("prompt"), F.to_date("ts").alias("day"))
    return grouped.agg(
        F.count(F.lit(1)).alias("tokens"), ((F.max(micros) - F.min(micros)) / F.lit(1000000.0)).alias("seconds")
    ).drop("day")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(conv_id, turn, prompt, result)``: a user turn and the assistant's next turn."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("prompt"))
    answered = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), "text")
    joined = asked.join(answered, ["conv_id", "turn"])
    return joined.select("conv_id", "turn", "prompt", F.concat_ws(" ", "prompt", "text").alias("result"))


SQL_CONVERSATIONS = """
  select a.conv_id, a.turn, a.text as prompt, a.text || ' ' || b.text as result
  from conversations a join conversations b on b.conv_id = a.conv_id and b.turn = a.turn + 1
  where a.role = 'user' and b.role = 'assistant'"""


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def tokenizer(spark: SparkSession, sf_dir: str, vocab_size: int = VOCAB_SIZE) -> Tokenizer:
    """Learned once per session and scale from all documents."""
    key = (spark.sparkContext.applicationId, sf_dir, vocab_size)
    if key not in _tokenizers:
        words = materialize(word_counts(corpus(spark, sf_dir)), "word-counts")
        _tokenizers[key] = train_bpe(words, vocab_size)
    return _tokenizers[key]


SQL_BPE = "with " + merge_tables("select text from documents", SMALL_VOCAB, SMALL_ROUNDS)
SQL_ENCODED = SQL_BPE + "," + encoded_docs(SQL_CORPUS)
