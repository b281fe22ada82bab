"""Queries on the tokenizer, the dataset operators and the targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.constants import BLOCK_SIZE
from corpusmill.functions.arrays import crop_last, pad, truncate
from corpusmill.functions.text import pretokenize
from corpusmill.operators.bpe import apply_merges, best_pairs, pair_counts, symbol_words, symbols_of
from corpusmill.operators.encode import decode, encode, encode_by_dictionary, length_stats, token_usage
from corpusmill.operators.sampling import (
    HASH_FACTOR, HASH_PRIME, Permutation, batches, epoch_order, epoch_permutation, first_by_priority, limit_batches,
    numbered_rows, sample_n, total_steps,
)
from corpusmill.operators.targets import mask_targets, target_pairs, with_targets
from corpusmill.operators.words import word_counts
from corpusmill.plans.prepare import fixed_length, prepare
from corpusmill.plans.registry import (
    SQL_BPE, SQL_CORPUS, SQL_ENCODED, SQL_TOKENS, SQL_WORD_IDS, corpus, query, tokenizer, tokens, vocabulary_query, word_ids,
)
from corpusmill.session import materialize, scratch_path
from corpusmill.sources.corpus import read_dataset, write_dataset
from corpusmill.sources.tokenizer_store import vocab_size as vocab_rows
from corpusmill.streaming.streams import stream_prepare, write_available

_SQL_SYMBOLS = f"""
words as materialized (select word, count(*) as n from (select unnest(tokens) as word from ({SQL_TOKENS})) group by word),
symbols as materialized (
  select word, n, array_to_string(list_transform(string_split(word, ''), lambda c: ' ' || unicode(c) || ' '), '') as s
  from words),
pairs as materialized (
  select string_split(z, '  ')[1]::int as l, string_split(z, '  ')[2]::int as r, sum(n)::bigint as c from (
    select unnest(list_transform(list_zip(a[:-2], a[2:]), lambda z: z[1] || '  ' || z[2])) as z, n
    from (select string_split(trim(s), '  ') as a, n from symbols where contains(s, '  ')))
  group by l, r)"""


@query(f"with {_SQL_SYMBOLS} select l, r, c from pairs")
def symbol_pair_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_counts(symbol_words(word_counts(corpus(spark, sf_dir))))


@query(f"with {_SQL_SYMBOLS} select l, r, c from pairs order by c desc, l, r limit 50")
def best_symbol_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_pairs(pair_counts(symbol_words(word_counts(corpus(spark, sf_dir)))), 50)


_SQL_SPELLED = f"""
select word, n, list_transform(string_split(word, ''), lambda c: unicode(c)) as s
from (select word, count(*) as n from (select unnest(tokens) as word from ({SQL_TOKENS})) group by word)"""


@query(f"""
with best as (
  select min([-c, l, r]) as pair from (
    select z[1] as l, z[2] as r, sum(n)::bigint as c
    from (select unnest(list_zip(s[:-2], s[2:])) as z, n from ({_SQL_SPELLED})) group by 1, 2)),
spelled as (
  select word, array_to_string(list_transform(s, lambda c: ' ' || c || ' '), '') as s from ({_SQL_SPELLED}))
select word, replace(s, ' ' || pair[2] || '  ' || pair[3] || ' ', ' 1114112 ') as symbols from spelled, best""")
def first_merge_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = materialize(word_counts(corpus(spark, sf_dir)), "word-counts")
    best = best_pairs(pair_counts(symbol_words(words))).first()
    merged = apply_merges(symbols_of("word"), [(best.l, best.r, 0x110000)])
    return words.select("word", merged.alias("symbols"))


@vocabulary_query(SQL_BPE + 'select rank, "left", "right", merged from merges')
def learned_merges(spark: SparkSession, sf_dir: str, vocab_size: int) -> DataFrame:
    return tokenizer(spark, sf_dir, vocab_size).merges_table(spark)


@vocabulary_query(SQL_ENCODED + "select doc_id, array_to_string(ids, ' ') as ids, len(ids)::int as n_tokens from encoded")
def encoded_documents(spark: SparkSession, sf_dir: str, vocab_size: int) -> DataFrame:
    encoded = encode(corpus(spark, sf_dir), tokenizer(spark, sf_dir, vocab_size))
    return encoded.select("doc_id", F.array_join("input_ids", " ").alias("ids"), F.size("input_ids").alias("n_tokens"))


@vocabulary_query(SQL_ENCODED + "select doc_id, array_to_string(ids, ' ') as ids from encoded")
def encoded_by_dictionary(spark: SparkSession, sf_dir: str, vocab_size: int) -> DataFrame:
    docs = corpus(spark, sf_dir)
    words = materialize(word_counts(docs), "word-counts")
    encoded = encode_by_dictionary(docs, words, tokenizer(spark, sf_dir, vocab_size))
    return encoded.select("doc_id", F.array_join("input_ids", " ").alias("ids"))


@vocabulary_query(SQL_BPE + """
select token_id, token, sum(n)::bigint as n
from (select unnest(pieces) as token_id, n from word_pieces) join vocab using (token_id) group by token_id, token""")
def token_frequencies(spark: SparkSession, sf_dir: str, vocab_size: int) -> DataFrame:
    return token_usage(word_counts(corpus(spark, sf_dir)), tokenizer(spark, sf_dir, vocab_size))


@vocabulary_query(SQL_ENCODED + """,
flat as materialized (select doc_id, unnest(ids) as token_id, generate_subscripts(ids, 1) as pos from encoded)
select doc_id, string_agg(token, ' ' order by pos) as decoded from flat join vocab using (token_id) group by doc_id""")
def decoded_documents(spark: SparkSession, sf_dir: str, vocab_size: int) -> DataFrame:
    learned = tokenizer(spark, sf_dir, vocab_size)
    rows = encode(corpus(spark, sf_dir), learned)
    return rows.select("doc_id", decode("input_ids", learned).alias("decoded"))


@vocabulary_query(SQL_BPE + "select count(*) as vocab_size from vocab")
def vocabulary_size(spark: SparkSession, sf_dir: str, vocab_size: int) -> DataFrame:
    return vocab_rows(tokenizer(spark, sf_dir, vocab_size).vocab_table(spark))


@vocabulary_query(SQL_ENCODED + f"""
select split, count(*) as n_rows, round(avg(len(ids)), 9) as mean_tokens,
  quantile_disc(len(ids), 0.5)::int as median_tokens, max(len(ids))::int as max_tokens,
  count(*) filter (where len(ids) > {BLOCK_SIZE}) as n_truncated,
  round(sum(greatest(0, {BLOCK_SIZE} - len(ids)))::double / (count(*) * {BLOCK_SIZE}), 9) as pad_share
from encoded group by split""")
def token_length_profile(spark: SparkSession, sf_dir: str, vocab_size: int) -> DataFrame:
    stats = length_stats(encode(corpus(spark, sf_dir), tokenizer(spark, sf_dir, vocab_size)))
    return stats.withColumn("mean_tokens", F.round("mean_tokens", 9)).withColumn("pad_share", F.round("pad_share", 9))


_SQL_FIXED = f"""
select split, doc_id, array_to_string(ids[:{BLOCK_SIZE}] || list_resize([2], greatest(0, {BLOCK_SIZE} - len(ids)), 2), ' ')
  as input_ids, len(ids)::int as n_tokens
from """


@vocabulary_query(
    SQL_ENCODED
    + f""",
chosen as (
  select split, doc_id from (
    select split, doc_id, row_number() over (partition by split order by md5('42:' || doc_id), doc_id) as pos
    from ({SQL_CORPUS})) where split = 'validation' or pos <= 100)
"""
    + _SQL_FIXED
    + "encoded semi join chosen using (split, doc_id)"
)
def prepared_dataset(spark: SparkSession, sf_dir: str, vocab_size: int) -> DataFrame:
    """The whole job, through the partitioned dataset on disk."""
    rows = prepare(corpus(spark, sf_dir), tokenizer(spark, sf_dir, vocab_size), train_count=100, validation_count=-1)
    path = scratch_path(spark, "dataset")
    write_dataset(rows.drop("sample_pos"), path)
    return read_dataset(spark, path).select(
        "split", "doc_id", F.array_join("input_ids", " ").alias("input_ids"), "n_tokens"
    )


@vocabulary_query(SQL_ENCODED + _SQL_FIXED.replace("split, doc_id, ", "doc_id, ") + "encoded where split = 'validation'")
def dataset_split_scan(spark: SparkSession, sf_dir: str, vocab_size: int) -> DataFrame:
    path = scratch_path(spark, "dataset")
    write_dataset(fixed_length(encode(corpus(spark, sf_dir), tokenizer(spark, sf_dir, vocab_size)).drop("text")), path)
    rows = read_dataset(spark, path, "validation", ["doc_id", "input_ids", "n_tokens"])
    return rows.withColumn("input_ids", F.array_join("input_ids", " "))


@vocabulary_query(SQL_ENCODED + _SQL_FIXED.replace("split, doc_id, ", "doc_id, ") + "encoded")
def streamed_documents(spark: SparkSession, sf_dir: str, vocab_size: int) -> DataFrame:
    """All documents arriving as a stream, encoded against the learned vocabulary."""
    path, state = scratch_path(spark, "stream"), scratch_path(spark, "stream-state")
    learned = tokenizer(spark, sf_dir, vocab_size)
    arriving = spark.readStream.schema("doc_id bigint, text string").option("pathGlobFilter", "documents.parquet")
    prepared = stream_prepare(arriving.parquet(sf_dir), learned)
    write_available(prepared, path, state).awaitTermination()
    rows = spark.read.schema("doc_id bigint, input_ids array<int>, n_tokens int").parquet(path)
    return rows.withColumn("input_ids", F.array_join("input_ids", " "))


@query(f"""
select doc_id, array_to_string(input_ids[:500] || list_resize([2], greatest(0, 500 - len(input_ids)), 2), ' ') as padded,
  array_to_string(input_ids[:500], ' ') as truncated,
  array_to_string(input_ids[greatest(1, len(input_ids) - 499):], ' ') as cropped
from ({SQL_WORD_IDS})""")
def fixed_length_arrays(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = word_ids(spark, sf_dir)
    return ids.select(
        "doc_id",
        F.array_join(pad(truncate("input_ids", 500), 500), " ").alias("padded"),
        F.array_join(truncate("input_ids", 500), " ").alias("truncated"),
        F.array_join(crop_last("input_ids", 500), " ").alias("cropped"),
    )


@query(f"""
with placed as (
  select split, doc_id, case split when 'train' then 300 else 3000 end as k, count(*) over (partition by split) as n,
    row_number() over (partition by split order by md5('42:' || doc_id), doc_id) as pos
  from ({SQL_CORPUS}))
select split, doc_id, case when k <= n then pos end as sample_pos from placed where k > n or pos <= k""")
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """300 training rows; a split with fewer rows than asked for stays whole."""
    sample = sample_n(corpus(spark, sf_dir), {"train": 300, "validation": 3000})
    return sample.select("split", "doc_id", "sample_pos")


@query(f"""
select 'train' as split, doc_id, row_number() over (order by md5('42:3:' || doc_id), doc_id) as pos
from ({SQL_CORPUS}) where split = 'train'
union all
select 'validation', doc_id, row_number() over (order by doc_id) from ({SQL_CORPUS}) where split = 'validation'""")
def epoch_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir).select("split", "doc_id")
    train = epoch_order(docs.where("split = 'train'"), 42, 3)
    fixed = epoch_order(docs.where("split = 'validation'"), 42, 3, shuffle=False)
    return train.unionByName(fixed).select("split", "doc_id", "pos")


def _sql_permuted(seed: int, epoch: int) -> str:
    """The rounds of the keyed permutation, written out; ``grid`` holds the number of rows and the grid's sides."""
    def turned(source: str) -> str:
        for i, (key, factor) in enumerate(Permutation(1, seed, epoch).keys):
            moved, fixed, side = ("a", "b", "high") if i % 2 == 0 else ("b", "a", "low")
            h = f"(({fixed} + {key}) % {HASH_PRIME} * {factor} % {HASH_PRIME})"
            mixed = f"(xor({h}, {h} >> 13) * {HASH_FACTOR}) % {HASH_PRIME}"
            source = f"(select * replace ((({moved} + {mixed}) % {side}) as {moved}) from {source})"
        return source

    split = "(select row, x // low as a, x % low as b, n, high, low from walk, grid where not moved or x >= n)"
    return f"""
with recursive numbered as materialized (select doc_id, row_number() over (order by doc_id) - 1 as row from documents),
grid as materialized (
  select n, high, (n + high - 1) // high as low from (select n, ceil(sqrt(n))::bigint as high from (select count(*) as n from documents))),
walk as (
  select row, row as x, false as moved from numbered
  union all
  select row, a * low + b, true from {turned(split)})
select doc_id, {epoch} as epoch, (x + 1)::bigint as pos, x // 32 as batch_id, (x % 32)::int as pos_in_batch
from walk join numbered using (row), grid where moved and x < n"""


@query(" union all ".join(f"select * from ({_sql_permuted(42, epoch)})" for epoch in (0, 1)))
def permuted_epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two epochs over rows that were numbered once."""
    rows, n = numbered_rows(corpus(spark, sf_dir).select("doc_id"))
    epochs = [
        batches(epoch_permutation(rows, n, 42, epoch)).select("doc_id", F.lit(epoch).alias("epoch"), "pos", "batch_id", "pos_in_batch")
        for epoch in (0, 1)
    ]
    return epochs[0].unionByName(epochs[1])


_SQL_BATCHES = """
select doc_id, (pos - 1) // 32 as batch_id, ((pos - 1) % 32)::int as pos_in_batch
from (select doc_id, row_number() over (order by doc_id) as pos from documents)"""


@query(_SQL_BATCHES)
def fixed_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = epoch_order(corpus(spark, sf_dir).select("doc_id"), 42, 0, shuffle=False)
    return batches(ordered).select("doc_id", "batch_id", "pos_in_batch")


@query(f"select * from ({_SQL_BATCHES}) where batch_id < 5")
def first_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return limit_batches(fixed_batches(spark, sf_dir), 5)


@query("select (ceil(count(*) / 32.0) * 20)::bigint as total_steps from documents")
def training_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return total_steps(corpus(spark, sf_dir), 20)


@query("""
select user_id, arg_min(event_type, case event_type when 'purchase' then 1 when 'signup' then 2 else 3 end) as event_type
from events where event_type in ('purchase', 'signup', 'click') group by user_id""")
def first_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return first_by_priority(events, "event_type", ["purchase", "signup", "click"], ["user_id"])


@query(f"select doc_id, array_to_string(list_append(input_ids[2:], 2), ' ') as targets from ({SQL_WORD_IDS})")
def shifted_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_targets(word_ids(spark, sf_dir))
    return rows.select("doc_id", F.array_join("targets", " ").alias("targets"))


_SQL_PAIRS = f"""
select doc_id, (pos - 1)::int as pos, input, target from (
  select doc_id, generate_subscripts(input_ids, 1) as pos, unnest(input_ids) as input,
    unnest(list_append(input_ids[2:], 2)) as target
  from ({SQL_WORD_IDS}))"""


@query(_SQL_PAIRS)
def input_target_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return target_pairs(with_targets(word_ids(spark, sf_dir)), ["doc_id"])


@query(f"""
with fixed as (
  select doc_id, len(input_ids) as n_tokens,
    input_ids[:{BLOCK_SIZE}] || list_resize([2], greatest(0, {BLOCK_SIZE} - len(input_ids)), 2) as ids
  from ({SQL_WORD_IDS})),
pairs as (
  select doc_id, n_tokens, generate_subscripts(ids, 1) - 1 as pos, unnest(list_append(ids[2:], 2)) as target from fixed)
select doc_id, include_pad, count(*) as n, sum(target)::bigint as target_sum
from pairs, (values (true), (false)) m(include_pad)
where include_pad or pos < n_tokens group by doc_id, include_pad""")
def masked_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_targets(fixed_length(word_ids(spark, sf_dir)))
    pairs = target_pairs(rows, ["doc_id", "n_tokens"])
    parts = [mask_targets(pairs, mode).withColumn("include_pad", F.lit(mode)) for mode in (True, False)]
    grouped = parts[0].unionByName(parts[1]).groupBy("doc_id", "include_pad")
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.sum("target").alias("target_sum"))
