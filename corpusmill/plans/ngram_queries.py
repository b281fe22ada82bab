"""Queries on next-token statistics and candidate ranking."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.constants import BLOCK_SIZE, MAX_NEW_TOKENS, PAD_ID, SEED
from corpusmill.functions.arrays import crop_last
from corpusmill.functions.text import preview, pretokenize
from corpusmill.operators.candidates import argmax, sample_one, softmax, top_k_ties
from corpusmill.operators.encode import decode, encode
from corpusmill.operators.ngram import (
    adjacent_pairs, bigrams, continue_batch, counted, cross_entropy, doc_cross_entropy, evaluate, evaluate_fixed, next_candidates, padded,
    row_pairs,
)
from corpusmill.operators.pair_parts import written
from corpusmill.operators.targets import with_targets
from corpusmill.operators.words import explode_words
from corpusmill.plans.oracle_bpe import WORD_PATTERN
from corpusmill.plans.prepare import fixed_length
from corpusmill.plans.registry import SQL_TOKENS, SQL_WORD_IDS, corpus, query, r9, tokenizer, tokens, word_ids
from corpusmill.session import materialize, materialize_alone
from corpusmill.sources.corpus import TRAIN, VALIDATION


def _sql_bigrams(texts: str) -> str:
    return f"""
select z[1] as ctx, z[2] as nxt, count(*) as c
from (select unnest(list_zip(tokens[:-2], tokens[2:])) as z from ({texts})) group by 1, 2"""


_SQL_BIGRAMS = _sql_bigrams(SQL_TOKENS)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(bigrams(tokens(spark, sf_dir)), "bigrams")


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _counts(spark, sf_dir)
    return counts.select(F.col("ctx").alias("context"), F.col("nxt").alias("candidate"), F.log("c").alias("logit"))


@query(_SQL_BIGRAMS)
def next_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bigrams(tokens(spark, sf_dir))


_SQL_CANDIDATES = f"candidates as materialized (select ctx as context, nxt as candidate, ln(c) as logit from ({_SQL_BIGRAMS}))"


@query(f"""
with {_SQL_CANDIDATES},
scaled as (select context, candidate, logit / 0.8 as x, max(logit / 0.8) over (partition by context) as peak from candidates)
select context, candidate, round(exp(x - peak) / sum(exp(x - peak)) over (partition by context), 9) as p from scaled""")
def candidate_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return softmax(_candidates(spark, sf_dir), 0.8).select("context", "candidate", r9("p").alias("p"))


@query(f"""
with {_SQL_CANDIDATES}
select context, candidate, round(logit, 9) as logit
from (select *, rank() over (partition by context order by logit desc) as place from candidates) where place <= 5""")
def top_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k_ties(_candidates(spark, sf_dir), 5).select("context", "candidate", r9("logit").alias("logit"))


@query(f"""
with {_SQL_CANDIDATES},
noisy as (select context, candidate, logit / 0.8
  - ln(-ln((('0x' || left(md5('42:' || context || ':' || candidate), 8))::bigint + 0.5) / 4294967296.0::double)) as score
  from candidates)
select context, arg_max(candidate, score) as candidate from noisy group by context""")
def drawn_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_one(_candidates(spark, sf_dir))


@query(f"""
with {_SQL_CANDIDATES}
select context, candidate from (
  select *, row_number() over (partition by context order by logit desc, candidate) as place from candidates)
where place = 1""")
def most_likely_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return argmax(_candidates(spark, sf_dir))


def _split(spark: SparkSession, sf_dir: str, split: str) -> DataFrame:
    return tokens(spark, sf_dir).where(F.col("split") == split)


def _by_split(pairs: Callable[[str], DataFrame]) -> DataFrame:
    """Packed pairs of either split, written once: they are counted and scored."""
    parts = [pairs(split).withColumn("split", F.lit(split)) for split in (TRAIN, VALIDATION)]
    return written(parts[0].unionByName(parts[1]))


def _train_words(spark: SparkSession, sf_dir: str) -> Column:
    return _distinct_words(corpus(spark, sf_dir).where("split = 'train'"))


def _distinct_words(df: DataFrame) -> Column:
    return explode_words(df).distinct().agg(F.count(F.lit(1))).scalar()


_SQL_LOSS = f"""
with toks as materialized ({SQL_TOKENS}),
counts as materialized ({_sql_bigrams("select tokens from toks where split = 'train'")}),
totals as (select ctx, sum(c) as c_ctx from counts group by ctx),
vocab as (select count(distinct word) as v from (select unnest(tokens) as word from toks where split = 'train')),
pairs as (
  select split, doc_id, z[1] as ctx, z[2] as nxt
  from (select split, doc_id, unnest(case when len(tokens) > 1 then list_zip(tokens[:-2], tokens[2:]) else [null] end) as z
    from toks)),
per_doc as materialized (
  select split, doc_id, count(ctx) as n,
    sum(case when ctx is null then 0.0 else -ln((coalesce(c, 0) + 1)::double / (coalesce(c_ctx, 0) + v)) end) as nll
  from pairs left join counts using (ctx, nxt) left join totals using (ctx), vocab group by split, doc_id)"""


@query(f"{_SQL_LOSS} select doc_id, n, round(nll / nullif(n, 0), 9) as loss from per_doc")
def document_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document against the statistics of the training split."""
    pairs = _by_split(lambda split: adjacent_pairs(_split(spark, sf_dir, split), "doc_id"))
    train = pairs.where("split = 'train'")
    scored = doc_cross_entropy(pairs, bigrams(train, packed=True), _distinct_words(train))
    return scored.select("doc_id", "n", r9("loss").alias("loss"))


@query(f"""{_SQL_LOSS},
per_batch as (
  select (pos - 1) // 4 as batch_id, sum(nll) as nll, sum(n) as n
  from (select *, row_number() over (order by doc_id) as pos from per_doc where split = 'validation') group by 1)
select round(avg(nll / nullif(n, 0)), 9) as macro_loss, round(sum(nll) / sum(n), 9) as micro_loss,
  round(exp(avg(nll / nullif(n, 0))), 6) as perplexity, sum(n)::bigint as n_pairs
from per_batch""")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = evaluate(
        _split(spark, sf_dir, "train"), _split(spark, sf_dir, "validation"), _train_words(spark, sf_dir), batch_size=4
    )
    return report.select(
        r9("macro_loss").alias("macro_loss"), r9("micro_loss").alias("micro_loss"),
        F.round("perplexity", 6).alias("perplexity"), "n_pairs",
    )


_SQL_FIXED_LOSS = f"""
fixed as materialized (
  select split, doc_id, len(input_ids) as n_tokens,
    input_ids[:{BLOCK_SIZE}] || list_resize([{PAD_ID}], greatest(0, {BLOCK_SIZE} - len(input_ids)), {PAD_ID}) as ids
  from ({SQL_WORD_IDS})),
places as materialized (
  select include_pad, split, doc_id, ctx, nxt from (
    select split, doc_id, n_tokens, generate_subscripts(ids, 1) as pos, unnest(ids) as ctx,
      unnest(list_append(ids[2:], {PAD_ID})) as nxt
    from fixed), (values (true), (false)) m(include_pad) where include_pad or pos <= n_tokens),
counts as materialized (
  select include_pad, ctx, nxt, count(*) as c from places where split = 'train' group by all),
totals as (select include_pad, ctx, sum(c) as c_ctx from counts group by all),
vocab as (select count(distinct id) + 1 as v from (select unnest(ids) as id from fixed where split = 'train') where id <> {PAD_ID}),
modes as (select distinct include_pad, split, doc_id from fixed, (values (true), (false)) m(include_pad)),
scored as (
  select include_pad, split, doc_id, count(*) as n, sum(-ln((coalesce(c, 0) + 1)::double / (coalesce(c_ctx, 0) + v))) as nll
  from places left join counts using (include_pad, ctx, nxt) left join totals using (include_pad, ctx), vocab group by all),
per_doc as materialized (
  select include_pad, split, doc_id, coalesce(n, 0) as n, nll from modes left join scored using (include_pad, split, doc_id))"""


def _fixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Rows of fixed length with targets, and the number of distinct ids of the training rows and the filling."""
    # Targets are the inputs moved by one place, so only the inputs are written.
    rows = with_targets(materialize(fixed_length(word_ids(spark, sf_dir)), "fixed"))
    ids = rows.where("split = 'train'").select(F.explode("input_ids").alias("id")).where(F.col("id") != PAD_ID).distinct()
    return rows, ids.count() + 1


@query(f"with {_SQL_FIXED_LOSS} select include_pad, doc_id, n, round(nll / nullif(n, 0), 9) as loss from per_doc")
def padded_cross_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss of every row of fixed length, with the filling and without."""
    rows, vocab = _fixed(spark, sf_dir)

    def scored(mode: bool) -> DataFrame:
        places = padded("input_ids", "targets", "n_tokens", mode)
        pairs = _by_split(lambda split: row_pairs(rows.where(F.col("split") == split), "doc_id", *places, packed=True))
        losses = cross_entropy(pairs, counted(pairs.where("split = 'train'"), packed=True), vocab, "doc_id")
        return losses.select(F.lit(mode).alias("include_pad"), "doc_id", "n", r9("loss").alias("loss"))

    # What one mode has written goes before the other one starts.
    parts = [materialize_alone(spark, partial(scored, mode), "losses") for mode in (True, False)]
    return parts[0].unionByName(parts[1])


@query(f"""with {_SQL_FIXED_LOSS},
per_batch as (
  select include_pad, (pos - 1) // 4 as batch_id, sum(nll) as nll, sum(n) as n
  from (select *, row_number() over (partition by include_pad order by doc_id) as pos from per_doc where split = 'validation')
  group by all)
select include_pad, round(avg(nll / nullif(n, 0)), 9) as macro_loss, round(sum(nll) / sum(n), 9) as micro_loss,
  round(exp(avg(nll / nullif(n, 0))), 6) as perplexity, sum(n)::bigint as n_pairs
from per_batch group by include_pad""")
def padded_validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, vocab = _fixed(spark, sf_dir)
    train, validation = rows.where("split = 'train'"), rows.where("split = 'validation'")
    parts = [
        evaluate_fixed(train, validation, vocab, mode, batch_size=4).withColumn("include_pad", F.lit(mode))
        for mode in (True, False)
    ]
    return parts[0].unionByName(parts[1]).select(
        "include_pad", r9("macro_loss").alias("macro_loss"), r9("micro_loss").alias("micro_loss"),
        F.round("perplexity", 6).alias("perplexity"), "n_pairs")


_SQL_TOP = f"""
counts as materialized ({_SQL_BIGRAMS}),
top as materialized (
  select ctx, nxt, c, ln(c) / 0.8 as x from (
    select *, rank() over (partition by ctx order by c desc) as place from counts) where place <= 50),
likely as materialized (
  select ctx, nxt, c, exp(x - peak) / sum(exp(x - peak)) over (partition by ctx) as p
  from (select *, max(x) over (partition by ctx) as peak from top))"""


@query(f"with {_SQL_TOP} select ctx, nxt, c, round(p, 9) as p from likely")
def next_token_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return next_candidates(_counts(spark, sf_dir)).select("ctx", "nxt", "c", r9("p").alias("p"))


_SQL_CONTINUED = f"""
with recursive {_SQL_TOP},
weighted as (
  select ctx, nxt, left(md5(nxt), 2) as part, greatest(1, cast(round(p * 1073741824.0::double) as bigint)) as w from likely),
ends as (
  select ctx, nxt, w, sum(w) over (partition by ctx order by part, nxt) as e, sum(w) over (partition by ctx) as total
  from weighted),
grid as materialized (
  select ctx, nxt, ((e - w)::hugeint * 4294967296 // total)::bigint as lo, (e::hugeint * 4294967296 // total)::bigint as hi
  from ends),
prompts as materialized (
  select conv_id * 1000 + turn as prompt_id, regexp_extract_all(text, '{WORD_PATTERN}') as tokens
  from conversations where role = 'user'),
walk as (
  select prompt_id, 0 as step, tokens[-1] as ctx, []::varchar[] as generated from prompts where len(tokens) > 0
  union all
  select prompt_id, step + 1, nxt, list_append(generated, nxt)
  from (select *, ('0x' || left(md5('{SEED}:' || step || ':' || prompt_id), 8))::bigint as r from walk where step < {MAX_NEW_TOKENS}) w
  join grid g on g.ctx = w.ctx and w.r >= g.lo and w.r < g.hi),
ended as (select prompt_id, arg_max(generated, step) as generated from walk group by prompt_id)
select prompt_id, array_to_string(coalesce(generated, []), ' ') as generated,
  array_to_string(list_concat(tokens, coalesce(generated, []))[-20:], ' ') as context
from prompts left join ended using (prompt_id)"""


@query(_SQL_CONTINUED)
def continued_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    prompts = turns.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), pretokenize("text").alias("tokens")
    )
    continued = continue_batch(
        prompts, next_candidates(_counts(spark, sf_dir)), MAX_NEW_TOKENS, n=20, key="prompt_id"
    )
    return continued.select(
        "prompt_id", F.array_join("generated", " ").alias("generated"), F.array_join("context", " ").alias("context")
    )


@query()
def generated_previews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text in, text out: prompts are encoded, cropped, continued on token ids, decoded and previewed."""
    learned = tokenizer(spark, sf_dir)
    encoded = encode(corpus(spark, sf_dir).where("split = 'train'"), learned)
    candidates = next_candidates(bigrams(encoded, "input_ids"))
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'user'")
    prompts = encode(turns.select((F.col("conv_id") * 1000 + F.col("turn")).alias("prompt_id"), "text"), learned)
    prompts = prompts.withColumn("input_ids", crop_last("input_ids", BLOCK_SIZE))
    continued = continue_batch(prompts, candidates, MAX_NEW_TOKENS, key="prompt_id", tokens="input_ids")
    prompt, result = decode("input_ids", learned), decode(F.concat("input_ids", "generated"), learned)
    return continued.select("prompt_id", F.size("generated").alias("n_new"), preview(prompt, result).alias("preview"))
