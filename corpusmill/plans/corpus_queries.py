"""Queries on sources, sinks and text clean-up."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.constants import TEMPERATURE_RANGE, TOKENS_RANGE, TOP_K_RANGE
from corpusmill.functions.text import clamp, normalize_text, preview, pretokenize
from corpusmill.operators.words import alphabet, word_counts
from corpusmill.plans.registry import (
    SQL_BPE, SQL_CONVERSATIONS, SQL_CORPUS, SQL_TOKENS, conversations, corpus, query, tokenizer, vocabulary_query,
)
from corpusmill.session import scratch_path
from corpusmill.sources.corpus import (
    concat_splits, read_csv, read_lines, split_counts, write_csv, write_lines,
)
from corpusmill.sources.tokenizer_store import (
    load_tokenizer, read_tokenizer_json, save_tokenizer, write_tokenizer_json,
)


@query(SQL_CORPUS)
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir)


_SQL_ODD_TEXTS = """
select doc_id, case doc_id % 5 when 0 then null when 1 then '' when 2 then '  "' || text || '" ' || chr(13) || chr(10)
  when 3 then text || ' \\' else text end as text
from documents"""


def _odd_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("doc_id") % 5
    odd = (
        F.when(case == 0, F.lit(None))
        .when(case == 1, F.lit(""))
        .when(case == 2, F.concat(F.lit('  "'), "text", F.lit('" \r\n')))
        .when(case == 3, F.concat("text", F.lit(" \\")))
        .otherwise(F.col("text"))
    )
    return corpus(spark, sf_dir).select("doc_id", odd.alias("text"))


@query(_SQL_ODD_TEXTS)
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_csv(_odd_texts(spark, sf_dir), path)
    return read_csv(spark, path, "doc_id bigint, text string")


@query(_SQL_ODD_TEXTS)
def csv_by_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same files, each read by as many tasks as it has byte ranges."""
    path = scratch_path(spark, "csv")
    write_csv(_odd_texts(spark, sf_dir), path)
    return read_csv(spark, path, "doc_id bigint, text string", ranges=True)


@query("""
select line as text, count(*) as n from (select unnest(string_split(text, chr(10))) as line from documents)
group by line""")
def lines_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "lines")
    write_lines(corpus(spark, sf_dir), path)
    return read_lines(spark, path).groupBy("text").agg(F.count(F.lit(1)).alias("n"))


@query(f"select split, count(*) as n_rows from ({SQL_CORPUS}) group by split")
def split_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_counts(corpus(spark, sf_dir))


@query(f"""
select split_order, split, doc_id, n_chars from (
  select case when split = 'validation' then 0 else 1 end as split_order, split, doc_id, length(text)::int as n_chars
  from ({SQL_CORPUS})
  union all
  select 2, 'benchmark', item_id, length(text)::int from benchmark)""")
def concatenated_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = corpus(spark, sf_dir)
    held_out = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select(
        F.lit("benchmark").alias("split"), F.col("item_id").alias("doc_id"), "text"
    )
    united = concat_splits(docs.where("split = 'validation'"), docs.where("split = 'train'"), held_out)
    return united.select("split_order", "split", "doc_id", F.length("text").alias("n_chars"))


@query("select doc_id, lang, source, n_chars from documents")
def source_column_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").drop("text")


_SQL_GAPS = """
  select doc_id, case doc_id % 8 when 0 then null when 1 then '' when 2 then 'NA' when 3 then 'None' when 4 then 'null'
    else text end as text from documents"""


@query(f"""
with gaps as ({_SQL_GAPS}),
marked as (select *, text is null or text in ('', 'NA', 'None', 'null', 'nan', 'NaN', 'N/A', 'NULL', 'n/a') as gap from gaps)
select 'drop' as policy, doc_id, text from marked where not gap
union all select 'nan', doc_id, case when gap then 'nan' else text end from marked""")
def text_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    case = F.col("doc_id") % 8
    text = F.when(case == 0, F.lit(None)).when(case == 1, F.lit("")).when(case == 2, F.lit("NA"))
    text = text.when(case == 3, F.lit("None")).when(case == 4, F.lit("null")).otherwise(F.col("text"))
    gaps = corpus(spark, sf_dir).select("doc_id", text.alias("text"))
    parts = [
        normalize_text(gaps, null_policy=policy).select(F.lit(policy).alias("policy"), "doc_id", "text")
        for policy in ("drop", "nan")
    ]
    return parts[0].unionByName(parts[1])


@query(f"""
select conv_id, turn, substr(trim(substr(result, length(prompt) + 1), ' ' || chr(9) || chr(13) || chr(10)), 1, 100) as preview
from ({SQL_CONVERSATIONS})""")
def result_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations(spark, sf_dir).select("conv_id", "turn", preview("prompt", "result").alias("preview"))


@query("""
select event_id, greatest(1, least(500, cast(floor(value * 10) as int))) as tokens,
  greatest(0.1::double, least(2.0::double, value / 50.0::double)) as temperature,
  greatest(1, least(100, cast(floor(value) as int))) as k
from events""")
def settings_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "event_id",
        clamp(F.floor(F.col("value") * 10).cast("int"), *TOKENS_RANGE).alias("tokens"),
        clamp(F.col("value") / F.lit(50.0), *TEMPERATURE_RANGE).alias("temperature"),
        clamp(F.floor("value").cast("int"), *TOP_K_RANGE).alias("k"),
    )


@query(f"select doc_id, array_to_string(tokens, ' ') as pieces, len(tokens)::int as n_pieces from ({SQL_TOKENS})")
def pretokenized(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = corpus(spark, sf_dir).select("doc_id", pretokenize("text").alias("pieces"))
    return pieces.select("doc_id", F.array_join("pieces", " ").alias("pieces"), F.size("pieces").alias("n_pieces"))


@query(f"select word, count(*) as n from (select unnest(tokens) as word from ({SQL_TOKENS})) group by word")
def word_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return word_counts(corpus(spark, sf_dir))


@query(f"""
select (row_number() over (order by ch) + 2)::int as token_id, ch
from (select distinct unnest(string_split(word, '')) as ch from (select unnest(tokens) as word from ({SQL_TOKENS})))""")
def base_alphabet(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alphabet(word_counts(corpus(spark, sf_dir)))


@vocabulary_query(SQL_BPE + """
select store, part, place, first, second from (
  select 'token' as part, token_id as place, token as first, case when is_special then 'special' else 'plain' end as second from vocab
  union all
  select 'merge', rank, "left", "right" from merges), (values ('tables'), ('json')) s(store)""")
def tokenizer_round_trip(spark: SparkSession, sf_dir: str, vocab_size: int) -> DataFrame:
    """Tokens and merges as they come back from both stores."""
    path = scratch_path(spark, "tokenizer")
    learned = tokenizer(spark, sf_dir, vocab_size)
    save_tokenizer(spark, learned, path)
    write_tokenizer_json(spark, learned, f"{path}/tokenizer.json")
    parts = []
    for store, found in (("tables", load_tokenizer(spark, path)), ("json", read_tokenizer_json(spark, f"{path}/tokenizer.json"))):
        kind = F.when(F.col("is_special"), "special").otherwise("plain").alias("second")
        vocab = found.vocab_table(spark).select(
            F.lit("token").alias("part"), F.col("token_id").alias("place"), F.col("token").alias("first"), kind)
        merges = found.merges_table(spark).select(
            F.lit("merge").alias("part"), F.col("rank").alias("place"), F.col("left").alias("first"), F.col("right").alias("second"))
        parts.append(vocab.unionByName(merges).select(F.lit(store).alias("store"), "part", "place", "first", "second"))
    return parts[0].unionByName(parts[1])
