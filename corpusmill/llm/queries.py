"""Registered queries of the subpackage, with SQL counterparts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import (
    class_model, divergence, exact_copies, language, minhash, mixing, neighbours, packing, personal_data, spelling,
    token_counts, top_k, web_text,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

TOKEN_LIMIT = 4096


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE[function.__name__] = sql
        return function

    return register


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def fold(parts: int):
    """``crc32(doc_id as text) mod parts``."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % parts


@query()
def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = public_tokenizers.path("piece_bpe_32k.model")
    return token_counts.token_budget(documents(spark, sf_dir), model, TOKEN_LIMIT)


@query()
def op2_class_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_model.score(documents(spark, sf_dir).select("doc_id", "text", (fold(7) == 2).alias("held_out")))


@query()
def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


@query(
    """
    with whole as (
      select distinct vec_id, list_transform(embedding, lambda x: floor(64 * x::double)::bigint) as v from embeddings
      where vec_id is not null and len(embedding) > 0
        and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
    scored as (
      select q.vec_id as query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::bigint as score
      from whole q join whole c on c.vec_id <> q.vec_id and len(c.v) = len(q.v) where q.vec_id % 20 = 0),
    ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
    select query_id, rank, vec_id, score from ranked where rank <= 20"""
)
def op4_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k.top_k(vectors, F.col("vec_id") % 20 == 0)


@query()
def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir)).drop("row_id", "text_key", "chosen")


@query()
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = language.fit(docs.where(fold(3) != 1))
    held_out = (fold(3) == 1).alias("held_out")
    return language.predict(docs.select("doc_id", "text", held_out), model).drop("text")


@query()
def op7_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query()
def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.digest(personal_data.find(documents(spark, sf_dir)))


@query()
def op9_web_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web_text.main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query(
    r"""
    with sized as (
      select doc_id, source, md5(coalesce(doc_id::varchar, '')) as key,
        coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size from documents),
    sources as (
      select source, sum(size)::bigint as source_size, sum(size)::double * 2 as most,
        (row_number() over (order by source is null, source) - 1) % 3 as turn from sized group by source),
    weighed as (select *, [5.0, 2.0, 1.0][turn + 1]::double as weight from sources),
    steps as (
      select most / weight as ratio, sum(sum(source_size)) over () * 1.5::double as wanted,
        sum(sum(most)) over (order by most / weight) as stopped,
        sum(sum(weight)) over () - sum(sum(weight)) over (order by most / weight) as open,
        lead(most / weight) over (order by most / weight) as next_ratio
      from weighed group by most / weight),
    levels as (
      select 1.5::double * sum(source_size) / sum(weight) as level from weighed
      having 1.5::double * sum(source_size) / sum(weight) < min(most / weight)
      union all
      select (wanted - stopped) / open from steps
      where open > 0 and (wanted - stopped) / open >= ratio and (wanted - stopped) / open < next_ratio),
    targets as (select source, source_size, turn, least(most, (select max(level) from levels) * weight) as target from weighed),
    placed as (
      select s.*, t.source_size, t.target, floor(t.target)::bigint as whole,
        floor(t.target)::bigint // greatest(t.source_size, 1) as turns, [-0.5, 0.0, 0.5][t.turn + 1]::double as slope,
        coalesce(sum(size) over (partition by s.source order by key, doc_id, size rows between unbounded preceding and 1 preceding), 0)::bigint as before
      from sized s join targets t on s.source is not distinct from t.source),
    parts as (select *, greatest(0, least(size, whole - turns * source_size - before))::bigint as part from placed),
    shares as (select *, least(1.0::double, (before + size / 2.0::double) / whole) as share from parts)
    select doc_id, size::bigint as size, source_size, target, turns * size + part as taken,
      case when size = 0 or turns = 0 and part = 0 then null when slope = 0 then share
        else (sqrt((1.0::double - slope) * (1.0::double - slope) + 4.0::double * slope * share) - (1.0::double - slope)) / (2.0::double * slope) end as position
    from shares"""
)
def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(documents(spark, sf_dir))
    first = F.get("positions", F.lit(0)).alias("position")
    return mixed.select("doc_id", "size", "source_size", "target", "taken", first)


@query(
    r"""
    with docs as (
      select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
          '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as terms
      from documents),
    groups as materialized (select distinct lang, source from docs),
    counts as materialized (
      select lang, source, term, count(*) as n, count(distinct row) as docs
      from (select row, lang, source, unnest(terms) as term from docs) group by all),
    kept as materialized (select lang, term, sum(n)::bigint as n from counts group by all having sum(docs) >= 3),
    languages as materialized (select lang, count(*) as size, sum(n)::bigint as total from kept group by lang),
    totals as materialized (select lang, source, sum(c.n)::bigint as total from counts c join kept using (lang, term) group by all),
    shares as materialized (
      select lang, source, term, coalesce(c.n, 0) as n,
        (1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (coalesce(t.total, 0) + s.size))::bigint as p
      from groups join kept k using (lang) join languages s using (lang)
        left join counts c using (lang, source, term) left join totals t using (lang, source)),
    overall as materialized (
      select lang, term, (1 + 1000000000::hugeint * (n + 1) // (total + size))::bigint as q
      from kept join languages using (lang)),
    differences as (
      select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p)::bigint as value
      from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
    parts as (
      select a.lang, a.source, 'pair' as part, b.source as item, coalesce(d.value, 0) as value
      from groups a join groups b on a.lang = b.lang and a.source <> b.source
        left join differences d on d.lang = a.lang and d.source = a.source and d.item = b.source
      union all
      select lang, source, 'term', term, (p - q) * (p - q) // q from shares join overall using (lang, term) where n > 0 and p > q),
    ranked as (
      select *, (row_number() over (partition by lang, source, part order by value desc, item))::int as rank from parts)
    select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200"""
)
def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(documents(spark, sf_dir))


@query(
    r"""
    with texts as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as text from documents),
    placed as (
      select doc_id, text, row_number() over same as place, first_value(doc_id) over same as keep_id,
        count(*) over (partition by text) as group_size
      from texts window same as (partition by text order by doc_id nulls last))
    select doc_id, keep_id, group_size, place = 1 as kept, sha256(text) as text_sha256 from placed"""
)
def op12_exact_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_copies.exact_copies(documents(spark, sf_dir))


@query()
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variant_groups(spelling.vocabulary(documents(spark, sf_dir)))
