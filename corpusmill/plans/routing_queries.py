"""Queries on top-k routing of vectors to experts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators.routing import (
    add_noise, all_logits, best_experts, block_routes, centroids, combine, dispatch, expert_blocks, expert_load, explode_routes,
    gate_weights, route_top_k,
)
from corpusmill.plans.registry import embeddings, query
from corpusmill.session import materialize

_SQL_EXPERTS = """
entries as materialized (
  select label, generate_subscripts(embedding, 1) as pos, unnest(embedding)::double as x from embeddings),
experts as materialized (
  select label as expert_id, list(x order by pos) as weights
  from (select label, pos, avg(x) as x from entries group by label, pos) group by label)"""
_SQL_LOGITS = _SQL_EXPERTS + """,
logits as materialized (
  select vec_id, expert_id, list_sum(list_transform(list_zip(embedding::double[], weights), lambda z: z[1] * z[2])) as logit
  from embeddings, experts)"""
_SQL_GATES = _SQL_LOGITS + """,
chosen as materialized (
  select vec_id, expert_id, logit from (
    select *, row_number() over (partition by vec_id order by round(logit, 9) desc, expert_id) as place from logits)
  where place <= 2),
gates as materialized (
  select vec_id, expert_id, logit, exp(logit - peak) / sum(exp(logit - peak)) over (partition by vec_id) as gate
  from (select *, max(logit) over (partition by vec_id) as peak from chosen))"""


def _experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialize(centroids(embeddings(spark, sf_dir)), "experts")


def _gated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, list]:
    experts = _experts(spark, sf_dir)
    blocks = expert_blocks(experts)
    routed = route_top_k(embeddings(spark, sf_dir), blocks)
    return routed.withColumn("gates", gate_weights()), experts, blocks


@query(f"""
with {_SQL_EXPERTS}
select expert_id, (pos - 1)::int as pos, round(w, 8) as w
from (select expert_id, generate_subscripts(weights, 1) as pos, unnest(weights) as w from experts)""")
def expert_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = centroids(embeddings(spark, sf_dir)).select("expert_id", F.posexplode("weights").alias("pos", "w"))
    return vectors.withColumn("w", F.round("w", 8))


@query(f"with {_SQL_LOGITS} select vec_id, expert_id, round(logit, 8) as logit from logits")
def expert_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = embeddings(spark, sf_dir).withColumn("logits", all_logits(expert_blocks(_experts(spark, sf_dir))))
    return explode_routes(scored, "logits", "vec_id").withColumn("logit", F.round("logit", 8))


@query(f"""
with {_SQL_LOGITS},
keyed as (select *, md5('7:' || vec_id || ':' || expert_id) as h from logits)
select vec_id, expert_id, round(logit
  + sqrt(-2 * ln((('0x' || substr(h, 1, 8))::bigint + 0.5) / 4294967296.0::double))
  * cos(2 * pi() * ((('0x' || substr(h, 9, 8))::bigint + 0.5) / 4294967296.0::double)) * (greatest(logit, 0) + ln(1 + exp(-abs(logit)))), 8) as logit
from keyed""")
def noisy_expert_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = embeddings(spark, sf_dir).withColumn("logits", all_logits(expert_blocks(_experts(spark, sf_dir))))
    noisy = scored.withColumn("noisy", add_noise("logits", "logits", "vec_id", seed=7))
    return explode_routes(noisy, "noisy", "vec_id").withColumn("logit", F.round("logit", 8))


_SQL_NOISY = _SQL_LOGITS + """,
keyed as (select *, md5('7:' || vec_id || ':' || expert_id) as h from logits),
noisy as materialized (
  select vec_id, expert_id, logit
    + sqrt(-2 * ln((('0x' || substr(h, 1, 8))::bigint + 0.5) / 4294967296.0::double))
    * cos(2 * pi() * ((('0x' || substr(h, 9, 8))::bigint + 0.5) / 4294967296.0::double)) * (greatest(logit, 0) + ln(1 + exp(-abs(logit)))) as logit
  from keyed),
chosen as materialized (
  select vec_id, expert_id, logit from (
    select *, row_number() over (partition by vec_id order by round(logit, 9) desc, expert_id) as place from noisy)
  where place <= 2)"""


@query(f"""
with {_SQL_NOISY}
select vec_id, expert_id, round(exp(logit - peak) / sum(exp(logit - peak)) over (partition by vec_id), 8) as gate
from (select *, max(logit) over (partition by vec_id) as peak from chosen)""")
def noisy_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Noise first, then the best experts and their weights."""
    scored = embeddings(spark, sf_dir).withColumn("logits", all_logits(expert_blocks(_experts(spark, sf_dir))))
    routed = scored.withColumn("routes", best_experts(add_noise("logits", "logits", "vec_id", seed=7)))
    gated = routed.withColumn("gates", gate_weights())
    return explode_routes(gated, "gates", "vec_id").select("vec_id", "expert_id", F.round("gate", 8).alias("gate"))


@query("""
with vectors as (select vec_id, embedding::double[] as v from embeddings),
ranked as (
  select a.vec_id, b.vec_id as expert_id, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])) as logit
  from vectors a, vectors b),
chosen as (select *, row_number() over (partition by vec_id order by round(logit, 9) desc, expert_id) as place from ranked)
select vec_id, expert_id, place::int as place, round(logit, 8) as logit from chosen where place <= 3""")
def many_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector is an expert as well, so their number grows with the table."""
    vectors = embeddings(spark, sf_dir)
    experts = vectors.select(F.col("vec_id").alias("expert_id"), F.col("embedding").alias("weights"))
    routed = block_routes(vectors.select("vec_id", "embedding"), experts, 3)
    exploded = routed.select("vec_id", F.posexplode("routes").alias("place", "route"))
    return exploded.select(
        "vec_id", "route.expert_id", (F.col("place") + 1).alias("place"), F.round("route.logit", 8).alias("logit"))


@query(f"with {_SQL_GATES} select vec_id, expert_id, round(logit, 8) as logit from chosen")
def chosen_experts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored in several passes over blocks of three experts, as a large expert table would be."""
    blocks = expert_blocks(_experts(spark, sf_dir), entries=3 * 64)
    routed = route_top_k(embeddings(spark, sf_dir), blocks)
    return explode_routes(routed, "routes", "vec_id").withColumn("logit", F.round("logit", 8))


@query(f"with {_SQL_GATES} select vec_id, expert_id, round(gate, 8) as gate from gates")
def expert_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated, _, _ = _gated(spark, sf_dir)
    return explode_routes(gated, "gates", "vec_id").select("vec_id", "expert_id", F.round("gate", 8).alias("gate"))


@query(f"with {_SQL_GATES} select vec_id, expert_id, round(gate, 8) as gate from gates where gate > 0")
def dispatched_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated, _, _ = _gated(spark, sf_dir)
    return dispatch(gated).withColumn("gate", F.round("gate", 8))


@query(f"""
with {_SQL_GATES},
weights as (select expert_id, generate_subscripts(weights, 1) as pos, unnest(weights) as w from experts)
select vec_id, (pos - 1)::int as pos, round(sum(gate * w), 8) as x
from gates join weights using (expert_id) group by vec_id, pos""")
def combined_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated, _, blocks = _gated(spark, sf_dir)
    combined = combine(gated, blocks).select("vec_id", F.posexplode_outer("combined").alias("pos", "x"))
    return combined.withColumn("x", F.round("x", 8))


@query(f"""
with {_SQL_GATES},
load as (select expert_id, count(*) as n, sum(gate) as g from gates where gate > 0 group by expert_id)
select expert_id, coalesce(n, 0) as n_rows, round(coalesce(n, 0)::double / (select sum(n) from load), 9) as share,
  round(coalesce(g, 0), 6) as sum_gate, n is null as unused
from experts left join load using (expert_id)""")
def expert_loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    gated, experts, _ = _gated(spark, sf_dir)
    load = expert_load(gated, experts)
    return load.withColumn("share", F.round("share", 9)).withColumn("sum_gate", F.round("sum_gate", 6))
