"""Ranking and drawing candidates from a long table ``(context, candidate, logit)``.

A context may hold a large part of the table, so none of these operators sends the rows of
one context to one task: per-context values come from combined aggregations and are joined
back with hot contexts spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.constants import SEED, TEMPERATURE, TOP_K
from corpusmill.functions.hashing import gumbel, hash_key
from corpusmill.operators.skew import keyed_join


def softmax(
    df: DataFrame, temperature: float = 1.0, context: str = "context", logit: str = "logit", out: str = "p"
) -> DataFrame:
    """Add the probability of each candidate within its context at the given temperature.

    One aggregation sums ``exp`` per context and whole-number level of the scaled logit,
    relative to that level, so nothing overflows; the few levels of a context are then
    brought to its highest one. A logit of minus infinity, a masked candidate, has probability
    0; a context that is masked whole, or holds NaN or plus infinity, has no probabilities
    (NaN); a null logit stays null.
    """
    scaled = F.col(logit).cast("double") / F.lit(float(temperature))
    masked, odd = scaled == float("-inf"), F.isnan(scaled) | (scaled == float("inf"))
    level = F.when(~masked & ~odd, F.floor(scaled).cast("double"))
    levels = df.where(scaled.isNotNull()).groupBy(context, level.alias("_level")).agg(
        F.sum(F.exp(scaled - level)).alias("_sum"), F.count(F.lit(1)).alias("_n"), F.max(odd).alias("_odd")
    )
    peak = F.max("_level").over(Window.partitionBy(context))
    totals = (
        levels.withColumn("_peak", peak)
        .groupBy(context)
        .agg(
            F.first("_peak").alias("_peak"),
            F.sum(F.col("_sum") * F.exp(F.col("_level") - F.col("_peak"))).alias("_total"),
            F.sum("_n").alias("_n"),
            F.max("_odd").alias("_odd"),
        )
    )
    joined = keyed_join(df, totals, context, weight="_n", how="left")
    undefined = F.col("_odd") | F.col("_peak").isNull()
    p = F.when(scaled.isNull(), F.lit(None)).when(undefined, F.lit(float("nan"))).when(masked, F.lit(0.0))
    p = p.otherwise(F.exp(scaled - F.col("_peak")) / F.col("_total"))
    return joined.withColumn(out, p).drop("_peak", "_total", "_n", "_odd")


def top_k_ties(df: DataFrame, k: int = TOP_K, context: str = "context", logit: str = "logit") -> DataFrame:
    """Candidates at or above the k-th largest logit of their context; ties are kept.

    The border is found on distinct logits with their counts: a window limited to ``k`` rows
    drops all but the highest distinct logits before the shuffle.
    """
    counts = df.groupBy(context, logit).agg(F.count(F.lit(1)).alias("_c"))
    sizes = counts.groupBy(context).agg(F.sum("_c").alias("_n"))
    order = Window.partitionBy(context).orderBy(F.desc(logit))
    highest = counts.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= k)
    above = F.coalesce(F.sum("_c").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    borders = (
        highest.withColumn("_above", above).where(F.col("_above") < k).groupBy(context).agg(F.min(logit).alias("_border"))
    )
    joined = keyed_join(df, borders.join(sizes, context), context, weight="_n")
    return joined.where(F.col(logit) >= F.col("_border")).drop("_border", "_n")


def sample_one(
    df: DataFrame,
    seed: int = SEED,
    temperature: float = TEMPERATURE,
    context: str = "context",
    candidate: str = "candidate",
    logit: str = "logit",
) -> DataFrame:
    """One candidate per context, drawn with its softmax probability.

    The largest of ``logit / T + Gumbel noise`` is such a draw, so one aggregation that
    combines on the map side replaces softmax and running sums. The noise is a hash of
    seed, context and candidate: the draw does not depend on partitions or row order.
    """
    score = F.col(logit) / F.lit(float(temperature)) + gumbel(hash_key(seed, F.col(context), F.col(candidate)))
    best = F.max(F.struct(score.alias("score"), F.col(candidate).alias("candidate")))
    return df.groupBy(context).agg(best["candidate"].alias(candidate))


def argmax(
    df: DataFrame, context: str = "context", candidate: str = "candidate", logit: str = "logit"
) -> DataFrame:
    """Candidate with the largest logit per context; the lowest candidate wins a tie."""
    best = F.min(F.struct((-F.col(logit)).alias("rank"), F.col(candidate).alias("candidate")))
    return df.groupBy(context).agg(best["candidate"].alias(candidate))
