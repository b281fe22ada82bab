"""Roll-ups of training and generation logs.

Training log: ``(step, epoch, phase, batch_id, loss)``. Generation log:
``(prompt, tokens, seconds)``. Every roll-up is a partial and a final aggregation.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusmill.constants import BUCKET_STEPS, REPORT_EVERY
from corpusmill.operators.ranking import range_rank
from corpusmill.session import materialize


def batch_loss(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return metrics.groupBy(*by, "batch_id").agg(F.avg("loss").alias("batch_loss"))


def macro_loss(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Unweighted mean of batch means: a short last batch counts fully."""
    return batch_loss(metrics, by).groupBy(*by).agg(F.avg("batch_loss").alias("macro_loss"))


def train_loss(metrics: DataFrame, k: int, compat: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Mean loss of the first ``k`` batches; ``compat`` divides by ``k`` even if fewer exist."""
    first = batch_loss(metrics.where(F.col("batch_id") < k), by)
    mean = F.sum("batch_loss") / F.lit(k) if compat else F.avg("batch_loss")
    return first.groupBy(*by).agg(mean.alias("train_loss"))


def log10_loss(loss="loss") -> Column:
    """Base-10 logarithm with the floating-point results for zero (-inf) and below (NaN), not null."""
    loss = F.col(loss) if isinstance(loss, str) else loss
    return (
        F.when(loss > 0, F.log10(loss))
        .when(loss == 0, F.lit(float("-inf")))
        .when(loss.isNotNull(), F.lit(float("nan")))
    )


def bucket_mean(metrics: DataFrame, value: str = "loss", width: int = BUCKET_STEPS) -> DataFrame:
    """Mean of every ``width`` steps; the last bucket may be partial."""
    bucket = F.floor(F.col("step") / width).alias("bucket")
    return metrics.groupBy(bucket).agg(F.avg(value).alias("mean_value"), F.count(F.lit(1)).alias("n_steps"))


def every_n(metrics: DataFrame, n: int = REPORT_EVERY, step: str = "step") -> DataFrame:
    return metrics.where(F.col(step) % n == 0)


def perplexity(metrics: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return metrics.groupBy(*by).agg(F.exp(F.avg("loss")).alias("perplexity"))


def epoch_summary(metrics: DataFrame, compat: bool = False) -> DataFrame:
    """Per epoch the validation loss and the estimate of the training loss.

    The validation loss is the mean of its batch means; the estimate is the mean of as many of
    the epoch's first training batches as there were validation batches. ``compat`` divides by
    that number even if there are fewer training batches.
    """
    per_batch = materialize(batch_loss(metrics, ["epoch", "phase"]), "batch-losses")
    validation = per_batch.where("phase = 'val'").groupBy("epoch").agg(
        F.avg("batch_loss").alias("val_loss"), F.count(F.lit(1)).alias("_k"))
    placed = range_rank(per_batch.where("phase = 'train'").select("epoch", "batch_id", "batch_loss"), ["epoch", "batch_id"])
    starts = placed.groupBy("epoch").agg(F.min("pos").alias("_start"))
    # One row per epoch on the right.
    first = placed.join(starts.join(validation, "epoch", "left"), "epoch")
    counts = F.col("pos") - F.col("_start") < F.col("_k")
    mean = F.sum(F.when(counts, F.col("batch_loss"))) / F.first("_k") if compat else F.avg(F.when(counts, F.col("batch_loss")))
    train = first.groupBy("epoch").agg(mean.alias("train_loss"))
    return validation.drop("_k").join(train, "epoch", "full").select("epoch", "val_loss", "train_loss")


def best_by(table: DataFrame, score: str, name: str = "epoch") -> DataFrame:
    """The name with the lowest score; the lowest name wins a tie."""
    best = table.where(F.col(score).isNotNull()).agg(F.min(F.struct(score, name)).alias("best"))
    return best.select(F.col(f"best.{name}").alias(name), F.col(f"best.{score}").alias(score))


def throughput(log: DataFrame) -> DataFrame:
    """Tokens per second of each prompt; prompts without measured time are left out."""
    sums = log.groupBy("prompt").agg(F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))
    timed = sums.where(F.col("seconds") > 0)
    return timed.withColumn("tokens_per_second", F.col("tokens") / F.col("seconds"))


def throughput_summary(per_prompt: DataFrame) -> DataFrame:
    """Mean time, mean of the per-prompt speeds, total time."""
    return per_prompt.agg(
        F.avg("seconds").alias("avg_seconds"),
        F.avg("tokens_per_second").alias("avg_tokens_per_second"),
        F.sum("seconds").alias("total_seconds"),
    )


def usage_counts(log: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """``(*by, name, n)``: uses of each name."""
    return log.groupBy(*by, name).agg(F.count(F.lit(1)).alias("n"))


def usage(log: DataFrame, name: str, by: Sequence[str] = ()) -> DataFrame:
    """Per group: uses of each name as a map, the set of names, their number, all uses.

    Meant for a small fixed set of labels, such as event types or experts: a group's map
    has one entry per label. For unlimited names use :func:`usage_top`. Uses are counted
    per group and name first, so a hot label reaches the second step as a single row.
    """
    entries = F.array_sort(F.collect_list(F.struct(F.col(name).alias("name"), "n")))
    return usage_counts(log, name, by).groupBy(*by).agg(
        F.map_from_entries(entries).alias("uses"),
        F.array_sort(F.collect_set(name)).alias("names"),
        F.count(F.lit(1)).alias("n_names"),
        F.sum("n").alias("n_uses"),
    )


def usage_top(log: DataFrame, name: str, by: Sequence[str], k: int) -> DataFrame:
    """Per group: the ``k`` most used names with their uses, how many names there are, all uses and those not listed.

    For unlimited names: a group of any size is one short list. Uses are counted per group and
    name, and all but the best ``k`` names of a task's groups are dropped before they are ranked.
    Equally used names are listed in order.
    """
    counts = materialize(usage_counts(log, name, by), "uses")
    order = Window.partitionBy(*by).orderBy(F.desc("n"), F.col(name))
    listed = counts.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    entry = F.struct("place", F.col(name).alias("name"), "n")
    lists = listed.groupBy(*by).agg(F.array_sort(F.collect_list(entry)).alias("top"), F.sum("n").alias("_listed"))
    totals = counts.groupBy(*by).agg(F.count(F.lit(1)).alias("n_names"), F.sum("n").alias("n_uses"))
    same = [totals[column].eqNullSafe(lists[column]) for column in by]
    joined = totals.join(lists, reduce(Column.__and__, same))
    return joined.select(*[totals[column] for column in by], "top", "n_names", "n_uses", (F.col("n_uses") - F.col("_listed")).alias("n_rest"))
