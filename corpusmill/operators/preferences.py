"""Verifier rows, preference pairs, and calibration of rewards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.rewards import with_reward
from corpusmill.functions.text import reward_task, text_of
from corpusmill.operators.ranking import quantiles


def best_positive(rows: DataFrame, priority: dict[str, int], row: str, other: int = 99) -> DataFrame:
    """(id, positive, source): the positive of each id by source priority, completion length and row."""
    rank = F.lit(other)
    for s, p in priority.items():
        rank = F.when(F.col("source") == s, p).otherwise(rank)
    order = F.struct(rank, F.length(text_of(F.col("completion"))), F.col(row))
    return rows.groupBy("id").agg(F.min_by(F.struct(F.col(row).alias("positive"), "source"), order).alias("b")).select("id", "b.positive", "b.source")


def verifier_rows(positives: DataFrame, negatives: DataFrame, task: str = "") -> DataFrame:
    """Union of both sides with their rewards: id, source, row, origin and the reward columns; ``task`` filters before scoring."""
    p = positives.withColumn("origin", F.lit("positive"))
    n = negatives.withColumn("origin", F.lit("negative"))
    cols = ["row", "id", "source", "origin", "task_type", "prompt", "completion", "answer"]
    both = p.select(*cols).unionByName(n.select(*cols)).withColumn("task_type", reward_task(F.col("task_type")))
    both = both.where(F.col("task_type") == task) if task else both
    return with_reward(both.withColumn("task", F.col("task_type")), ["row", "id", "source", "origin", "task"])


def pairs(positives: DataFrame, negatives: DataFrame, priority: dict[str, int], min_margin: float = 0.2) -> DataFrame:
    """(id, chosen, rejected, margin, status) of every negative.

    Positives that don't state their answer exactly are left out; the best of each id is probed by
    every negative.  Status: no_positive_overlap, rejected_exact_skip, low_margin_skip or pair.
    """
    scored = verifier_rows(positives, negatives)
    good = scored.where((F.col("origin") == "positive") & F.array_contains("flags", "answer_exact"))
    texts = positives.select(F.col("row").alias("_r"), "completion")
    best = best_positive(good.join(texts, good["row"] == texts["_r"]).drop("_r"), priority, "row")
    rewards = good.select(F.col("row").alias("positive"), F.col("reward").alias("up"))
    best = best.join(rewards, "positive").select("id", "positive", "up")
    bad = scored.where("origin = 'negative'").select("id", F.col("row").alias("rejected"), F.col("reward").alias("down"), "flags")
    d = bad.join(best, "id", "left").withColumn("margin", F.round(F.col("up") - F.col("down"), 6))
    status = (
        F.when(F.col("positive").isNull(), "no_positive_overlap")
        .when(F.array_contains("flags", "answer_exact"), "rejected_exact_skip")
        .when(F.col("margin") < min_margin, "low_margin_skip")
        .otherwise("pair")
    )
    return d.select("id", F.col("positive").alias("chosen"), "rejected", "margin", status.alias("status"))


def margins(rows: DataFrame, chosen: Column, rejected: Column, sets: list[str]) -> DataFrame:
    """Count, mean margin and win rate overall and by each of ``sets``: grouping sets in one pass; ``dim`` names the set."""
    d = rows.select(*[text_of(F.col(s)).alias(s) for s in sets], (chosen - rejected).alias("m")).where(F.abs("m") < float("inf"))
    # one unfolded row for each set keeps all of them in a single partial aggregation
    dims = F.array(F.struct(F.lit("all").alias("dim"), F.lit("").alias("value")), *[F.struct(F.lit(s).alias("dim"), F.col(s).alias("value")) for s in sets])
    return (
        d.select(F.inline(dims), "m")
        .groupBy("dim", "value")
        .agg(F.count(F.lit(1)).alias("n"), F.avg("m").alias("mean_margin"), F.avg((F.col("m") > 0).cast("double")).alias("win_rate"))
    )


def margin_medians(rows: DataFrame, chosen: Column, rejected: Column, by: str) -> DataFrame:
    """(by, median): exact medians of the margins of each group."""
    return quantiles(rows.withColumn("_m", chosen - rejected), "_m", [0.5], [by]).withColumnRenamed("q0", "median")
