"""Token arrays: masks, shifting, truncation, batches, log-probability slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.ranking import ordered_rank, range_bucket


def usable(ids: str = "input_ids", mask: str = "loss_mask") -> Column:
    """Arrays that are there and of equal, positive length."""
    return F.coalesce((F.size(ids) > 0) & (F.size(ids) == F.size(mask)), F.lit(False))


def mask_of_labels(labels: Column, ignored: int = -100) -> Column:
    """0 where a label is ignored, 1 elsewhere."""
    return F.transform(labels, lambda x: (x != ignored).cast("int"))


def example(df: DataFrame, limit: int, ids: str = "input_ids", mask: str = "loss_mask") -> DataFrame:
    """Usable rows with arrays cut at ``limit``, ``prompt_len`` (zeros in front, all if nothing is scored), ``full_len``, ``truncated``."""
    d = df.where(usable(ids, mask)).withColumn("full_len", F.size(ids))
    first = F.array_position(mask, F.lit(1))
    return d.withColumns(
        {
            "prompt_len": F.when(first > 0, (first - 1).cast("int")).otherwise(F.size(mask)),
            "truncated": F.col("full_len") > limit,
            ids: F.slice(ids, 1, limit),
            mask: F.slice(mask, 1, limit),
        }
    )


def shifted(df: DataFrame, limit: int, ids: str = "input_ids", mask: str = "loss_mask") -> DataFrame:
    """Adds ``tokens``, ``targets`` and ``weights`` for next-token training, cut at ``limit``; rows of under two ids or without weight are left out."""
    n = F.least(F.size(ids) - 1, F.lit(limit))
    d = df.where(usable(ids, mask) & (F.size(ids) >= 2)).withColumns({"tokens": F.slice(F.col(ids), F.lit(1), n), "targets": F.slice(F.col(ids), F.lit(2), n), "weights": F.slice(F.col(mask), F.lit(2), n)})
    return d.where(F.exists("weights", lambda x: x > 0))


def total(c: str) -> Column:
    """Sum of an int array as bigint."""
    return F.aggregate(c, F.lit(0).cast("bigint"), lambda a, x: a + F.coalesce(x, F.lit(0)))


def batches(df: DataFrame, order: str, size: int, ids: str) -> DataFrame:
    """(order, batch, length, pad): consecutive batches of ``size`` rows in order; ``pad`` is what fills a row up to its batch."""
    d = ordered_rank(df.select(order, F.size(ids).alias("length")), [], range_bucket(F.col(order)), [order], "_r")
    d = d.withColumn("batch", F.floor((F.col("_r") - 1) / size))
    longest = d.groupBy("batch").agg(F.max("length").alias("_m"))
    return d.join(longest, "batch").select(order, "batch", "length", (F.col("_m") - F.col("length")).alias("pad"))


def padded(c: Column, pad: Column, value: int = 0) -> Column:
    """An array filled up at its right."""
    return F.concat(c, F.array_repeat(F.lit(value), pad))


def worst_slice(values: Column, labels: Column, mask: Column | None = None, skip: int = 0, reach: int = 8) -> dict[str, Column]:
    """Columns of the scored values behind the first ``skip``: count, mean, least, its 1-based place and label, and the labels around it.

    No scored value gives 0 and nulls; of equal values the first counts.
    """
    # a sequence from 1 to 0 would run backwards
    places = F.when(F.size(values) > 0, F.sequence(F.lit(1), F.size(values))).otherwise(F.array().cast("array<int>"))
    kept = F.filter(places, lambda i: F.element_at(mask, i) > 0) if mask is not None else places
    kept = F.slice(kept, F.lit(skip + 1), F.greatest(F.size(kept) - skip, F.lit(0)))
    v = F.transform(kept, lambda i: F.element_at(values, i).cast("double"))
    n = F.size(v)
    at = F.when(n > 0, F.try_element_at(kept, F.array_position(v, F.array_min(v)).cast("int")))
    start = F.greatest(at - reach, F.lit(1))
    return {
        "scored": F.greatest(n, F.lit(0)),
        "mean": F.when(n > 0, F.aggregate(v, F.lit(0.0), lambda a, x: a + x) / n),
        "least": F.array_min(v),
        "place": at,
        "label": F.try_element_at(labels, at),
        "context": F.when(n > 0, F.slice(labels, start, at + reach - start + 1)),
    }


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common start of two arrays."""
    n = F.least(F.size(a), F.size(b))
    differs = F.array_position(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.eqNullSafe(y)), F.lit(False))
    return F.when(n <= 0, 0).when(differs > 0, differs - 1).otherwise(n).cast("int")


def weighted_mean(value: str, weight: str) -> Column:
    """sum(x * w) / sum(w); null without weight."""
    return F.sum(F.col(value) * F.col(weight)) / F.nullif(F.sum(weight), F.lit(0))


def with_logprobs(df: DataFrame, keep: list[str], scorer, ids: str = "input_ids") -> DataFrame:
    """``keep``, ids and ``logprobs`` (array<double>) by a model; ``scorer`` makes, in the worker, a function from lists of ids to lists of log-probabilities."""
    import pyarrow as pa

    def run(batches):
        score = scorer()
        for b in batches:
            out = pa.array(score(b.column(len(keep)).to_pylist()), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*b.columns, out], names=[*b.schema.names, "logprobs"])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in [*keep, ids])
    return df.select(*keep, ids).mapInArrow(run, f"{fields}, logprobs array<double>")
