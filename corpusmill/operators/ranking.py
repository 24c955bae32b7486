"""Ranks, quantiles and samples that never sort a whole group in one task.

A rank is the number of rows in earlier buckets of the group plus the row's number
within its bucket.  Buckets follow the order (leading digits of a hash, ranges of a
number), so the rank is the one a single sort would give.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ordered_rank(df: DataFrame, group: list[str], bucket: Column, order: list[Column | str], name: str = "rank") -> DataFrame:
    """Adds ``name``: the 1-based place of each row in its group by ``order``; ``bucket`` must rise with the order.

    Null group keys form a group.  Rows equal in ``order`` get different places.
    """
    d = df.withColumn("_b", bucket)
    keys = [F.coalesce(F.col(g).cast("string"), F.lit("\0")) for g in group]
    d = d.withColumns({f"_g{i}": k for i, k in enumerate(keys)})
    on = [f"_g{i}" for i in range(len(group))]
    counts = d.groupBy(*on, "_b").agg(F.count(F.lit(1)).alias("_n"))
    over = W.partitionBy(*on).orderBy("_b") if on else W.orderBy("_b")
    before = counts.withColumn("_before", F.sum("_n").over(over) - F.col("_n")).drop("_n")
    own = F.row_number().over(W.partitionBy(*on, "_b").orderBy(*order))
    return d.withColumn("_own", own).join(before, [*on, "_b"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_own", "_before", "_b", *on)


def hex_bucket(digest: Column, digits: int = 3) -> Column:
    """Leading hex digits: 4096 buckets of a digest by default."""
    return F.substring(digest, 1, digits)


def range_bucket(c: Column, width: int = 50_000) -> Column:
    """Buckets of ``width`` consecutive whole numbers."""
    return F.floor(c / width)


def first_per_key(df: DataFrame, key: list[Column | str], order: Column, last: bool = False, least_nulls: bool = False) -> DataFrame:
    """One row for each key, the one with the smallest (or largest) ``order``; combined before the shuffle.

    Select the needed columns before: the whole row travels.  A null order is passed over, or the smallest with ``least_nulls``.
    """
    order = F.struct(order) if least_nulls else order
    cols = df.columns
    pick = (F.max_by if last else F.min_by)(F.struct(*[F.col(f"`{c}`") for c in cols]), order)
    keys = [k if isinstance(k, Column) else F.col(k) for k in key]
    return df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick.alias("_row")).select("_row.*")


def quantiles(df: DataFrame, col: str, qs: list[float], group: list[str] | None = None, buckets: int = 1024) -> DataFrame:
    """Exact interpolated quantiles of the finite values of ``col`` for each group: columns q0, q1, ... and n, min, mean.

    Equal values are counted first; values are bucketed by their place between the group's least and largest.
    Groups without a finite value are left out; without groups there is one row, of nulls and n = 0 if nothing is finite.
    """
    group = group or []
    v = df.select(*[F.coalesce(F.col(g), F.lit("")).alias(g) for g in group], F.col(col).cast("double").alias("v")).where(F.abs("v") < float("inf"))
    d = v.groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))
    ends = d.groupBy(*group).agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("all"))
    if group:
        d = d.join(ends, group)
    else:
        one = ends.first()  # three numbers
        d = d.withColumns({k: F.lit(one[k]) for k in ("lo", "hi", "all")}) if one["all"] else d.withColumns({"lo": F.lit(0.0), "hi": F.lit(0.0), "all": F.lit(0)})
    span = F.when(F.col("hi") > F.col("lo"), (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    d = d.withColumn("b", F.least(F.floor(span * buckets), F.lit(buckets - 1)))
    sums = d.groupBy(*group, "b").agg(F.sum("n").alias("bn"))
    over = W.partitionBy(*group).orderBy("b") if group else W.orderBy("b")
    before = sums.withColumn("before", F.sum("bn").over(over) - F.col("bn")).drop("bn")
    own = F.sum("n").over(W.partitionBy(*group, "b").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("own", own).join(before, [*group, "b"]).withColumn("stop", F.col("before") + F.col("own")).withColumn("start", F.col("stop") - F.col("n"))
    out = []
    for i, q in enumerate(qs):
        at = F.lit(q) * (F.col("all") - 1)
        low, high = F.floor(at), F.ceil(at)
        a = F.max(F.when((F.col("start") <= low) & (low < F.col("stop")), F.col("v")))
        b = F.max(F.when((F.col("start") <= high) & (high < F.col("stop")), F.col("v")))
        frac = F.max(at - low)
        out.append((a + (b - a) * frac).alias(f"q{i}"))
    sums = [F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("v").alias("min"), (F.sum(F.col("v") * F.col("n")) / F.sum("n")).alias("mean")]
    return d.groupBy(*group).agg(*out, *sums)


def upper_median(df: DataFrame, col: str, group: list[str] | None = None) -> DataFrame:
    """``median`` of each group: the upper of the two middle values; nulls don't count."""
    group = group or []
    d = df.select(*group, F.col(col).alias("v")).where("v is not null").groupBy(*group, "v").agg(F.count(F.lit(1)).alias("n"))
    return _at_half(d, group)


def _at_half(d: DataFrame, group: list[str]) -> DataFrame:
    """The value at which the counts of distinct values pass half of their sum."""
    b = F.floor(F.signum("v") * F.log1p(F.abs("v")) * 256)
    d = d.withColumn("b", b)
    sums = d.groupBy(*group, "b").agg(F.sum("n").alias("bn"))
    over = W.partitionBy(*group).orderBy("b") if group else W.orderBy("b")
    before = sums.withColumn("before", F.sum("bn").over(over) - F.col("bn")).drop("bn")
    total = sums.groupBy(*group).agg(F.sum("bn").alias("all"))
    own = F.sum("n").over(W.partitionBy(*group, "b").orderBy("v").rowsBetween(W.unboundedPreceding, 0))
    d = d.withColumn("own", own).join(before, [*group, "b"])
    d = d.join(total, group) if group else d.withColumn("all", F.lit((total.first() or [0])[0]))
    at = F.floor(F.col("all") / 2)
    stop = F.col("before") + F.col("own")
    return d.where((stop - F.col("n") <= at) & (at < stop)).select(*group, F.col("v").alias("median"))


def hash_shuffle(df: DataFrame, key: list[str], seed: int) -> DataFrame:
    """Rows in an order that depends on their key and the seed only."""
    return df.orderBy(F.xxhash64(F.lit(seed), *[F.col(k) for k in key]), *key)


def permutation(n: int, seed: int) -> list[int]:
    """A seeded order of ``n`` positions."""
    order = list(range(n))
    random.Random(seed).shuffle(order)
    return order


def steps(wanted: int, n: int, batch: int) -> int:
    """Training steps: as many as wanted, at most the full batches of ``n`` rows."""
    return min(wanted, n // batch)


def sample_indexes(seed: str, n: int, k: int) -> list[int]:
    """Sorted indexes of a seeded sample without replacement of ``k`` out of ``n``, depending on nothing else."""
    return sorted(random.Random(seed).sample(range(n), k)) if 0 < k < n else list(range(n))


def seeded_sample(df: DataFrame, group: str, order: str, targets: dict[str, int], seed: int) -> DataFrame:
    """At most ``targets[g]`` rows of each group in ``order``, the same ones in every run; groups without a target stay whole.

    The driver sees group sizes and at most the targets' many indexes; rows are never gathered.
    """
    ranked = ordered_rank(df, [group], range_bucket(F.col(order)), [order], "_rank")
    sizes = {r[group]: r["n"] for r in df.where(F.col(group).isin(list(targets))).groupBy(group).agg(F.count(F.lit(1)).alias("n")).collect()}
    cut = {g: sample_indexes(f"{seed}:{g}", n, targets[g]) for g, n in sizes.items() if 0 < targets[g] < n}
    if not cut:
        return ranked.drop("_rank")
    rows = [(g, i + 1) for g, ix in cut.items() for i in ix]
    chosen = df.sparkSession.createDataFrame(rows, f"{group} string, _rank long")
    drawn = ranked.where(F.col(group).isin(list(cut))).join(chosen, [group, "_rank"], "left_semi")
    rest = ranked.where(F.col(group).isNull() | ~F.col(group).isin(list(cut)))
    return drawn.select(*df.columns).unionByName(rest.select(*df.columns))
