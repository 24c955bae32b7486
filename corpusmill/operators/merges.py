"""Planning and carrying out merges of low-rank adapters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.joins import longest_suffix
from corpusmill.operators.tensors import factor_pairs, merge_low_rank

POLICIES = {"strict": "error", "anchor-copy": "anchor_copy", "common-only": "skipped"}


def delta_shape(a: Column, b: Column) -> Column:
    """(rows of B, columns of A) of a factor pair; null unless both are matrices that fit."""
    fits = (F.size(a) == 2) & (F.size(b) == 2) & (F.try_element_at(a, F.lit(1)) == F.try_element_at(b, F.lit(2)))
    return F.when(fits, F.array(F.try_element_at(b, F.lit(1)), F.try_element_at(a, F.lit(2))))


def rank_of(a: Column, b: Column) -> Column:
    """Rank of a factor pair; an error for shapes that don't fit."""
    return F.when(delta_shape(a, b).isNotNull(), F.element_at(a, 1)).otherwise(F.raise_error(F.lit("shapes of a factor pair don't fit")))


def _pairs(tensors: DataFrame) -> DataFrame:
    """(adapter, module, a_shape, b_shape) of the factor pairs of each adapter's tensors."""
    a = tensors.where(F.col("key").contains(".lora_A.")).select("adapter", F.substring_index("key", ".lora_A.", 1).alias("module"), F.replace("key", F.lit(".lora_A."), F.lit(".lora_B.")).alias("_b"), F.col("shape").alias("a_shape"))
    b = tensors.select(F.col("adapter"), F.col("key").alias("_b"), F.col("shape").alias("b_shape"))
    return a.join(b, ["adapter", "_b"]).drop("_b")


def plan(tensors: DataFrame, anchor: str, policy: str = "strict", include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(module, a_key, b_key, status, action, offenders) of the anchor's modules.

    ``tensors`` has adapter, key, shape.  A module is compatible when every adapter has both
    factors and the product's shape is the anchor's; otherwise the policy names the action.
    """
    anchors = factor_pairs(tensors.where(F.col("adapter") == anchor), include, exclude)
    every = _pairs(tensors).select("adapter", "module", delta_shape(F.col("a_shape"), F.col("b_shape")).alias("d"))
    names = sorted(r.adapter for r in tensors.select("adapter").distinct().collect())  # a handful of adapters
    want = every.where(F.col("adapter") == anchor).select("module", F.col("d").alias("want"))
    grid = anchors.withColumn("adapter", F.explode(F.array(*[F.lit(n) for n in names])))
    d = grid.join(every, ["adapter", "module"], "left").join(want, "module", "left")
    bad = ~F.coalesce(F.col("d") == F.col("want"), F.lit(False))
    d = d.groupBy("module", "a_key", "b_key").agg(F.array_sort(F.collect_list(F.when(bad, F.col("adapter")))).alias("offenders"))
    ok = F.size("offenders") == 0
    return d.select(
        "module", "a_key", "b_key", F.when(ok, "compatible").otherwise("incompatible").alias("status"), F.when(ok, "svd").otherwise(POLICIES[policy]).alias("action"), "offenders"
    )


def scales(modules: DataFrame, alphas: DataFrame, default_alpha: float | None = None) -> DataFrame:
    """Adds ``scale`` to rows with module and rank: alpha over rank, alpha by the longest pattern, else the default, else the rank."""
    d = longest_suffix(modules, alphas, "module")
    alpha = F.coalesce(F.col("value"), F.lit(default_alpha).cast("double") if default_alpha is not None else F.col("rank").cast("double"), F.col("rank").cast("double"))
    return d.withColumn("scale", alpha / F.col("rank")).drop("pattern", "value")


def merge(tensors: DataFrame, weights: dict[str, float], planned: DataFrame, alphas: dict[str, float], rank: int, alpha: float) -> DataFrame:
    """(key, shape, data) of the planned merge of adapters with data: ``svd`` modules are summed, ``anchor_copy`` ones are copied by the caller.

    Each module is one group of as many rows as there are adapters.
    """
    names = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    default = F.create_map(*[F.lit(x) for kv in alphas.items() for x in kv])
    a = tensors.select("adapter", F.col("key").alias("a_key"), F.col("shape").alias("a_shape"), F.col("data").alias("a"))
    b = tensors.select("adapter", F.col("key").alias("b_key"), F.col("shape").alias("b_shape"), F.col("data").alias("b"))
    chosen = planned.where("action = 'svd'").select("module", "a_key", "b_key")
    d = chosen.join(a, "a_key").join(b, ["adapter", "b_key"])
    own = rank_of(F.col("a_shape"), F.col("b_shape"))
    d = d.withColumns({"weight": names[F.col("adapter")], "scale": default[F.col("adapter")] / own})
    out = merge_low_rank(d.select("module", "adapter", "weight", "scale", "a_shape", "a", "b_shape", "b"), rank, alpha)
    keys = chosen.select("module", F.explode(F.create_map(F.lit("lora_A"), F.col("a_key"), F.lit("lora_B"), F.col("b_key"))).alias("side", "key"))
    return out.join(keys, ["module", "side"]).select("key", "shape", "data")


def config_overrides(planned: DataFrame, ranks: DataFrame) -> DataFrame:
    """(module, rank, alpha) of modules copied from the anchor, which keep their own."""
    return planned.where("action = 'anchor_copy'").join(ranks, "module").select("module", "rank", "alpha")
