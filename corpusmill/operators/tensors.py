"""Named tensors as rows (key, shape, dtype, data): audits, overlays, low-rank merges."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Projections of a module and sides of a factor pair.
PROJECTIONS = ("in_proj", "out_proj", "q_proj", "k_proj", "v_proj", "o_proj", "up_proj", "down_proj", "lm_head")
SIDES = ("lora_A", "lora_B")


def category(key: Column) -> Column:
    """Projection and side of a tensor's name; experts first, ``other`` last."""
    side = F.when(key.contains(".lora_A."), "lora_A").when(key.contains(".lora_B."), "lora_B")
    inner = F.when(key.contains(".up_proj.lora_"), "up_proj").when(key.contains(".down_proj.lora_"), "down_proj")
    expert = F.coalesce(F.concat(F.lit("experts."), inner, F.lit("."), side), F.lit("experts.other"))
    found = F.coalesce(*[F.when(key.contains(f".{p}."), F.concat(F.lit(f"{p}."), F.coalesce(side, F.lit("other")))) for p in PROJECTIONS], F.lit("other"))
    return F.when(key.contains(".experts."), expert).otherwise(found)


def module_of(a_key: Column) -> Column:
    return F.substring_index(a_key, ".lora_A.", 1)


def partner(a_key: Column) -> Column:
    """Name of the B factor of an A factor."""
    return F.replace(a_key, F.lit(".lora_A."), F.lit(".lora_B."))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; a zero vector gives 1 beside an equal one, else 0; null for other lengths or non-finite values."""
    norm = F.sqrt(_dot(a, a) * _dot(b, b))
    c = F.when(norm == 0, F.when(a == b, 1.0).otherwise(0.0)).otherwise(_dot(a, b) / norm)
    return F.when((F.size(a) == F.size(b)) & (F.abs(norm) < float("inf")), c)


def mean_delta(a: Column, b: Column) -> Column:
    """Mean absolute difference of two arrays of equal length."""
    gap = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), gap / F.size(a))


def compare(reference: DataFrame, candidate: DataFrame, by: Column) -> DataFrame:
    """For each category of the reference: tensors, missing, other shapes, mean and least cosine, mean difference."""
    c = candidate.select("key", F.col("data").alias("_d"), F.lit(True).alias("_there"))
    d = reference.join(c, "key", "left").withColumn("category", by)
    there = F.coalesce("_there", F.lit(False))
    cos = cosine(F.col("data"), F.col("_d"))
    d = d.select("category", there.alias("there"), F.when(there, cos).alias("cos"), mean_delta(F.col("data"), F.col("_d")).alias("delta"), (F.size("data") != F.size("_d")).alias("shape"))
    return d.groupBy("category").agg(
        F.count(F.lit(1)).alias("tensors"),
        F.sum((~F.col("there")).cast("bigint")).alias("missing"),
        F.sum((F.col("there") & F.coalesce("shape", F.lit(False))).cast("bigint")).alias("other_shape"),
        F.avg("cos").alias("mean_cosine"),
        F.min("cos").alias("min_cosine"),
        F.avg("delta").alias("mean_delta"),
    )


def overlay(reference: DataFrame, source: DataFrame, keep: Column) -> DataFrame:
    """(key, data, origin): reference tensors, replaced by the source's where ``keep`` holds for the key and the source has it."""
    s = source.select("key", F.col("data").alias("_s"))
    d = reference.join(s, "key", "left")
    taken = keep & F.col("_s").isNotNull()
    return d.select("key", F.when(taken, F.col("_s")).otherwise(F.col("data")).alias("data"), F.when(taken, "source").when(keep, "missing").otherwise("reference").alias("origin"))


def factor_pairs(tensors: DataFrame, include: str | None = None, exclude: str | None = None) -> DataFrame:
    """(module, a_key, b_key): A factors that have their B factor, modules filtered by patterns found anywhere."""
    a = tensors.where(F.col("key").contains(".lora_A.")).select(module_of(F.col("key")).alias("module"), F.col("key").alias("a_key"), partner(F.col("key")).alias("b_key"))
    for pattern, wanted in ((include, True), (exclude, False)):
        if pattern:
            a = a.where(F.col("module").rlike(pattern) if wanted else ~F.col("module").rlike(pattern))
    return a.join(tensors.select(F.col("key").alias("b_key")), "b_key", "left_semi").select("module", "a_key", "b_key")


def low_rank_sum(lefts: list[np.ndarray], rights: list[np.ndarray], rank: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Factors (A, B) of rank ``rank`` with ``scale * B @ A`` nearest to the sum of ``left @ right``, the sum itself never built."""
    left, right = np.concatenate(lefts, axis=1).astype(np.float64), np.concatenate(rights, axis=0).astype(np.float64)
    ql, rl = np.linalg.qr(left)
    qr, rr = np.linalg.qr(right.T)
    u, s, vt = np.linalg.svd(rl @ rr.T, full_matrices=False)
    k = min(rank, len(s))
    root = np.sqrt(s[:k])
    b, a = np.zeros((left.shape[0], rank)), np.zeros((rank, right.shape[1]))
    b[:, :k] = (ql @ u[:, :k]) * root / scale
    a[:k] = (root[:, None] * vt[:k]) @ qr.T
    return a, b


def merge_low_rank(factors: DataFrame, rank: int, alpha: float) -> DataFrame:
    """(module, side, shape, data) of the merged factors.

    ``factors`` has module, adapter, weight, scale, a_shape, a, b_shape, b (row-major): one row for
    each adapter and module, and each module is one group of a few rows.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("adapter").itertuples(index=False)
        lefts, rights = [], []
        for r in rows:
            rights.append(np.asarray(r.a, np.float64).reshape(tuple(r.a_shape)))
            lefts.append(np.asarray(r.b, np.float64).reshape(tuple(r.b_shape)) * (r.weight * r.scale))
        a, b = low_rank_sum(lefts, rights, rank, alpha / rank)
        out = [(pdf.module.iloc[0], side, list(x.shape), x.astype(np.float32).ravel().tolist()) for side, x in (("lora_A", a), ("lora_B", b))]
        return pd.DataFrame(out, columns=["module", "side", "shape", "data"])

    return factors.groupBy("module").applyInPandas(run, "module string, side string, shape array<int>, data array<float>")


def key_variants(key: Column, rewrites: list[list[tuple[str, str]]]) -> Column:
    """Distinct spellings of a name in order: itself, then each list of replacements applied to it."""
    forms = [key]
    for steps in rewrites:
        k = key
        for old, new in steps:
            k = F.replace(k, F.lit(old), F.lit(new))
        forms.append(k)
    return F.array_distinct(F.array(*forms))


def load_mapping(adapter: DataFrame, model: DataFrame, variants: Column) -> DataFrame:
    """(key, target, shared): each adapter key's first variant the model has; null target is missing, ``shared`` targets are hit twice."""
    v = adapter.select("key", F.posexplode(variants).alias("pos", "target"))
    hit = v.join(model.select(F.col("key").alias("target")), "target", "left_semi").groupBy("key").agg(F.min_by("target", "pos").alias("target"))
    uses = hit.groupBy("target").agg((F.count(F.lit(1)) > 1).alias("shared"))
    return adapter.select("key").join(hit.join(uses, "target"), "key", "left").select("key", "target", F.coalesce("shared", F.lit(False)).alias("shared"))


def renamed(key: Column, steps: list[tuple[str, str]]) -> Column:
    """A name after replacements in order."""
    for old, new in steps:
        key = F.replace(key, F.lit(old), F.lit(new))
    return key


def restored(key: Column, mode: str, endings: tuple[str, ...] = ()) -> Column:
    """Whether a tensor is taken back from the reference: none, all factors of experts, or experts with given endings."""
    expert = key.contains(".experts.")
    if mode == "none":
        return F.lit(False)
    if mode in ("all_moe", "all_experts"):
        return expert & (key.contains(".lora_A.") | key.contains(".lora_B."))
    if mode == "broken_moe":
        hit = F.lit(False)
        for e in endings:
            hit = hit | key.endswith(e)
        return expert & hit
    raise ValueError(f"unknown mode {mode!r}")


def adapter_spec(text: str) -> tuple[str, str, float]:
    """``name=path:weight``."""
    name, _, rest = text.partition("=")
    path, sep, weight = rest.rpartition(":")
    if not (name and path and sep):
        raise ValueError(f"{text!r} isn't name=path:weight")
    return name, path, float(weight)


def tied(tensors: DataFrame, group: Column) -> DataFrame:
    """(group, shape, data) of tensors that share their values: the mean of each group, place by place; null groups are left out.

    ``tensors`` has shape and data.  Tensors are unfolded to places, so a group of any number of tensors is combined in every task.
    """
    places = tensors.select(group.alias("group"), "shape", F.posexplode("data").alias("place", "x")).where(F.col("group").isNotNull())
    means = places.groupBy("group", "shape", "place").agg((F.sum(F.col("x").cast("double")) / F.count(F.lit(1))).alias("x"))
    rows = means.groupBy("group", "shape").agg(F.array_sort(F.collect_list(F.struct("place", "x"))).alias("d"))
    return rows.select("group", "shape", F.transform("d", lambda r: r["x"]).alias("data"))


def checked(comparison: DataFrame, min_cosine: float = 0.999, max_delta: float = 1e-8) -> DataFrame:
    """A comparison that fails when run if a tensor is missing, has another shape, or differs beyond the limits."""
    ok = (F.col("missing") == 0) & (F.col("other_shape") == 0) & (F.col("min_cosine") >= min_cosine) & (F.col("mean_delta") <= max_delta)
    return comparison.where(F.assert_true(F.coalesce(ok, F.lit(False)), F.concat(F.lit("tensors differ in "), F.col("category").cast("string"))).isNull())
