"""Lookups that fall back from one key to the next.

Build sides are reduced to one row for each key first, so that a hot key on the
probe side multiplies nothing; the probe side is joined as it is and left to the
skew handling of the adaptive planner.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import normal_prompt, text_of
from corpusmill.operators.ranking import first_per_key


def _spread(key: Column, row: Column) -> Column:
    """A key whose nulls and blanks are spread over all tasks and match nothing."""
    return F.coalesce(F.nullif(key, F.lit("")), F.concat(F.lit("\0"), row.cast("string")))


def tiered_lookup(df: DataFrame, train: DataFrame, row: str, order: Column | None = None) -> DataFrame:
    """Adds ``train_id``, ``train_prompt``, ``train_answer``: the train row of the same id, else of the same normal prompt.

    ``df`` has id, prompt and a unique ``row``; of train rows that share a key the last by ``order``
    (by id, prompt and answer if none is given) wins.  Blank ids and prompts match nothing.
    """
    order = order if order is not None else F.struct("id", "prompt", "answer")
    t = train.select(F.col("id").alias("train_id"), F.col("prompt").alias("train_prompt"), F.col("answer").alias("train_answer"), order.alias("_o"))
    by_id = first_per_key(t.where("train_id <> ''"), ["train_id"], F.col("_o"), last=True).drop("_o").withColumn("_k", F.col("train_id"))
    by_text = first_per_key(t.where(normal_prompt(F.col("train_prompt")) != ""), [normal_prompt(F.col("train_prompt"))], F.col("_o"), last=True)
    by_text = by_text.drop("_o").withColumn("_k2", F.sha2(normal_prompt(F.col("train_prompt")), 256))
    d = df.withColumn("_k", _spread(F.col("id"), F.col(row))).join(by_id, "_k", "left").drop("_k")
    miss = F.col("train_id").isNull() & (normal_prompt(F.col("prompt")) != "")
    d = d.withColumn("_k2", _spread(F.when(miss, F.sha2(normal_prompt(F.col("prompt")), 256)), F.col(row)))
    got = {f"train_{c}": f"_t_{c}" for c in ("id", "prompt", "answer")}
    d = d.join(by_text.withColumnsRenamed(got), "_k2", "left").drop("_k2")
    return d.withColumns({k: F.coalesce(F.col(k), F.col(v)) for k, v in got.items()}).drop(*got.values())


def strict_relaxed_match(audit: DataFrame, manifest: DataFrame, row: str, order: str) -> DataFrame:
    """Sets ``match_row`` and ``manifest_match`` of audit rows.

    Strict: same (id, source, method), the last manifest row by ``order`` wins.  Else the first of
    (id, method), (id, task_type), (id, '') that exactly one manifest row offers among all its
    relaxed keys, which share one space: a row without a method offers (id, '') twice and so
    shuts itself out.  The label is ``strict``, ``relaxed:`` and the key's second part (``id`` when
    that is empty), or ``missing``.  Nulls read as empty.
    """
    m = manifest.select(*[text_of(F.col(c)).alias(c) for c in ("id", "source", "method", "task_type")], F.col(order).alias("match_row"))
    strict = m.groupBy("id", "source", "method").agg(F.max("match_row").alias("_strict"))
    offers = m.select("id", "match_row", F.explode(F.array("method", "task_type", F.lit(""))).alias("_second"))
    single = offers.groupBy("id", "_second").agg(F.count(F.lit(1)).alias("n"), F.min("match_row").alias("_one")).where("n = 1").drop("n")
    a = audit.drop("match_row", "manifest_match").withColumns({f"_{c}": text_of(F.col(c)) for c in ("id", "source", "method", "task_type")})
    renamed = strict.withColumnsRenamed({"id": "_id", "source": "_source", "method": "_method"})
    a = a.join(renamed, ["_id", "_source", "_method"], "left")
    for i, second in enumerate((F.col("_method"), F.col("_task_type"), F.lit(""))):
        s = single.select(F.col("id").alias("_id"), F.col("_second").alias(f"_s{i}"), F.col("_one").alias(f"_one{i}"))
        a = a.withColumn(f"_s{i}", second).join(s, ["_id", f"_s{i}"], "left")
    label = F.when(F.col("_strict").isNotNull(), "strict")
    for i in range(3):
        label = label.when(F.col(f"_one{i}").isNotNull(), F.concat(F.lit("relaxed:"), F.coalesce(F.nullif(F.col(f"_s{i}"), F.lit("")), F.lit("id"))))
    return a.select(
        *[c for c in audit.columns if c not in ("match_row", "manifest_match")], F.coalesce("_strict", "_one0", "_one1", "_one2").alias("match_row"), label.otherwise("missing").alias("manifest_match")
    )


def longest_suffix(modules: DataFrame, patterns: DataFrame, module: str, sep: str = ".") -> DataFrame:
    """Adds ``pattern`` and ``value``: the pattern that equals the module or is its longest ending.

    Endings at every character would be a theta join; each module is unfolded into its endings of
    the lengths that patterns have, and those are joined by equality.  A module without a pattern gets nulls.
    """
    p = patterns.where("pattern is not null and pattern <> ''").groupBy("pattern").agg(F.min("value").alias("value"))
    lengths = sorted(r[0] for r in p.select(F.length("pattern")).distinct().collect())  # one number for each length of a name
    if not lengths:
        return modules.withColumns({"pattern": F.lit(None).cast("string"), "value": F.lit(None).cast("double")})
    m = modules.select(F.col(module).alias("_m")).where("_m is not null").distinct()
    ends = m.withColumn("_n", F.explode(F.array(*[F.lit(n) for n in lengths]))).where(F.col("_n") <= F.length("_m"))
    hit = ends.withColumn("pattern", F.expr("right(_m, _n)")).join(p, "pattern").groupBy("_m").agg(F.max_by(F.struct("pattern", "value"), "_n").alias("_h"))
    return modules.join(hit, modules[module] == hit["_m"], "left").select(*[modules[c] for c in modules.columns], "_h.pattern", "_h.value")


def resume(train: DataFrame, existing: DataFrame, base: DataFrame, key: str, order: str) -> DataFrame:
    """Adds ``origin`` and ``done_row``: existing results first, then base ones, else ``todo``; of several the last by ``order``."""
    e = existing.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("_e"))
    b = base.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).alias("_b"))
    d = train.join(e, key, "left").join(b, key, "left")
    origin = F.when(F.col("_e").isNotNull(), "existing").when(F.col("_b").isNotNull(), "base").otherwise("todo")
    return d.withColumn("origin", origin).withColumn("done_row", F.coalesce("_e", "_b")).drop("_e", "_b")
