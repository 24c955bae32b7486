"""Summaries of manifests, audits and selections: small aggregates, collected as one document."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import split_flags, text_of
from corpusmill.operators.candidates import flag_counts, source_stats
from corpusmill.operators.tails import finite, score_summary


def counts(df: DataFrame, key: Column, name: str, first: str | None = None) -> DataFrame:
    """(``name``, n) of all values, the commonest first; equal counts by first row of ``first``, else by name."""
    tie = F.min(first) if first else F.min(key)
    d = df.groupBy(text_of(key).alias(name)).agg(F.count(F.lit(1)).alias("n"), tie.alias("_t"))
    return d.orderBy(F.desc("n"), "_t", name).drop("_t")


def counter(df: DataFrame, key: Column, first: str | None = None, top: int = 50) -> dict[str, int]:
    """The ``top`` commonest values with their counts; equal counts by first row of ``first``, else by name."""
    return {r.k: r.n for r in counts(df, key, "k", first).limit(top).collect()}


def flag_counter(df: DataFrame, first: str | None = None, top: int = 50) -> dict[str, int]:
    """The commonest quality flags."""
    cols = [first] if first else []
    return counter(df.select(*cols, F.explode(split_flags(F.col("quality_flags"))).alias("flag")), F.col("flag"), first, top)


def manifest_summary(cands: DataFrame) -> dict[str, Any]:
    """Rows, counts by source, task and flag, and statistics with the disabling flags of each source."""
    per = {text: r.asDict() for r in source_stats(cands).collect() for text in [r.source or ""]}
    for r in flag_counts(cands).orderBy(F.desc("n"), "flag").collect():
        per[r.source or ""].setdefault("filter_flags", {})[r.flag] = r.n
    return {
        "rows": cands.count(),
        "by_source": counter(cands, F.col("source"), "row", 10_000),
        "by_task_type": counter(cands, F.col("task_type"), "row", 10_000),
        "quality_flags": flag_counter(cands, "row"),
        "sources": dict(sorted(per.items())),
    }


def audit_summary(audit: DataFrame, scores: tuple[str, ...] = ("min_logprob", "content_min_logprob"), worst: int = 20) -> dict[str, Any]:
    """Counts, and for each score its mean, least, mean by task and the ``worst`` rows; scores that aren't columns are left out.

    ``by_source`` (source, n), ``by_task_type`` (task_type, n) and each ``by_task_mean`` (task_type, mean) grow with the
    table, so they are DataFrames of all values.
    """
    out: dict[str, Any] = {
        "rows": audit.count(),
        "by_source": counts(audit, F.col("source"), "source"),
        "by_task_type": counts(audit, F.col("task_type"), "task_type"),
        "quality_flags": flag_counter(audit),
    }
    for f in ("truncated", "prefix_mismatch"):
        if f in audit.columns:
            out[f] = audit.where(F.coalesce(F.col(f).cast("boolean"), F.lit(False))).count()
    for s in scores:
        if s not in audit.columns:
            continue
        d = audit.where(finite(F.col(s)))
        total = d.agg(F.count(F.lit(1)).alias("n"), F.avg(s).alias("mean"), F.min(s).alias("min")).first()
        if not total.n:
            continue
        by = d.groupBy(text_of(F.col("task_type")).alias("task_type")).agg(F.avg(s).alias("mean")).orderBy("task_type")
        out[s] = {"mean": total["mean"], "min": total["min"], "by_task_mean": by}
        out[f"{s}_worst_rows"] = [r.asDict() for r in d.orderBy(s).limit(worst).collect()]
    return out


def tail_summary(rows: DataFrame, selected: DataFrame, holdout: DataFrame, token: str | None = None) -> dict[str, Any]:
    """Row counts, score statistics of all rows, and counters of the selected ones with the 30 worst of them."""
    score = score_summary(rows).first()
    out = {
        "audit_rows": rows.count(),
        "selected_rows": selected.count(),
        "holdout_rows": holdout.count(),
        "score": {k: score[k] for k in ("min", "p01", "p05", "p50", "mean")} if score else dict.fromkeys(("min", "p01", "p05", "p50", "mean")),
        "selected_by_task_type": counter(selected, F.col("task"), top=10_000),
        "selected_by_source": counter(selected, F.col("source"), top=10_000),
        "selected_quality_flags": flag_counter(selected),
        "worst_selected_rows": [r.asDict() for r in selected.orderBy("score", "mean").limit(30).collect()],
    }
    if token:
        out["selected_worst_tokens"] = [{"worst_token_text": k, "count": n} for k, n in counter(selected, F.col(token), top=30).items()]
    return out


def dry_run(records: DataFrame, examples: DataFrame, key: str) -> DataFrame:
    """Records without an example, then the examples: what a run would write; ``is_example`` tells them apart."""
    left = records.join(examples.select(key).distinct(), key, "left_anti").withColumn("is_example", F.lit(False))
    return left.unionByName(examples.withColumn("is_example", F.lit(True)), allowMissingColumns=True)
