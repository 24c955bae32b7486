"""Trace candidates: canonical fields, quality flags, and statistics of sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import FILTER_FLAGS, append_box, audit_class, final_box, flat_boxes, join_flags, normal_answer, normal_prompt, split_flags, text_of
from corpusmill.operators.joins import tiered_lookup


def candidates(
    traces: DataFrame, train: DataFrame, row: str, order: Column | None = None, attach_box: bool = False, oracle: Column | None = None, forced: list[str] | None = None
) -> DataFrame:
    """(row, id, source, task_type, prompt, answer, completion, method, quality_flags, enabled) of every trace.

    A trace without a train row is named by its id or its row.  Null fields read as empty.
    """
    # only the columns used here, so that no other can clash
    used = ("id", "source", "task_type", "prompt", "answer", "completion", "method")
    flagged = F.coalesce(oracle, F.lit(False)) if oracle is not None else F.lit(False)
    d = tiered_lookup(traces.select(F.col(row), *[c for c in used if c != row], flagged.alias("_oracle")), train, row, order)
    joined = F.col("train_id").isNotNull()
    raw_prompt, raw_answer = normal_prompt(F.col("prompt")), normal_answer(F.col("answer"))
    prompt = F.when(joined, normal_prompt(F.col("train_prompt"))).otherwise(raw_prompt)
    answer = F.when(joined, normal_answer(F.col("train_answer"))).otherwise(raw_answer)
    d = d.withColumns({"_rp": raw_prompt, "_ra": raw_answer, "_p": prompt, "_a": answer, "_boxes": flat_boxes(F.col("completion")), "_box": final_box(F.col("completion"))})
    boxed = F.size("_boxes") > 0
    attach = ~boxed & F.lit(attach_box) & (F.col("_a") != "")

    def flag(name: str, when: Column) -> Column:
        return F.when(when, name)

    flags = [
        flag("no_train_join", ~joined),
        flag("prompt_match", joined & (F.col("_rp") != "") & (F.col("_rp") == F.col("_p"))),
        flag("prompt_mismatch", joined & (F.col("_rp") != "") & (F.col("_rp") != F.col("_p"))),
        flag("prompt_from_train", joined & (F.col("_rp") == "")),
        flag("source_answer_match", joined & (F.col("_ra") != "") & (F.col("_ra") == F.col("_a"))),
        flag("source_answer_mismatch", joined & (F.col("_ra") != "") & (F.col("_ra") != F.col("_a"))),
        flag("answer_from_train", joined & (F.col("_ra") == "")),
        flag("multiple_boxed", F.size("_boxes") > 1),
        flag("final_boxed_match", boxed & (F.col("_box") == F.col("_a"))),
        flag("final_boxed_mismatch", boxed & (F.col("_box") != F.col("_a"))),
        flag("boxed_appended", attach),
        flag("no_boxed", ~boxed & ~attach),
        flag("oracle_true", F.col("_oracle")),
        *[F.lit(f) for f in forced or []],
    ]
    d = d.withColumn("quality_flags", join_flags(*flags))
    off = F.arrays_overlap(F.split("quality_flags", ";"), F.array(*[F.lit(f) for f in (*FILTER_FLAGS, *(forced or []))]))
    name = F.coalesce("train_id", F.nullif(F.col("id"), F.lit("")), F.concat(F.lit("row_"), F.lpad(F.col(row).cast("string"), 6, "0")))
    return d.select(
        F.col(row).alias("row"),
        name.alias("id"),
        "source",
        F.coalesce(F.nullif(text_of(F.col("task_type")), F.lit("")), audit_class(F.col("_p"))).alias("task_type"),
        F.col("_p").alias("prompt"),
        F.col("_a").alias("answer"),
        F.when(attach, append_box(text_of(F.col("completion")), F.col("_a"))).otherwise(text_of(F.col("completion"))).alias("completion"),
        "method",
        "quality_flags",
        (~off).alias("enabled"),
    )


def source_stats(cands: DataFrame) -> DataFrame:
    """One row for each source: rows, joined, matches, boxes, enabled."""

    def having(*names: str) -> Column:
        f = F.split("quality_flags", ";")
        return F.sum(sum((F.array_contains(f, n).cast("bigint") for n in names), F.lit(0)))

    n = F.count(F.lit(1))
    return cands.groupBy("source").agg(
        n.alias("raw_rows"),
        (n - having("no_train_join")).alias("train_joined"),
        having("prompt_match", "prompt_from_train").alias("prompt_match"),
        having("source_answer_match", "answer_from_train").alias("source_answer_match"),
        (n - having("boxed_appended", "no_boxed")).alias("boxed_checked"),
        having("final_boxed_match").alias("boxed_match"),
        having("final_boxed_mismatch").alias("boxed_mismatch"),
        having("boxed_appended").alias("boxed_appended"),
        having("oracle_true").alias("oracle_true"),
        F.sum(F.col("enabled").cast("bigint")).alias("enabled_rows"),
    )


def flag_counts(cands: DataFrame, disabled_only: bool = True) -> DataFrame:
    """(source, flag, n): how often each flag stands at a source; of disabled rows only the flags that disable."""
    d = cands.where(~F.col("enabled")) if disabled_only else cands
    d = d.select("source", F.explode(split_flags(F.col("quality_flags"))).alias("flag"))
    return (d.where(F.col("flag").isin(*FILTER_FLAGS)) if disabled_only else d).groupBy("source", "flag").agg(F.count(F.lit(1)).alias("n"))


def keep_records(
    df: DataFrame,
    task_types: list[str] | None = None,
    sources: list[str] | None = None,
    methods: list[str] | None = None,
    ids: DataFrame | None = None,
    require: tuple[str, ...] = (),
    drop_flags: list[str] | None = None,
) -> DataFrame:
    """Rows that meet all conditions given; ``require`` names columns that must hold more than white space."""
    for c, values in (("task_type", task_types), ("source", sources), ("method", methods)):
        if values:
            df = df.where(F.col(c).isin(*values))
    for c in require:
        df = df.where(normal_answer(F.col(c)) != "")
    if drop_flags:
        df = df.where(~F.arrays_overlap(split_flags(F.col("quality_flags")), F.array(*[F.lit(f) for f in drop_flags])))
    return df.join(ids.select("id").distinct(), "id", "left_semi") if ids is not None else df
