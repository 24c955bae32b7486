"""Hard-tail selection: finite scores, hash holdout, round robin, summaries, decisions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.text import split_flags, stable_hash, text_of
from corpusmill.operators.ranking import hex_bucket, ordered_rank, quantiles
from corpusmill.session import cut


def finite(c: Column) -> Column:
    """Whether a double is a number."""
    return F.coalesce(F.abs(c) < float("inf"), F.lit(False))


def scored(audit: DataFrame, score: str, mean: str = "mean_logprob", drop_flags: tuple[str, ...] = ("truncated", "prefix_mismatch")) -> DataFrame:
    """Rows with a finite score and none of the flags, neither listed nor as a true column; adds task, score, mean (0 if none)."""
    flags = F.array(*[F.lit(f) for f in drop_flags])
    d = audit.where(finite(F.col(score))).where(~F.arrays_overlap(split_flags(F.col("quality_flags")), flags))
    for f in drop_flags:
        if f in audit.columns:
            d = d.where(~F.coalesce(F.col(f).cast("boolean"), F.lit(False)))
    task = F.coalesce(F.nullif(text_of(F.col("task_type")), F.lit("")), F.lit("unknown"))
    return d.withColumns({"task": task, "score": F.col(score), "mean": F.when(finite(F.col(mean)), F.col(mean)).otherwise(0.0)})


def holdout(rows: DataFrame, fraction: float, seed: int, row: str) -> DataFrame:
    """Adds ``held``: of each task the first max(1, round-half-even(n * fraction)) rows by a stable hash; none for a fraction of 0."""
    if fraction <= 0:
        return rows.withColumn("held", F.lit(False))
    h = stable_hash(seed, F.col("task"), F.col("id"), F.col("source"), F.col("method"))
    d = ordered_rank(rows.withColumn("_h", h), ["task"], hex_bucket(F.col("_h")), ["_h", row], "_rank")
    sizes = rows.groupBy("task").agg(F.count(F.lit(1)).alias("_n"))
    d = d.join(sizes, "task")
    return d.withColumn("held", F.col("_rank") <= F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction)).cast("int"))).drop("_h", "_rank", "_n")


def round_robin(rows: DataFrame, per_task: int, max_rows: int, seed: int, row: str, caps: dict[str, int] | None = None) -> DataFrame:
    """(row, task, score, mean, pick): one row of each task in turn until ``max_rows``, each (id, source, method) once.

    Tasks in order of name; within a task by score, mean, stable hash and row.  A key that another
    task has taken is passed over, which shifts later rounds; so the turn is folded over as many
    of the first tasks, and of the first rows of each, as the picks can ask for.
    """
    caps = caps or {}
    key = F.sha2(F.concat_ws("\0", *[text_of(F.col(c)) for c in ("id", "source", "method")]), 256)
    d = rows.select("task", "score", "mean", F.col(row).alias("row"), key.alias("key"), stable_hash(seed, F.col("id"), F.col("source"), F.col("method")).alias("h"))
    once = d.groupBy("task", "key").agg(F.min(F.struct("score", "mean", "h", "row")).alias("r")).select("task", "key", "r.*")
    cap = F.lit(per_task)
    for t, n in caps.items():
        cap = F.when(F.col("task") == t, n).otherwise(cap)
    once = once.withColumn("cap", F.least(cap, F.lit(max_rows))).where("cap > 0")
    place = F.row_number().over(W.partitionBy("task").orderBy("score", "mean", "h", "row"))
    # a task passes over at most as many keys as are picked; the window keeps the first ranks before the shuffle
    head = once.withColumn("place", place).where(F.col("place") <= F.lit(2 * max_rows))
    # a task with a key of its own always has a pick, so the first max_rows such tasks and those before them are enough
    own = once.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("task").alias("task")).where("n = 1").select("task").distinct()
    last = [r.task for r in own.orderBy("task").limit(max_rows).collect()]
    if len(last) == max_rows:
        head = head.where(F.col("task") <= last[-1])

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        queues = {t: list(g.sort_values("place").itertuples(index=False)) for t, g in pdf.groupby("task")}
        at, taken, counts, picks = dict.fromkeys(queues, 0), set(), dict.fromkeys(queues, 0), []
        moved = True
        while moved and len(picks) < max_rows:
            moved = False
            for t in sorted(queues):
                q = queues[t]
                if len(picks) >= max_rows or counts[t] >= q[0].cap:
                    continue
                while at[t] < len(q) and q[at[t]].key in taken:
                    at[t] += 1
                if at[t] < len(q):
                    r = q[at[t]]
                    at[t] += 1
                    taken.add(r.key)
                    counts[t] += 1
                    moved = True
                    picks.append((r.row, t, r.score, r.mean, len(picks) + 1))
        return pd.DataFrame(picks, columns=["row", "task", "score", "mean", "pick"])

    # one small group: twice the picks of each of the first tasks
    return head.withColumn("_all", F.lit(True)).groupBy("_all").applyInPandas(fold, "row long, task string, score double, mean double, pick int")


def score_summary(rows: DataFrame) -> DataFrame:
    """One row: n, min, p01, p05, p50 and mean of the scores."""
    return quantiles(rows, "score", [0.01, 0.05, 0.5]).withColumnsRenamed({"q0": "p01", "q1": "p05", "q2": "p50"})


# Patterns that speak for a path.
BIT = r"(?i)\b(bit|binary|8-bit|rot|rotate|shl|shr|shift|xor|and|or|not|gate|mask|truth)\b|[01]{6,}"
SYMBOLIC = r"(?i)operator|cryptarithm|equation|mapping|symbol|digit|encode|decode|transform|【|】|->|[A-Z]\s*[+\-*/=]\s*[A-Z]"
FORMAT = r"(?i)\\boxed|boxed|final answer|brace|answer marker|</think>|<think>|\{|\}|newline"
FORMAT_FLAGS = ("multiple_boxed", "boxed_appended", "final_boxed_mismatch", "answer_missing")


def path_scores(selected: DataFrame, worst: DataFrame, bit_sources: tuple[str, ...] = ()) -> DataFrame:
    """(path, score): evidence of the selected rows (task, source, quality_flags) and of the contexts of the worst ones.

    Scores are sums of evidence and may exceed 1.  No selected row counts as one, no worst row likewise.
    """
    task, source = F.lower(text_of(F.col("task"))), F.lower(text_of(F.col("source")))
    named = F.lit(False)
    for s in bit_sources:
        named = named | source.contains(s.lower())
    hits = F.size(F.filter(split_flags(F.col("quality_flags")), lambda f: f.isin(*FORMAT_FLAGS)))

    def total(c: Column) -> Column:
        return F.coalesce(F.sum(c.cast("double")), F.lit(0.0))

    symbolic = task.contains("symbolic") | task.contains("equation")
    zero = F.lit(0.0)
    a = selected.select(F.lit(1.0).alias("n"), *[c.cast("double").alias(k) for k, c in (("bt", task.contains("bit")), ("bs", named), ("st", symbolic), ("ff", hits))])
    text = text_of(F.col("worst_context"))
    b = worst.select(F.lit(1.0).alias("m"), *[text.rlike(p).cast("double").alias(k) for k, p in (("bc", BIT), ("sc", SYMBOLIC), ("fc", FORMAT))])
    # one aggregate over both sets of rows
    both = a.unionByName(b, allowMissingColumns=True)
    sums = both.agg(*[total(F.col(k)).alias(k) for k in both.columns]).withColumns({k: F.greatest(F.col(k), zero + 1) for k in ("n", "m")})
    col = F.col
    paths = F.array(
        F.struct(F.lit("symbolic_operator").alias("path"), (col("st") / col("n") + 0.35 * col("sc") / col("m")).alias("score")),
        F.struct(F.lit("bit_repair").alias("path"), (col("bt") / col("n") + 0.25 * col("bs") / col("n") + 0.35 * col("bc") / col("m")).alias("score")),
        F.struct(F.lit("formatting_repair").alias("path"), (0.5 * col("ff") / col("n") + 0.6 * col("fc") / col("m")).alias("score")),
        F.struct(F.lit("adapter_arithmetic").alias("path"), F.lit(0.05).alias("score")),
    )
    return sums.select(F.inline(paths))


def choose_path(scores: DataFrame, least: float = 0.25, lead: float = 0.08) -> DataFrame:
    """Adds ``chosen``: the best path, or ``inspect_manually`` when it is weak or hardly leads."""
    d = scores.agg(F.sort_array(F.collect_list(F.struct("score", "path")), asc=False).alias("t"))  # one entry for each path
    weak = (F.col("t")[0]["score"] < least) | (F.col("t")[0]["score"] - F.coalesce(F.try_element_at("t", F.lit(2))["score"], F.lit(0.0)) < lead)
    d = d.where(F.size("t") > 0).withColumn("chosen", F.when(weak, "inspect_manually").otherwise(F.col("t")[0]["path"]))
    return d.select("chosen", F.explode("t").alias("r")).select("r.path", "r.score", "chosen")


# What each path asks for.
ADVICE = {
    "symbolic_operator": "make a verifier or a generate-and-verify set for operators before any training on given answers",
    "bit_repair": "train on verified bit pairs against known failures, with a held-out anchor",
    "formatting_repair": "shorten traces or weigh the final answer; add no reasoning data before the formatting tail is smaller",
    "adapter_arithmetic": "try an anchored merge of adapters of equal shape; copy what doesn't fit from the anchor",
    "inspect_manually": "look at the worst contexts and widen the audit until one path leads",
}


def score_fields(score: str) -> tuple[str, str, str]:
    """Columns of mean, token and context that belong to a score."""
    p = "content_" if score.startswith("content_") else ""
    return f"{p}mean_logprob", f"{p}worst_token_text", f"{p}worst_context"


def worst_tokens(rows: DataFrame, token: str, score: str, row: str, top: int = 5) -> DataFrame:
    """(token, n, mean_score, min_score, top_sources, top_tasks, examples) of each token with a finite score.

    Counters are ``name:count`` joined by ``|``, by falling count and then by name; examples are the first rows.
    The rows are read once; all counters come from one aggregate by token, source and task.
    """
    d = rows.where(F.col(token).isNotNull() & finite(F.col(score))).select(
        F.col(token).alias("token"), F.col(score).alias("v"), text_of(F.col("source")).alias("source"), text_of(F.col("task_type")).alias("task"), F.col(row).alias("row")
    )
    d = cut(d)
    cells = cut(d.groupBy("token", "source", "task").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("_s"), F.min("v").alias("min_score")))
    base = cells.groupBy("token").agg(F.sum("n").alias("n"), F.sum("_s").alias("_s"), F.min("min_score").alias("min_score"))

    def counter(name: str, out: str) -> DataFrame:
        c = cells.groupBy("token", name).agg(F.sum("n").alias("k"))
        c = c.withColumn("r", F.row_number().over(W.partitionBy("token").orderBy(F.desc("k"), name))).where(F.col("r") <= top)
        joined = F.transform(F.array_sort(F.collect_list(F.struct("r", F.concat_ws(":", name, "k").alias("t")))), lambda x: x["t"])
        return c.groupBy("token").agg(F.array_join(joined, "|").alias(out))

    first = d.withColumn("r", F.row_number().over(W.partitionBy("token").orderBy("row"))).where(F.col("r") <= top)
    first = first.groupBy("token").agg(F.array_join(F.array_sort(F.collect_list("row")), "|").alias("examples"))
    out = base.join(counter("source", "top_sources"), "token").join(counter("task", "top_tasks"), "token").join(first, "token")
    return out.select("token", "n", (F.col("_s") / F.col("n")).alias("mean_score"), "min_score", "top_sources", "top_tasks", "examples")
