"""Whole dataflows, from sources to files; each is a composition of operators and writes what it made."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions import text as tx
from corpusmill.functions.rewards import with_reward
from corpusmill.operators import candidates as cd
from corpusmill.operators import harvest, merges, notebooks, preferences, ranking, solvers, summaries, tails, tensors
from corpusmill.operators.joins import resume, strict_relaxed_match
from corpusmill.session import cut
from corpusmill.sources import catalog, readers, sinks


def profile(train: DataFrame, test: DataFrame) -> dict[str, Any]:
    """Rows, overlaps by id and prompt, counts by class, answer shape and answer length, five prompts of each class."""
    ranked = train.select(tx.corpus_class(F.col("prompt")).alias("c"), "id", tx.prefix(F.col("prompt")).alias("p"))
    ranked = ranked.withColumn("r", F.row_number().over(W.partitionBy("c").orderBy("id", "p"))).where("r <= 5")
    known = test.join(train.select("id").distinct(), "id", "left_semi")
    texts = test.select(tx.normal_prompt(F.col("prompt")).alias("p")).distinct().join(train.select(tx.normal_prompt(F.col("prompt")).alias("p")).distinct(), "p", "left_semi")
    out: dict[str, Any] = {
        "train_rows": train.count(),
        "test_rows": test.count(),
        "id_overlap": known.select("id").distinct().count(),
        "prompt_overlap": texts.count(),
        "by_class": summaries.counter(train, tx.corpus_class(F.col("prompt"))),
        "by_answer": summaries.counter(train, tx.answer_shape(F.col("answer"))),
        "by_length": summaries.counter(train, F.length(tx.text_of(F.col("answer"))).cast("string"), top=20),
        "heads": {},
    }
    for r in ranked.orderBy("c", "r").collect():
        out["heads"].setdefault(r.c, []).append(r.p)
    return out


def manifest(spark: SparkSession, specs: list[dict], train: DataFrame, seed: int, include_disabled: bool = False, attach_box: bool = True) -> tuple[DataFrame, dict[str, Any]]:
    """Sampled trace records of all sources, and the summary of their candidates."""
    traces, noted = catalog.load(spark, specs, train)
    rows = cut(ranking.ordered_rank(traces.withColumn("_o", F.xxhash64(*readers.TRACE_FIELDS)), [], F.shiftright("_o", 54), ["_o", "id", "source"], "trace_id").drop("_o"))
    cands = cut(cd.candidates(rows, train, "trace_id", attach_box=attach_box))
    pool = cands if include_disabled else cands.where("enabled")
    targets = {str(s["name"]): int(s["target"]) for s in specs if int(s.get("target") or 0) > 0}
    picked = ranking.seeded_sample(pool, "source", "row", targets, seed)
    summary = summaries.manifest_summary(cands) | {"specs": noted}
    return picked.select(*readers.TRACE_FIELDS), summary


def hard_tail(
    audit: DataFrame, manifest_rows: DataFrame | None, row: str, score: str = "min_logprob", fraction: float = 0.08, per_task: int = 64, max_rows: int = 256, seed: int = 20260606, caps: dict[str, int] | None = None
) -> tuple[DataFrame, DataFrame, dict[str, Any]]:
    """(selected, holdout, summary): finite scores, manifest fields laid over, hash holdout, round robin."""
    d = audit.where(tails.finite(F.col(score)))
    if manifest_rows is not None:
        m = manifest_rows.withColumn("_m", F.xxhash64(*readers.TRACE_FIELDS))
        d = strict_relaxed_match(d, m, row, "_m")
        over = [c for c in ("prompt", "completion", "answer", "quality_flags", "source", "task_type", "method")]
        got = ranking.first_per_key(m, ["_m"], F.col("id")).select(F.col("_m").alias("match_row"), *[F.col(c).alias(f"_{c}") for c in over])
        d = d.join(got, "match_row", "left")
        for c in over:
            old = F.col(c) if c in audit.columns else F.lit(None).cast("string")
            d = d.withColumn(c, F.when(F.col("match_row").isNotNull(), F.col(f"_{c}")).otherwise(old)).drop(f"_{c}")
    d = cut(tails.holdout(tails.scored(d, score), fraction, seed, row))
    picks = tails.round_robin(d.where("NOT held"), per_task, max_rows, seed, row, caps)
    selected = d.join(picks.select(F.col("row").alias(row), "pick"), row)
    held = d.where("held")
    return selected, held, summaries.tail_summary(d, selected, held, "worst_context" if "worst_context" in d.columns else None)


def decide(selected: DataFrame, bit_sources: tuple[str, ...] = ()) -> dict[str, Any]:
    """Chosen path and the scores of all, from selected rows and their 30 worst contexts."""
    worst = selected.orderBy("score", "mean").limit(30)
    rows = tails.choose_path(tails.path_scores(selected, worst, bit_sources)).orderBy(F.desc("score")).collect()
    return {"path": rows[0].chosen, "scores": {r.path: r.score for r in rows}}


def calibrate(pairs: DataFrame) -> DataFrame:
    """(score, dim, value, n, mean_margin, win_rate) of pairs with chosen and rejected completions of the same prompt.

    ``pairs`` has id, task_type, prompt, answer, chosen, rejected, chosen_source, rejected_source.
    """
    keep = ["id", "task", "sides"]
    p = pairs.withColumns({"task": tx.reward_task(F.col("task_type")), "sides": F.concat_ws(">", "chosen_source", "rejected_source"), "_n": F.monotonically_increasing_id()})
    p = cut(p)
    sides = []
    for side in ("chosen", "rejected"):
        scored = with_reward(p.withColumn("completion", F.col(side)), ["_n", *keep])
        sides.append(scored.select("_n", *(keep if side == "chosen" else []), F.col("scores").alias(side)))
    d = sides[0].join(sides[1], "_n").select("*", F.explode(F.map_keys("chosen")).alias("score"))
    d = d.select("score", "task", "sides", F.element_at("chosen", F.col("score")).alias("up"), F.element_at("rejected", F.col("score")).alias("down"))
    out = None
    for s in ("verifier", "sequence_correctness", "composite_simple"):
        m = preferences.margins(d.where(F.col("score") == s), F.col("up"), F.col("down"), ["task", "sides"]).select(F.lit(s).alias("score"), "*")
        out = m if out is None else out.unionByName(m)
    return out


def completed(train: DataFrame, existing: DataFrame, base: DataFrame) -> DataFrame:
    """(id, origin, prediction, method, completion): earlier results first, then base ones; what is left is solved, with the known answer as a constraint."""
    todo = resume(train.groupBy("id").agg(F.max(F.struct("prompt", "answer")).alias("p")).select("id", "p.prompt", "p.answer"), existing, base, "id", "row")
    done = existing.unionByName(base).select(F.col("row").alias("done_row"), F.col("completion").alias("_c"), F.col("method").alias("_m"))
    done = ranking.first_per_key(done, ["done_row"], F.struct("_m", "_c"))
    old = todo.where("origin <> 'todo'").join(done, "done_row").select("id", "origin", F.col("answer").alias("prediction"), F.col("_m").alias("method"), F.col("_c").alias("completion"))
    new = todo.where("origin = 'todo'")
    solved = solvers.solved(new, ["id"]).where("correct")
    rest = new.join(solved.select("id"), "id", "left_anti").where(solvers.family(F.col("prompt")) == "symbolic_equation")
    rest = solvers.gold_searched(rest, ["id"]).where("prediction is not null")
    first = solved.select("id", F.lit("solved").alias("origin"), "prediction", "method", solvers.trace_text(F.col("family"), F.col("prediction")).alias("completion"))
    second = rest.select("id", F.lit("gold").alias("origin"), "prediction", F.lit("cryptarithm_gold").alias("method"), solvers.trace_text(F.lit("symbolic_equation"), F.col("prediction")).alias("completion"))
    return old.unionByName(first).unionByName(second)


def notebook_index(spark: SparkSession, root: str, out_json: str, out_csv: str) -> DataFrame:
    """Index of the folders below ``root``, with its corpus summary written beside it."""
    entries = cut(notebooks.index(readers.files(spark, root), root))
    summary = {f"{r.what}:{r['name']}": r.n for r in notebooks.corpus(entries).collect()}
    sinks.write_json(out_json, summary)
    sinks.write_csv(entries, out_csv, entries.columns)
    return entries


def audit_adapters(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """Comparison of two tensor tables by category."""
    return tensors.compare(reference, candidate, tensors.category(F.col("key")))


def merged_adapters(table: DataFrame, weights: dict[str, float], alphas: dict[str, float], anchor: str, rank: int, alpha: float, policy: str = "strict") -> DataFrame:
    """(key, shape, data) of a merge: summed modules, and those the policy copies from the anchor."""
    planned = cut(merges.plan(table, anchor, policy))
    bad = planned.where("action = 'error'").limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0].module}: incompatible adapters {list(bad[0].offenders)}")
    summed = merges.merge(table, weights, planned, alphas, rank, alpha)
    keys = planned.where("action = 'anchor_copy'").select(F.explode(F.array("a_key", "b_key")).alias("key"))
    copied = table.where(F.col("adapter") == anchor).join(keys, "key", "left_semi").select("key", "shape", "data")
    return summed.unionByName(copied)


def sanitize(df: DataFrame, row: str, path: str) -> None:
    """A table without its sensitive columns and texts, as CSV."""
    d = harvest.redacted(df, row)
    sinks.write_csv(d, path, d.columns)
