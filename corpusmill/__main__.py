"""Command line: ``python -m corpusmill COMMAND ...``, over Parquet, CSV and JSON lines."""

from __future__ import annotations

import argparse
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.operators import preferences
from corpusmill.plans import pipelines
from corpusmill.sources import readers, sinks
from corpusmill.sources.tensors import TensorSource


def _table(spark: SparkSession, path: str) -> DataFrame:
    if path.endswith(".csv"):
        return readers.csv(spark, path, readers.csv_columns(spark, path))
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corpusmill")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *args: str) -> argparse.ArgumentParser:
        c = sub.add_parser(name)
        for a in args:
            c.add_argument(a, required=True)
        return c

    command("profile", "--train", "--test", "--output")
    c = command("manifest", "--train", "--output", "--summary")
    c.add_argument("--source", action="append", required=True, help="name:kind:path:target")
    c.add_argument("--seed", type=int, default=20260606)
    c.add_argument("--include-disabled", action="store_true")
    c = command("hard-tail", "--audit", "--output", "--holdout", "--summary")
    c.add_argument("--manifest")
    c.add_argument("--row", default="row_index")
    c.add_argument("--score-field", default="min_logprob")
    c.add_argument("--max-rows", type=int, default=256)
    c.add_argument("--per-task", type=int, default=64)
    c.add_argument("--task-cap", action="append", default=[], help="task=COUNT")
    c.add_argument("--holdout-fraction", type=float, default=0.08)
    c.add_argument("--seed", type=int, default=20260606)
    c = command("pairs", "--positive", "--negative", "--output")
    c.add_argument("--min-margin", type=float, default=0.2)
    command("calibrate", "--pairs", "--output")
    command("solve", "--train", "--output")
    command("notebooks", "--root", "--output-json", "--output-csv")
    command("adapters", "--reference", "--candidate", "--output")
    c = command("sanitize", "--input", "--output")
    c.add_argument("--row", default="row_index")
    return p


def caps_of(items: list[str]) -> dict[str, int]:
    """``task=COUNT`` items as a map, the last of a task wins."""
    out = {}
    for x in items:
        task, sep, n = x.partition("=")
        if not sep:
            raise ValueError(f"{x!r} isn't task=COUNT")
        out[task.strip()] = int(n)
    return out


def main(argv: list[str] | None = None) -> None:
    a = _parser().parse_args(argv)
    spark = SparkSession.builder.appName("corpusmill").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if a.command == "profile":
        sinks.write_json(a.output, pipelines.profile(_table(spark, a.train), _table(spark, a.test)))
    elif a.command == "manifest":
        rows, summary = pipelines.manifest(spark, [readers.source_spec(s) for s in a.source], _table(spark, a.train), a.seed, a.include_disabled)
        sinks.write_traces(rows, a.output)
        sinks.write_json(a.summary, json.loads(json.dumps(summary, default=str)))
    elif a.command == "hard-tail":
        m = _table(spark, a.manifest) if a.manifest else None
        sel, held, summary = pipelines.hard_tail(_table(spark, a.audit), m, a.row, a.score_field, a.holdout_fraction, a.per_task, a.max_rows, a.seed, caps_of(a.task_cap))
        sel.write.mode("overwrite").json(a.output)
        held.write.mode("overwrite").json(a.holdout)
        sinks.write_json(a.summary, json.loads(json.dumps(summary | {"decision": pipelines.decide(sel)}, default=str)))
    elif a.command == "pairs":
        pos, neg = (_table(spark, p).withColumn("row", F.monotonically_increasing_id()) for p in (a.positive, a.negative))
        preferences.pairs(pos, neg, {}, a.min_margin).write.mode("overwrite").json(a.output)
    elif a.command == "calibrate":
        pipelines.calibrate(_table(spark, a.pairs)).write.mode("overwrite").json(a.output)
    elif a.command == "solve":
        pipelines.solvers.solved(_table(spark, a.train), ["id"]).write.mode("overwrite").json(a.output)
    elif a.command == "notebooks":
        pipelines.notebook_index(spark, a.root, a.output_json, a.output_csv)
    elif a.command == "adapters":
        spark.dataSource.register(TensorSource)
        ref, cand = (spark.read.format("tensors").load(p) for p in (a.reference, a.candidate))
        pipelines.audit_adapters(ref, cand).write.mode("overwrite").json(a.output)
    elif a.command == "sanitize":
        pipelines.sanitize(_table(spark, a.input), a.row, a.output)


if __name__ == "__main__":
    main()
