"""Readers of trace files: explicit schemas, no inference, and a file position for every row."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.text import first_filled, flat_boxes, join_flags, split_flags, text_of

TRACE_FIELDS = ("id", "source", "task_type", "prompt", "answer", "completion", "method", "quality_flags")


def csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file with a header and quoted line breaks; every column is text, so ``0101`` keeps its zero."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.options(header=True, multiLine=True, escape='"', enforceSchema=False).schema(schema).csv(path)


def csv_columns(spark: SparkSession, path: str) -> list[str]:
    """Names in the header of a CSV file."""
    return spark.read.options(header=True, multiLine=True, escape='"').csv(path).columns


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, row_index, value) of text files; the index counts from 1 in each file, blank lines too.

    A file is one row until it is unfolded, so use it for files that fit a task.
    """
    whole = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    body = F.regexp_replace("value", r"\r?\n\z", "")
    return whole.select("path", F.posexplode(F.split(body, r"\r?\n")).alias("p", "value")).select("path", (F.col("p") + 1).cast("bigint").alias("row_index"), "value")


def lines_throughout(spark: SparkSession, path: str) -> DataFrame:
    """(row_index, value) of the lines of a text file or of the files of a folder in the order of their names; the index counts on from file to file.

    Lines are read in splits and none is gathered: what is broadcast has one row for each split.
    """
    at = [F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_id")]
    d = spark.read.text(path, lineSep="\n").select(*at, F.when(F.col("value").endswith("\r"), F.expr("left(value, length(value) - 1)")).otherwise(F.col("value")).alias("value"))
    splits = d.groupBy("_path", "_start").agg(F.min("_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_path", "_start")) - F.col("_n")
    splits = splits.select("_path", "_start", "_first", before.alias("_before"))
    return d.join(F.broadcast(splits), ["_path", "_start"]).select((F.col("_before") + F.col("_id") - F.col("_first") + 1).alias("row_index"), "value")


def jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False, throughout: bool = False) -> DataFrame:
    """Rows of JSON lines with their ``row_index``, counted in each file or ``throughout``; blank lines and, unless ``strict``, bad rows are left out."""
    d = (lines_throughout if throughout else lines)(spark, path).where(F.trim("value") != "")
    # behind a generator, or each filter on a field would parse the line again
    parsed = d.select("row_index", F.explode(F.array(F.from_json("value", schema, {"mode": "FAILFAST" if strict else "PERMISSIVE"}))).alias("_j"))
    return parsed.where(F.col("_j").isNotNull()).select("row_index", "_j.*")


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One JSON document a file."""
    r = spark.read.option("multiLine", True)
    return (r.schema(schema) if schema else r).json(path)


def text_folder(spark: SparkSession, path: str, train: DataFrame, source: str) -> DataFrame:
    """Trace rows of a folder of ``<id>.txt`` files; prompt and answer come from train, flagged when missing."""
    files = spark.read.text(path, wholetext=True, pathGlobFilter="*.txt").select(
        F.regexp_replace(F.col("_metadata.file_name"), r"\.txt$", "").alias("id"), F.col("value").alias("completion")
    )
    t = train.groupBy("id").agg(F.max(F.struct("prompt", "answer")).alias("t"))
    d = files.join(t, "id", "left").select("id", "completion", text_of(F.col("t.prompt")).alias("prompt"), text_of(F.col("t.answer")).alias("answer"))
    flags = join_flags(F.when(F.col("prompt") == "", "prompt_missing"), F.when(F.col("answer") == "", "answer_missing"))
    return d.select("id", F.lit(source).alias("source"), F.lit("").alias("task_type"), "prompt", "answer", "completion", F.lit("txt").alias("method"), flags.alias("quality_flags"))


def _have(df: DataFrame, *names: str) -> Column:
    return first_filled(*[F.col(f"`{n}`") for n in names if n in df.columns], F.lit(None).cast("string"))


def oracle_traces(rows: DataFrame, source: str) -> DataFrame:
    """Trace rows of JSON lines with an optional flag string; stored flags follow new ones, each once."""
    box = F.when(F.size(flat_boxes(F.col("completion"))) > 1, "multiple_boxed")
    flags = F.array_distinct(F.concat(F.array_compact(F.array(box)), split_flags(_have(rows, "quality_flags"))))
    return rows.select(
        "id", F.coalesce(_have(rows, "source"), F.lit(source)).alias("source"), text_of(_have(rows, "task_type")).alias("task_type"), "prompt", "answer", "completion",
        text_of(_have(rows, "method")).alias("method"), F.array_join(flags, ";").alias("quality_flags"),
    )


def generic_traces(rows: DataFrame, source: str, index: str = "row_index") -> DataFrame:
    """Trace rows of a table in any of the known spellings of its columns; a missing id is ``row_`` and the index."""
    completion = _have(rows, "completion", "generated_cot", "cot_trace", "assistant_content")
    return rows.select(
        F.coalesce(_have(rows, "id"), F.concat(F.lit("row_"), F.lpad(F.col(index).cast("string"), 6, "0"))).alias("id"),
        F.lit(source).alias("source"),
        text_of(_have(rows, "task_type", "task", "type", "category")).alias("task_type"),
        text_of(_have(rows, "prompt", "user_content")).alias("prompt"),
        F.coalesce(_have(rows, "answer"), F.try_element_at(flat_boxes(completion), F.lit(-1)), F.lit("")).alias("answer"),
        text_of(completion).alias("completion"),
        text_of(_have(rows, "method")).alias("method"),
        text_of(_have(rows, "quality_flags")).alias("quality_flags"),
    )


def pretokenized(rows: DataFrame, labels: DataFrame | None, source: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """Records of input_ids and labels by line; rows of unequal arrays are dropped, ignored labels get mask 0, names come by line.

    ``keep`` are columns made of ``input_ids`` and ``loss_mask`` in their place, so that the arrays don't travel to the names.
    """
    d = rows.where("input_ids is not null and labels is not null and size(input_ids) = size(labels)")
    d = d.withColumn("loss_mask", F.transform("labels", lambda x: (x != -100).cast("int")))
    keep = keep or {c: F.col(c) for c in ("input_ids", "loss_mask")}
    d = d.select("row_index", *[c.alias(n) for n, c in keep.items()])
    if labels is not None:
        d = d.join(labels.select("row_index", F.col("id").alias("_id"), F.col("answer").alias("_a")), "row_index", "left")
    else:
        d = d.withColumns({"_id": F.lit(None).cast("string"), "_a": F.lit(None).cast("string")})
    flags = join_flags(F.lit("pretokenized"), F.when(text_of(F.col("_a")) == "", "empty_answer"))
    name = F.coalesce("_id", F.concat(F.lit("row_"), F.lpad(F.col("row_index").cast("string"), 6, "0")))
    return d.select(name.alias("id"), F.lit(source).alias("source"), text_of(F.col("_a")).alias("answer"), flags.alias("quality_flags"), *keep)


def id_list(spark: SparkSession, path: str) -> DataFrame:
    """(id) of files of ids: the part before the first comma, comments and blanks left out."""
    ids = spark.read.text(path).select(F.trim(F.split_part("value", F.lit(","), F.lit(1))).alias("id"))
    return ids.where((F.col("id") != "") & ~F.col("id").startswith("#")).distinct()


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, modified, content) of all files below a folder; Spark lists no empty ones."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    r = r.option("pathGlobFilter", glob) if glob else r
    return r.load(path).select("path", "length", F.col("modificationTime").alias("modified"), "content")


def utf8(content: Column) -> Column:
    """Bytes as text, bad ones replaced."""
    return F.make_valid_utf8(content.cast("string"))


def kind_of(path: str) -> str:
    """Kind of a source by its name: txt_dir, nemo_jsonl, oracle_jsonl, formatted_csv or generic_csv."""
    name = os.path.basename(path.rstrip("/")).lower()
    if os.path.isdir(path):
        return "txt_dir"
    if name.endswith(".jsonl"):
        return "nemo_jsonl" if name.startswith("nemo_") else "oracle_jsonl"
    if name.endswith(".csv"):
        return "formatted_csv" if "formatted_train_dataset" in name else "generic_csv"
    raise ValueError(f"can't tell what kind of source {path} is")


def source_spec(text: str) -> dict[str, str | int]:
    """``name:kind:path:target`` as a row."""
    m = re.fullmatch(r"([^:]+):([^:]+):(.+):(\d+)", text) or re.fullmatch(r"([^:]+):([^:]+):(.+)()", text)
    if not m:
        raise ValueError(f"{text!r} isn't name:kind:path:target")
    return {"name": m[1], "kind": m[2], "path": m[3], "target": int(m[4] or 0)}
