"""Source specs, probes and the registry of source kinds."""

from __future__ import annotations

import os
import zipfile
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusmill.functions.text import final_box, text_of
from corpusmill.sources import readers

JSON_TRACE = ", ".join(f"{f} string" for f in (*readers.TRACE_FIELDS, "prediction"))
JSON_TOKENS = "input_ids array<int>, labels array<int>"


def _oracle(spark: SparkSession, path: str, name: str, train: DataFrame) -> DataFrame:
    return readers.oracle_traces(readers.jsonl(spark, path, JSON_TRACE), name)


def _with_index(d: DataFrame) -> DataFrame:
    """File order of one CSV file, which is one part because its records span lines."""
    return d.withColumn("row_index", F.monotonically_increasing_id())


def _csv(spark: SparkSession, path: str, name: str, train: DataFrame) -> DataFrame:
    d = readers.csv(spark, path, readers.csv_columns(spark, path))
    return readers.generic_traces(_with_index(d), name)


def _formatted(spark: SparkSession, path: str, name: str, train: DataFrame) -> DataFrame:
    d = _with_index(readers.csv(spark, path, ["user_content", "assistant_content"]))
    prompt = F.regexp_replace(text_of(F.col("user_content")), r"\s*(?:Put|Please put) your final answer inside .{0,20}boxed.*\z", "")
    d = d.select("row_index", prompt.alias("prompt"), final_box(F.col("assistant_content")).alias("answer"), text_of(F.col("assistant_content")).alias("completion"), F.lit("formatted").alias("method"))
    return readers.generic_traces(d, name)


def _folder(spark: SparkSession, path: str, name: str, train: DataFrame) -> DataFrame:
    return readers.text_folder(spark, path, train, name)


#: readers by kind; a reader gets session, path, name and train and gives the eight trace fields
KINDS: dict[str, Callable[[SparkSession, str, str, DataFrame], DataFrame]] = {
    "oracle_jsonl": _oracle,
    "generic_csv": _csv,
    "formatted_csv": _formatted,
    "txt_dir": _folder,
}


def load(spark: SparkSession, specs: list[dict], train: DataFrame) -> tuple[DataFrame, list[dict]]:
    """Union of the traces of all specs, and each spec with ``exists``; a missing path is noted, an unknown kind is an error."""
    noted, frames = [], []
    for s in specs:
        if s["kind"] not in KINDS:
            raise ValueError(f"unknown kind of source: {s['kind']}")
        there = os.path.exists(str(s["path"]))
        noted.append({**s, "exists": there})
        if there:
            frames.append(KINDS[s["kind"]](spark, str(s["path"]), str(s["name"]), train))
    if not frames:
        return spark.createDataFrame([], ", ".join(f"{f} string" for f in readers.TRACE_FIELDS)), noted
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out, noted


def load_tokens(spark: SparkSession, path: str, labels: str | None, name: str, keep: dict[str, Column] | None = None) -> DataFrame:
    """Pre-tokenised records of JSON lines with their names by line; each path is a file or a folder of parts, whose lines count on by file name."""
    named = readers.jsonl(spark, labels, "id string, answer string", throughout=True) if labels else None
    return readers.pretokenized(readers.jsonl(spark, path, JSON_TOKENS, throughout=True), named, name, keep)


def discover(files: DataFrame, most: int = 4) -> DataFrame:
    """At most ``most`` source files of each dataset by size and name: (dataset, kind, path, label), each kind and path once.

    ``files`` has dataset, path, length.  The limit is the feature: a probe of what is there.
    """
    low = F.lower(F.element_at(F.split("path", "/"), -1))
    kind = (
        F.when(low.startswith("nemo_") & low.endswith(".jsonl"), "nemo_jsonl").when(low.endswith(".jsonl"), "oracle_jsonl")
        .when(low.contains("formatted_train_dataset"), "formatted_csv").when(low.endswith(".csv"), "generic_csv")
    )
    d = files.withColumn("kind", kind).where("kind is not null").dropDuplicates(["kind", "path"])
    d = d.withColumn("place", F.row_number().over(W.partitionBy("dataset").orderBy(F.desc("length"), "path"))).where(F.col("place") <= most)
    label = F.concat_ws("_", "dataset", F.when(F.col("place") > 1, F.col("place").cast("string")))
    return d.select("dataset", "kind", "path", label.alias("label"))


def best_text_folder(files: DataFrame) -> DataFrame:
    """(folder, n) of the folder with the most ``.txt`` files; then the deepest, then the last by name."""
    d = files.where(F.lower("path").endswith(".txt")).select(F.regexp_replace("path", "/[^/]*$", "").alias("folder"))
    d = d.groupBy("folder").agg(F.count(F.lit(1)).alias("n"))
    return d.orderBy(F.desc("n"), F.desc(F.size(F.split("folder", "/"))), F.desc("folder")).limit(1)


def replay_order(order: DataFrame, corpus: DataFrame, key: str = "problem_id", epoch: int = 0) -> DataFrame:
    """Rows of the corpus at the first place their key has in an epoch of a recorded order (key, epoch, pos); sorted by place."""
    first = order.where((F.col("epoch") == epoch) & F.col(key).isNotNull()).groupBy(key).agg(F.min("pos").alias("pos"))
    return corpus.join(first, key).orderBy("pos")


def adapter_folder(path: str, unpack: str | None = None) -> str:
    """Folder of an adapter given as a folder, a file in it or a zip, whose members are matched by their base names.

    A zip is unpacked to ``unpack``, which all executors must see; beside the zip if none is given.
    """
    if os.path.isdir(path):
        return path
    if path.endswith(".zip"):
        out = unpack or path.removesuffix(".zip")
        os.makedirs(out, exist_ok=True)
        with zipfile.ZipFile(path) as z:
            for n in z.namelist():
                if os.path.basename(n) in ("adapter_config.json", "adapter_model.safetensors"):
                    with z.open(n) as src, open(os.path.join(out, os.path.basename(n)), "wb") as dst:
                        dst.write(src.read())
        if not os.path.exists(os.path.join(out, "adapter_config.json")):
            raise FileNotFoundError(f"{path} holds no adapter")
        return out
    if os.path.isfile(path):
        return os.path.dirname(path)
    raise FileNotFoundError(path)


def pick_archive(paths: list[str], name: str) -> str:
    """The zip whose name holds ``name``, else any; the shortest path first."""
    zips = [p for p in paths if p.endswith(".zip")]
    if not zips:
        raise FileNotFoundError("no archive")
    return min(zips, key=lambda p: (name not in os.path.basename(p), len(p), p))


def checked_config(config: dict, most_rank: int = 32, base_model: str | None = None) -> dict:
    """An adapter configuration that is of the right kind, rank and base model; an error otherwise."""
    if str(config.get("peft_type", "")).upper() != "LORA":
        raise ValueError("not a low-rank adapter")
    if int(config.get("r", 0)) > most_rank:
        raise ValueError(f"rank {config['r']} is above {most_rank}")
    if base_model and base_model not in str(config.get("base_model_name_or_path", "")):
        raise ValueError("another base model")
    return config
