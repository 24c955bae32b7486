"""Index of notebook folders: files, metadata, cells, references and keywords of each folder."""

from __future__ import annotations

import json
from collections import Counter

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.operators.harvest import KEYWORDS, keyword_counts, urls
from corpusmill.sources.readers import utf8

SCALARS = ("id", "title", "code_file", "language", "kernel_type", "machine_shape", "docker_image")
SOURCES = ("dataset_sources", "model_sources", "kernel_sources", "competition_sources", "keywords")


def cell_text(source: object) -> str:
    """A cell's source as text, given as lines or as one string."""
    return "".join(map(str, source)) if isinstance(source, list) else source if isinstance(source, str) else ""


def describe(name: str, text: str | None) -> dict:
    """Scalars, source lists, cells and the parse error of one JSON file; other files have none."""
    out = {"scalars": {}, "sources": {}, "cells": {}, "chars": 0, "error": None}
    if not name.endswith((".json", ".ipynb")) or text is None:
        return out
    try:
        data = json.loads(text)
    except ValueError as e:
        return out | {"error": f"{name}: {e}"}
    if not isinstance(data, dict):
        return out
    if name.endswith(".json"):
        out["scalars"] = {k: str(data[k]) for k in SCALARS if data.get(k) not in (None, "")}
        out["sources"] = {k: _texts(data.get(k)) for k in SOURCES if _texts(data.get(k))}
        return out
    meta = data.get("metadata") if isinstance(data.get("metadata"), dict) else {}
    parts = {k: v for k in ("kaggle", "kernelspec", "language_info") if isinstance(v := meta.get(k), dict)}
    host, kernel, lang = (parts.get(k, {}) for k in ("kaggle", "kernelspec", "language_info"))
    found = {"language": host.get("language") or kernel.get("language") or lang.get("name"), "kernel_type": host.get("sourceType"), "machine_shape": host.get("accelerator")}
    out["scalars"] = {k: str(v) for k, v in found.items() if v}
    cells = data.get("cells") if isinstance(data.get("cells"), list) else []
    out["cells"] = dict(Counter(str(c.get("cell_type") or "unknown") if isinstance(c, dict) else "unknown" for c in cells))
    out["chars"] = sum(len(cell_text(c.get("source"))) for c in cells if isinstance(c, dict))
    return out


def _texts(v: object) -> list[str]:
    items = v if isinstance(v, list) else [] if v in (None, "") else [v]
    return [x.strip() if isinstance(x, str) else json.dumps(x, sort_keys=True) for x in items if x not in (None, "") and str(x).strip()]


def _first_filled(maps: Column, key: str, order: str) -> Column:
    """The value of ``key`` in the first map, by ``order``, that has it."""
    return F.min_by(F.try_element_at(maps, F.lit(key)), F.when(F.try_element_at(maps, F.lit(key)).isNotNull(), F.col(order)))


def index(files: DataFrame, root: str) -> DataFrame:
    """One row for each folder below ``root`` of rows with path, length and content (.py, .ipynb, .json)."""
    rel = F.regexp_replace(F.regexp_replace("path", r"^file:/*", "/"), f"^{root.rstrip('/')}/", "")
    d = files.where(F.lower("path").rlike(r"\.(py|ipynb|json)$")).select(rel.alias("rel"), "length", utf8(F.col("content")).alias("text"))
    d = d.withColumns({"folder": F.split_part("rel", F.lit("/"), F.lit(1)), "ext": F.lower(F.regexp_extract("rel", r"\.([A-Za-z]+)$", 1))})

    def run(batches):
        for b in batches:
            got = [describe(n.lower(), t) for n, t in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)]
            arrays = [
                pa.array([list(g["scalars"].items()) for g in got], pa.map_(pa.string(), pa.string())),
                pa.array([[(k, v) for k, v in g["sources"].items()] for g in got], pa.map_(pa.string(), pa.list_(pa.string()))),
                pa.array([list(g["cells"].items()) for g in got], pa.map_(pa.string(), pa.int64())),
                pa.array([g["chars"] for g in got], pa.int64()),
                pa.array([g["error"] for g in got], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(5)), *arrays], names=["rel", "length", "text", "folder", "ext", "scalars", "sources", "cells", "chars", "error"])

    shape = "rel string, length bigint, text string, folder string, ext string, scalars map<string,string>, sources map<string,array<string>>, cells map<string,bigint>, chars bigint, error string"
    f = d.select("rel", F.col("length").cast("bigint").alias("length"), "text", "folder", "ext").mapInArrow(run, shape)
    f = f.withColumns({"urls": urls(F.col("text")), "hits": keyword_counts(F.col("text"))}).drop("text")
    # texts have left; what is gathered for a folder are names, counts and references of its files
    kinds = [F.sum((F.col("ext") == e).cast("bigint")).alias(f"{e}_count") for e in ("py", "ipynb", "json")]
    words = [F.sum(F.coalesce(F.try_element_at("hits", F.lit(k)), F.lit(0))).alias(f"_k{i}") for i, k in enumerate(KEYWORDS)]
    lists = [F.array_distinct(F.flatten(F.collect_list(F.coalesce(F.try_element_at("sources", F.lit(s)), F.array().cast("array<string>"))))).alias(s) for s in SOURCES]
    e = f.groupBy("folder").agg(
        F.count(F.lit(1)).alias("file_count"), *kinds, F.sum("length").alias("total_bytes"), F.sum(F.aggregate(F.map_values("cells"), F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("cell_count"),
        F.sum("chars").alias("source_chars"), *[_first_filled(F.col("scalars"), s, "rel").alias("notebook_id" if s == "id" else s) for s in SCALARS], *lists,
        F.array_distinct(F.flatten(F.collect_list("urls"))).alias("http_urls"), F.array_compact(F.collect_list("error")).alias("parse_errors"), *words,
    )
    counts = F.map_filter(F.map_from_arrays(F.array(*[F.lit(k) for k in KEYWORDS]), F.array(*[F.col(f"_k{i}") for i in range(len(KEYWORDS))])), lambda _, n: n > 0)
    owner, slug = F.nullif(F.split_part("folder", F.lit("__"), F.lit(1)), F.col("folder")), F.nullif(F.split_part("folder", F.lit("__"), F.lit(2)), F.lit(""))
    return e.withColumns(
        {
            "notebook_id": F.coalesce("notebook_id", F.concat(owner, F.lit("/"), slug)),
            "title": F.coalesce("title", F.replace(slug, F.lit("-"), F.lit(" "))),
            "keyword_counts": counts,
            "parse_error_count": F.size("parse_errors"),
        }
    ).drop(*[f"_k{i}" for i in range(len(KEYWORDS))])


def corpus(entries: DataFrame) -> DataFrame:
    """(what, name, n): folders, files, folders by keyword, and the 20 commonest sources of each kind."""
    total = entries.agg(F.count(F.lit(1)).alias("folders"), F.sum("file_count").alias("files"), F.sum((F.col("parse_error_count") > 0).cast("bigint")).alias("with_errors"))
    rows = total.select(F.inline(F.array(*[F.struct(F.lit("total").alias("what"), F.lit(c).alias("name"), F.col(c).cast("bigint").alias("n")) for c in total.columns])))
    words = entries.select(F.explode(F.map_keys("keyword_counts")).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).select(F.lit("keyword").alias("what"), "name", "n")
    out = rows.unionByName(words)
    for s in ("dataset_sources", "model_sources"):
        top = entries.select(F.explode(s).alias("name")).groupBy("name").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "name").limit(20)
        out = out.unionByName(top.select(F.lit(s).alias("what"), "name", "n"))
    return out
