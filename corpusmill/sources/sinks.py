"""Sinks: canonical trace files, projected CSV, small reports."""

from __future__ import annotations

import json
import zipfile

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusmill.sources.readers import TRACE_FIELDS


def write_traces(df: DataFrame, path: str) -> None:
    """JSON lines of the eight trace fields in order."""
    df.select(*TRACE_FIELDS).write.mode("overwrite").json(path, ignoreNullFields=False)


def write_csv(df: DataFrame, path: str, fields: list[str]) -> None:
    """CSV of ``fields``; missing columns and nulls are blank, others are left out; lists are joined by `` | ``, maps are JSON."""
    out = []
    for f in fields:
        kind = df.schema[f].dataType if f in df.columns else None
        if kind is None:
            c = F.lit("")
        elif isinstance(kind, T.ArrayType):
            c = F.array_join(F.transform(f, lambda x: x.cast("string")), " | ")
        elif isinstance(kind, T.MapType | T.StructType):
            c = F.to_json(f)
        else:
            c = F.col(f).cast("string")
        out.append(F.coalesce(c, F.lit("")).alias(f))
    df.select(*out).write.mode("overwrite").options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)


def write_json(path: str, payload: object) -> None:
    """One pretty document of a small result."""
    with open(path, "w", encoding="utf-8") as f:
        json.dump(payload, f, indent=2, ensure_ascii=False, sort_keys=True)
        f.write("\n")


def markdown(df: DataFrame, limit: int = 1000) -> str:
    """A small aggregate as a table of Markdown; ``limit`` is the feature."""
    rows = df.limit(limit).collect()
    head = df.columns
    body = ["| " + " | ".join("" if r[c] is None else str(r[c]) for c in head) + " |" for r in rows]
    return "\n".join(["| " + " | ".join(head) + " |", "|" + "---|" * len(head), *body]) + "\n"


def write_zip(path: str, files: dict[str, str]) -> None:
    """A zip of the named files."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for name, src in sorted(files.items()):
            z.write(src, name)
