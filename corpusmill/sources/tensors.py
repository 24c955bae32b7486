"""Spark data source of tensor files: an 8-byte length, a JSON header, raw values.

``spark.dataSource.register(TensorSource)`` and ``spark.read.format("tensors").load(path)``
give (file, key, shape, dtype, data).  With the option ``headers`` only the headers are
read and ``data`` is null.  One task reads one tensor.
"""

from __future__ import annotations

import glob
import json
import os
import struct
from collections.abc import Iterator

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "file string, key string, shape array<int>, dtype string, data array<float>"
_DTYPES = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "i1", "U8": "u1", "BOOL": "?"}


class TensorPart(InputPartition):
    def __init__(self, path: str, key: str, shape: list[int], dtype: str, start: int, stop: int):
        self.path, self.key, self.shape, self.dtype, self.start, self.stop = path, key, shape, dtype, start, stop


def header(path: str) -> list[TensorPart]:
    """The tensors of a file, without their values."""
    with open(path, "rb") as f:
        (n,) = struct.unpack("<Q", f.read(8))
        meta = json.loads(f.read(n))
    base = 8 + n
    return [TensorPart(path, k, v["shape"], v["dtype"], base + v["data_offsets"][0], base + v["data_offsets"][1]) for k, v in meta.items() if k != "__metadata__"]


def values(p: TensorPart) -> np.ndarray:
    """Values of a tensor as float32; bfloat16 is the upper half of a float32."""
    with open(p.path, "rb") as f:
        f.seek(p.start)
        raw = f.read(p.stop - p.start)
    if p.dtype == "BF16":
        return (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
    return np.frombuffer(raw, _DTYPES[p.dtype]).astype(np.float32)


class TensorReader(DataSourceReader):
    def __init__(self, path: str, headers: bool):
        self.path, self.headers = path, headers

    def partitions(self) -> list[TensorPart]:
        files = sorted(glob.glob(os.path.join(self.path, "*.safetensors"))) if os.path.isdir(self.path) else [self.path]
        return [p for f in files for p in header(f)]

    def read(self, p: TensorPart) -> Iterator[tuple]:
        data = None if self.headers else values(p).tolist()
        yield (os.path.basename(p.path), p.key, [int(x) for x in p.shape], p.dtype, data)


class TensorSource(DataSource):
    """Format ``tensors``."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TensorReader:
        return TensorReader(self.options["path"], self.options.get("headers", "false").lower() == "true")


def write(path: str, tensors: dict[str, np.ndarray]) -> None:
    """A tensor file of float32 arrays."""
    at, meta, blobs = 0, {}, []
    for k in sorted(tensors):
        raw = np.ascontiguousarray(tensors[k], "<f4").tobytes()
        meta[k] = {"dtype": "F32", "shape": list(tensors[k].shape), "data_offsets": [at, at + len(raw)]}
        at += len(raw)
        blobs.append(raw)
    head = json.dumps(meta, separators=(",", ":")).encode()
    with open(path, "wb") as f:
        f.write(struct.pack("<Q", len(head)) + head + b"".join(blobs))
