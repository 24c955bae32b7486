"""Incremental ingest of trace files: the streaming form of scanning and resuming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from corpusmill.sources.readers import TRACE_FIELDS

TRACE_SCHEMA = ", ".join(f"{f} string" for f in TRACE_FIELDS)


def new_traces(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """A stream of the trace rows of JSON lines files as they arrive."""
    return spark.readStream.schema(TRACE_SCHEMA).option("maxFilesPerTrigger", files_per_batch).json(path)


def append_new(stream: DataFrame, out: str, checkpoint: str, keys: tuple[str, ...] = ("id", "source", "method")) -> StreamingQuery:
    """Appends the rows whose key hasn't come yet; null keys count as equal.

    The keys that have come are the state of the query, partitioned by key and kept in the checkpoint: a batch meets the
    state of its own keys, not the rows of earlier batches.  Name a RocksDB state store in the session for histories that
    outgrow memory.  A batch writes to a folder of its own number, so one that is run again after a failure overwrites its
    own rows and nothing else.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.dropDuplicates(list(keys)).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
