"""Top N rows of every group by mergeable bounded heaps (problem 4).

Each task keeps one heap of N keys per group and sends those instead of its rows;
after the shuffle the heaps of a group are merged by the same code.  A group of
any size thus moves N keys per task and is never gathered.

Order: score descending, tie-break value descending with null and NaN last, then
the smaller identifier.  Only finite scores count.  An identifier counts once per
group, by its best row, so redelivered rows don't fill a heap.  Groups with fewer rows give all.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: a task hands on its heaps when it holds this many groups; heaps of one group may meet later
MAX_GROUPS = 200_000


def group_name(col: Column, missing: str = "unknown") -> Column:
    """Lower case without surrounding white space (tabs, no-break and zero-width spaces too); null and empty as ``missing``."""
    s = F.lower(F.regexp_replace(col, r"(?U)^[\s\x{200b}\x{feff}]+|[\s\x{200b}\x{feff}]+$", ""))
    return F.when(s != "", s).otherwise(F.lit(missing)) if missing else s


def _keep(groups, score, tie, ident, n: int):
    """Indexes of the first ``n`` distinct identifiers of every group in order; arrays of one batch."""
    codes = groups.dictionary_encode()
    g = codes.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    order = np.lexsort((ident, -tie, -score, g))
    gs, ids = g[order], ident[order]
    # of an identifier that comes again in its group, with whatever score, the first place counts
    by_id = np.lexsort((np.arange(len(order)), ids, gs))
    again = np.zeros(len(order), bool)
    again[by_id[1:]] = (gs[by_id[1:]] == gs[by_id[:-1]]) & (ids[by_id[1:]] == ids[by_id[:-1]])
    order, gs = order[~again], gs[~again]
    first = np.r_[True, gs[1:] != gs[:-1]] if len(gs) else np.zeros(0, bool)
    starts = np.flatnonzero(first)
    rank = np.arange(len(gs)) - np.repeat(starts, np.diff(np.r_[starts, len(gs)]))
    return order[rank < n]


def _heaps(n: int, flush: bool):
    """Arrow batches (g, score, tie, ident) to the bounded heaps of their groups."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        rows = settled = 0

        def merged() -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            s, k, i = (t.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            return t.take(pa.array(np.sort(_keep(t.column(0), s, k, i, n))))

        for b in batches:
            if not b.num_rows:
                continue
            held.append(b)
            rows += b.num_rows
            if rows > 2 * settled + 50_000:
                held = [merged()]
                rows = settled = held[0].num_rows
                if flush and settled > n * MAX_GROUPS:
                    yield held[0]
                    held, rows, settled = [], 0, 0
        if held:
            yield merged()

    return run


_SHAPE = "g string, score double, tie double, ident bigint"


def top_n(df: DataFrame, group: Column, score: str, ident: str, n: int = 3, tie: str | None = None) -> DataFrame:
    """(g, score, tie, ident, place) of the ``n`` best rows of every group.

    ``group`` is an expression; ``score`` and ``tie`` are double columns, ``ident`` a
    bigint one.  ``tie`` comes back as -Infinity where it is null or NaN.  Rows with a
    null identifier or a score that isn't finite don't count.
    """
    value = F.col(score)
    worst = F.lit(-math.inf)
    second = F.when(F.col(tie).isNull() | F.isnan(tie), worst).otherwise(F.col(tie)) if tie else worst
    # adding 0.0 makes -0.0 a plain zero, so that equal scores are equal in every order
    keys = df.where(F.abs(value) < F.lit(math.inf)).where(F.col(ident).isNotNull()).select(
        group.alias("g"), (value + F.lit(0.0)).alias("score"), (second + F.lit(0.0)).alias("tie"), F.col(ident).cast("bigint").alias("ident")
    )
    heaps = keys.mapInArrow(_heaps(n, True), _SHAPE)
    # one task's groups arrive sorted, so that the merge holds few of them at a time
    merged = heaps.repartition("g").sortWithinPartitions("g").mapInArrow(_sorted_heaps(n), _SHAPE + ", place int")
    return merged


def _sorted_heaps(n: int):
    """The merge after the shuffle: groups are contiguous, so all but the last group of a batch are complete."""

    def run(batches):
        rest: pa.RecordBatch | None = None

        def settle(t: pa.RecordBatch) -> pa.RecordBatch:
            s, k, i = (t.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            t = t.take(pa.array(_keep(t.column(0), s, k, i, n)))
            g = t.column(0).dictionary_encode().indices.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, int)
            place = np.arange(len(g)) - np.repeat(starts, np.diff(np.r_[starts, len(g)])) + 1
            return pa.RecordBatch.from_arrays([*t.columns, pa.array(place.astype(np.int32))], names=[*t.schema.names, "place"])

        for b in batches:
            if not b.num_rows:
                continue
            if rest is not None:
                b = pa.Table.from_batches([rest, b]).combine_chunks().to_batches()[0]
            g = b.column(0)
            last = g[b.num_rows - 1]
            at = int(np.flatnonzero(pa.compute.equal(g, last).to_numpy(zero_copy_only=False))[0])
            if at:
                yield settle(b.slice(0, at))
            rest = b.slice(at)
            if rest.num_rows > 50_000:  # a group met by very many tasks
                t = rest
                s, k, i = (t.column(c).to_numpy(zero_copy_only=False) for c in (1, 2, 3))
                rest = t.take(pa.array(_keep(t.column(0), s, k, i, n)))
        if rest is not None:
            yield settle(rest)

    return run
