"""Spark operators for defective pairs (problem 2) and cut records (problem 5)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.encode import END_ID, RANKS, codec, source_name
from corpusmill.llm.pairs import defects, is_copy, is_empty
from corpusmill.llm.refusals import declines
from corpusmill.llm.textends import BLANKS, Frames, ending, frame, remark
from corpusmill.session import cut, spread

#: share of a source's finished records that state an answer, from which one without is taken as cut
STATED_SHARE, PRIOR_RECORDS = 0.9, 5.0
#: a closing frame is learned from this many sentences, and from this share of the traces at least: so there are at most 1 / FRAME_SHARE frames
FRAME_COUNT, FRAME_SHARE = 3, 0.0005


def closing_frames(traces: DataFrame) -> Frames:
    """The frames in which the traces state their answers: counted by grouped aggregation; at most ``1 / FRAME_SHARE`` reach the driver."""

    def run(batches):
        for b in batches:
            found = [f for c, a in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) if (f := frame(c, a))]
            cols = list(zip(*found, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.bool_()), strict=True)], names=["lead", "tail", "stop"])

    rows = spread(traces.select("completion", "answer")).mapInArrow(run, "lead string, tail string, stop boolean")
    counted = rows.groupBy("lead", "tail").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("stop").cast("bigint")).alias("stopped"))
    total = traces.count()
    kept = counted.where(F.col("n") >= F.lit(max(FRAME_COUNT, FRAME_SHARE * total))).orderBy("lead", "tail")
    return Frames((r.lead, r.tail, r.n, r.stopped) for r in kept.collect())


def defective_pairs(traces: DataFrame) -> DataFrame:
    """(trace_id, defect), one row for each defect of a trace.

    One pass for the closing frames of the corpus and one for the defects; a prompt's suffix automaton is built only when enough of the
    response's words occur in it.  Null and blank completions are ``empty_answer``; without a
    prompt there is neither a copy nor a wrong language; repeated rows are judged each for itself.
    """

    frames = closing_frames(traces)

    def run(batches):
        for b in batches:
            ids, out = [], []
            for i, p, c, a in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
                for d in defects(p, c, a, frames):
                    ids.append(i)
                    out.append(d)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(out, pa.string())], names=["trace_id", "defect"])

    return spread(traces.select("trace_id", "prompt", "completion", "answer")).mapInArrow(run, "trace_id bigint, defect string")


def trace_state(prompt: str | None, completion: str | None, answer: str | None, frames: Frames) -> str:
    """How a trace ends; ``copied`` and ``declined`` texts are whole in their own way."""
    if is_empty(completion, answer):
        return "empty"
    state = ending(completion, answer, frames)
    if state in ("closed", "remark"):
        return "closed" if state == "closed" else "broken"
    if is_copy(prompt, completion):
        return "copied"
    return "declined" if state in ("terminated", "bare") and declines(completion or "") else state


def record_state(raw: bytes, frames: Frames) -> tuple[str, str | None]:
    """How the text of a tokenised record ends; bytes that break off inside a character are a break.  A remark behind the box comes with it."""
    try:
        text = raw.decode()
    except UnicodeDecodeError as e:
        if e.end >= len(raw) and e.reason.startswith("unexpected end"):
            return "broken", None
        text = raw.decode(errors="replace")
    if not text.strip(BLANKS):
        return "empty", None
    if text.startswith("Question:"):
        # the label between question and answer is no answer line; a text that never reaches it is judged whole
        text = text.partition("\n\nAnswer:")[2] or text[len("Question:") :]
        if not text.strip(BLANKS):
            return "broken", None
    state = ending(text, None, frames)
    return state, remark(text) if state == "remark" else None


_STATES = "rec_table string, rec_key bigint, source string, n bigint, state string, remark string"


def _trace_states(traces: DataFrame, frames: Frames) -> DataFrame:
    def run(batches):
        for b in batches:
            key, source, p, c, a = (b.column(k) for k in range(5))
            c = c.to_pylist()
            states = [trace_state(*x, frames) for x in zip(p.to_pylist(), c, a.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(["traces"] * len(c), pa.string()), key, source, pa.array([len(x or "") for x in c], pa.int64()), pa.array(states, pa.string()), pa.nulls(len(c), pa.string())],
                names=["rec_table", "rec_key", "source", "n", "state", "remark"],
            )

    return spread(traces.select("trace_id", source_name(F.col("source")).alias("source"), "prompt", "completion", "answer")).mapInArrow(run, _STATES)


def _record_states(records: DataFrame, path: str, frames: Frames) -> DataFrame:
    def run(batches):
        c = codec(path)
        for b in batches:
            key, source, lists = b.column(0), b.column(1), b.column(2)
            # one array for the batch and a short list for one record at a time
            flat = lists.values.fill_null(-1).to_numpy(zero_copy_only=False)
            at = lists.offsets.to_numpy()
            states, sizes = [], []
            for i in range(b.num_rows):
                x = flat[at[i] : at[i + 1]] if lists[i].is_valid else flat[:0]
                own = np.flatnonzero((x != END_ID) & (x >= 0))  # padding aside
                sizes.append(len(x))
                states.append(record_state(c.decode_bytes(x[: own[-1] + 1].tolist()), frames) if len(own) else ("empty", None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(["tokenized_records"] * b.num_rows, pa.string()), key, source, pa.array(sizes, pa.int64()), pa.array([x for x, _ in states], pa.string()), pa.array([x for _, x in states], pa.string())],
                names=["rec_table", "rec_key", "source", "n", "state", "remark"],
            )

    return spread(records.select("rec_id", source_name(F.col("source")).alias("source"), "input_ids")).mapInArrow(run, _STATES)


def record_states(traces: DataFrame, records: DataFrame, path: str = RANKS) -> DataFrame:
    """(rec_table, rec_key, source, n, state, cut) of every record of both tables.

    ``n`` is the length in characters or ids.  A record is cut when its text is broken, or when it
    ends without an answer though its source nearly always states one; a source's share is smoothed
    towards its table's.  Null texts and empty arrays are not cut.
    """
    frames = closing_frames(traces)
    states = cut(_trace_states(traces, frames).unionByName(_record_states(records, path, frames)))
    # a remark that many records repeat behind their box ends them; what a cut leaves of one is repeated by few
    remarks = states.where(F.col("state") == "remark").groupBy("remark").agg(F.count(F.lit(1)).alias("n"))
    total = states.where(F.col("state") == "remark").count()
    known = remarks.where(F.col("n") >= F.lit(max(FRAME_COUNT, Frames.SHARE * total))).select("remark", F.lit("closed").alias("_as"))
    states = states.join(known, "remark", "left").withColumn("state", F.when(F.col("state") == "remark", F.coalesce("_as", F.lit("broken"))).otherwise(F.col("state"))).drop("_as", "remark")
    whole = states.where(F.col("state").isin("closed", "terminated", "bare"))
    by = whole.groupBy("rec_table", "source").agg(F.sum((F.col("state") == "closed").cast("bigint")).alias("stated"), F.count(F.lit(1)).alias("whole"))
    total = by.groupBy("rec_table").agg((F.sum("stated") / F.sum("whole")).alias("share"))
    base = by.join(total, "rec_table").select(
        F.col("rec_table").alias("_t"),
        F.coalesce("source", F.lit("")).alias("_s"),
        ((F.col("stated") + PRIOR_RECORDS * F.col("share")) / (F.col("whole") + PRIOR_RECORDS)).alias("_p"),
    )
    s = states.join(base, (F.col("rec_table") == F.col("_t")) & (F.coalesce("source", F.lit("")) == F.col("_s")), "left")
    return s.withColumn(
        "cut", (F.col("state") == "broken") | (F.col("state").isin("terminated", "bare") & (F.coalesce("_p", F.lit(0.0)) >= STATED_SHARE))
    ).drop("_t", "_s", "_p")


def cut_records(traces: DataFrame, records: DataFrame, path: str = RANKS) -> DataFrame:
    """(rec_table, rec_key) of the cut records."""
    return record_states(traces, records, path).where("cut").select("rec_table", "rec_key")


def cut_rates(traces: DataFrame, records: DataFrame, path: str = RANKS) -> DataFrame:
    """For each table and source: records, cut ones, their share, and the length at which most cuts fall with its count."""
    s = record_states(traces, records, path)
    by = s.groupBy("rec_table", "source", "n").agg(F.count(F.lit(1)).alias("c"), F.sum(F.col("cut").cast("bigint")).alias("k"))
    return by.groupBy("rec_table", "source").agg(
        F.sum("c").alias("n_records"),
        F.sum("k").alias("n_cut"),
        F.round(F.sum("k") / F.sum("c"), 6).alias("cut_share"),
        F.max_by("n", F.struct(F.col("k"), -F.col("n"))).alias("limit_length"),
        F.max("k").alias("n_at_limit"),
    )
