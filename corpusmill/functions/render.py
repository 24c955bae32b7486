"""Texts of conversations and training examples."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import text_of

# The request behind a prompt and the marks of a turn.
PROMPT_SUFFIX = "\nPut your final answer inside \\boxed{}."
TURN, END = "<|im_start|>", "<|im_end|>"


def turn(role: str, content: Column) -> Column:
    """One turn of a conversation with a line end behind it; null content is empty."""
    return F.concat(F.lit(f"{TURN}{role}\n"), text_of(content), F.lit(f"{END}\n"))


def conversation(messages: Column, open_turn: bool = False) -> Column:
    """Turns of an array of (role, content); a null role is the user's; ``open_turn`` starts the assistant's."""
    turns = F.transform(messages, lambda m: F.concat(F.lit(TURN), F.coalesce(m["role"], F.lit("user")), F.lit("\n"), text_of(m["content"]), F.lit(f"{END}\n")))
    return F.concat(F.array_join(turns, ""), F.lit(f"{TURN}assistant\n" if open_turn else ""))


def prompt_text(prompt: Column, suffix: str = PROMPT_SUFFIX) -> Column:
    """The user's turn and the start of the assistant's."""
    return F.concat(turn("user", F.concat(text_of(prompt), F.lit(suffix))), F.lit(f"{TURN}assistant\n"))


def training_text(prompt: Column, completion: Column, reasoning: Column, answer: Column, suffix: str = PROMPT_SUFFIX) -> Column:
    """Both turns; without a completion the reasoning with the answer in a box behind it."""
    built = F.concat(text_of(reasoning), F.lit("\n\n\\boxed{"), text_of(answer), F.lit("}"))
    body = F.coalesce(F.nullif(completion, F.lit("")), built)
    return F.concat(turn("user", F.concat(text_of(prompt), F.lit(suffix))), F.lit(f"{TURN}assistant\n"), body, F.lit(END))


def tokenized(df: DataFrame, keep: list[str], encoder: Callable[[], Callable[[str], list[int]]], limit: int, suffix: str = PROMPT_SUFFIX) -> DataFrame:
    """``keep``, input_ids, loss_mask, prompt_len, completion_len, truncated, prefix_mismatch of rows with prompt and completion.

    ``encoder`` makes the tokenizer in the worker.  Where the prompt's ids aren't the start of the
    whole text's, the common start counts as the prompt.
    """

    def run(batches):
        encode = encoder()
        for b in batches:
            rows = []
            for p, t in zip(b.column(len(keep)).to_pylist(), b.column(len(keep) + 1).to_pylist(), strict=True):
                head, ids = encode(p), encode(t)
                n = next((i for i, (x, y) in enumerate(zip(head, ids)) if x != y), min(len(head), len(ids)))  # noqa: B905
                mask = ([0] * n + [1] * (len(ids) - n))[:limit]
                rows.append((ids[:limit], mask, min(n, len(mask)), sum(mask), len(ids) > limit, n < len(head)))
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.list_(pa.int32()), pa.list_(pa.int32()), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
            names = ["input_ids", "loss_mask", "prompt_len", "completion_len", "truncated", "prefix_mismatch"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *arrays], names=[*keep, *names])

    user = prompt_text(F.col("prompt"), suffix)
    full = F.concat(turn("user", F.concat(text_of(F.col("prompt")), F.lit(suffix))), turn("assistant", F.col("completion")))
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    out = "input_ids array<int>, loss_mask array<int>, prompt_len int, completion_len int, truncated boolean, prefix_mismatch boolean"
    return df.select(*keep, user.alias("_p"), full.alias("_t")).mapInArrow(run, f"{fields}, {out}")


def corpus_text(completion: Column, answer: Column) -> Column:
    """A completion as it is trained on: reasoning closed, answer in a box, turn ended."""
    return F.concat(F.regexp_replace(text_of(completion), r"(?U)\s+\z", ""), F.lit("\n</think>\n\\boxed{"), text_of(answer), F.lit("}" + END))
