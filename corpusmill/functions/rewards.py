"""Verifiable rewards of completions, in Arrow batches.

Only what the JVM can't express runs in Python: nested boxes and the sequence ratio
of the standard library.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusmill.functions.text import REWARD_TASKS

# Shapes of answers and of the lines that state them.
_SPACE = re.compile(r"\s+")
_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")
_BINARY = re.compile(r"[01]+")
_ROMAN = re.compile(r"[IVXLCDM]+", re.I)
_LETTERS = re.compile(r"[a-z ]+", re.I)
_STATED = [re.compile(rf"{w}\s*[:=]\s*([^\n]+)$", re.I | re.M) for w in ("final answer", "answer")]
_OUTPUTS = re.compile(r"->\s*([01]{8})")

# Weights of the terms in the rewards.
WEIGHTS = {"answer_exact": 0.58, "answer_partial": 0.24, "format_valid": 0.08, "trace_parseable": 0.06, "boxed_valid": 0.04}
SEQUENCE_WEIGHTS = {"exact": 0.62, "partial": 0.20, "ratio": 0.10, "cosine": 0.08}
COMPOSITE_WEIGHTS = {"exact": 0.44, "partial": 0.22, "format": 0.14, "parseable": 0.10, "boxed": 0.06, "cosine": 0.04}
NUMERIC_TASKS = ("gravity_physics", "unit_conversion", "symbolic_equation")


def squash(text: str | None) -> str:
    """Stripped with white space collapsed; null as empty."""
    return _SPACE.sub(" ", text or "").strip()


def balanced_boxes(text: str | None) -> list[str]:
    """Contents of all boxes with balanced braces, squashed; an unbalanced box is passed over."""
    out, at = [], 0
    while text and (i := text.find("\\boxed{", at)) >= 0:
        depth, j = 1, i + 7
        while j < len(text) and depth:
            depth += (text[j] == "{") - (text[j] == "}")
            j += 1
        if depth:
            at = i + 7
        else:
            out.append(squash(text[i + 7 : j - 1]))
            at = j
    return out


def stated(text: str | None, boxes: list[str], generated: str | None = None) -> str:
    """A given answer, else the last box, else the first answer line, else empty."""
    if given := squash(generated):
        return given
    if boxes:
        return boxes[-1]
    for p in _STATED:
        if m := p.search(text or ""):
            return squash(m[1])
    return ""


def ratio(a: str, b: str) -> float:
    """Ratcliff-Obershelp ratio without case; 1 for two empty texts, 0 for one."""
    if not a or not b:
        return float(a == b)
    return SequenceMatcher(None, a.lower(), b.lower()).ratio()


def trigram_cosine(a: str | None, b: str | None) -> float:
    """Cosine of letter triples of the padded, squashed texts; two empty texts are equal."""
    x, y = (Counter(s[i : i + 3] for i in range(len(s) - 2)) for s in (f"  {squash(t).lower()}  " for t in (a, b)))
    dot = sum(n * y[g] for g, n in x.items())
    return dot / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))


def same(stored: str, given: str) -> bool:
    """Binary answers exactly, numbers within 1 percent or 1e-5, all else without case."""
    s, g = stored.strip(), given.strip()
    if not _BINARY.fullmatch(s):
        try:
            return math.isclose(float(s), float(g), rel_tol=1e-2, abs_tol=1e-5)
        except ValueError:
            pass
    return s.lower() == g.lower()


def partial(answer: str, given: str) -> tuple[float, list[str]]:
    """Partial credit by the shape of the answer, and what is wrong with the given one."""
    if _BINARY.fullmatch(answer):
        if not given:
            return 0.0, ["missing_final"]
        if not _BINARY.fullmatch(given):
            return 0.0, ["malformed_binary"]
        hits = sum(x == y for x, y in zip(answer, given))  # noqa: B905 - the shorter one decides
        return hits / max(len(answer), len(given)), [] if len(answer) == len(given) else ["wrong_binary_length"]
    if _NUMBER.fullmatch(answer):
        if not _NUMBER.fullmatch(given):
            return ratio(answer, given), ["non_numeric_partial"]
        off = abs(float(answer) - float(given)) / max(abs(float(answer)), 1.0)
        return max(0.0, 1.0 - min(off / 0.25, 1.0)), ["numeric_outside_metric_tolerance"] if off > 0.01 else []
    if _ROMAN.fullmatch(answer):
        return ratio(answer, given), [] if _ROMAN.fullmatch(given) else ["malformed_roman"]
    if not given:
        return 0.0, ["missing_final"]
    want, got = answer.lower().split(), given.lower().split()
    flags = [] if len(want) == len(got) else ["wrong_word_count"]
    if [len(w) for w in want] != [len(w) for w in got]:
        flags.append("word_length_mismatch")
    have = set(got)
    return 0.65 * ratio(answer, given) + 0.35 * (sum(w in have for w in want) / len(want) if want else 0.0), flags


def well_formed(task: str, answer: str, given: str) -> bool:
    """Whether the given answer has the form its task asks for."""
    if task == "bit_manipulation":
        return bool(re.fullmatch("[01]{8}", given))
    if task == "text_cipher":
        return bool(_LETTERS.fullmatch(given))
    if task == "numeral_system":
        return bool(_ROMAN.fullmatch(given))
    if task in NUMERIC_TASKS:
        for shape in (_NUMBER, _BINARY):
            if shape.fullmatch(answer):
                return bool(shape.fullmatch(given))
    return bool(given)


def reward(prompt: str | None, completion: str | None, answer: str | None, task_type: str | None, generated: str | None = None) -> dict:
    """extracted_answer, reward, terms and sorted flags of one completion."""
    task = (task_type or "").strip()
    task = REWARD_TASKS.get(task, task or "unknown")
    text = (completion or "").strip()
    want, boxes = squash(answer), balanced_boxes(text)
    given = stated(text, boxes, generated)
    exact = bool(given) and same(want, given)
    credit, flags = partial(want, given)
    copied = task == "bit_manipulation" and bool(given) and given != want and given in _OUTPUTS.findall(prompt or "")
    terms = {
        "boxed_valid": float(bool(boxes)),
        "answer_exact": float(exact),
        "answer_partial": credit,
        "format_valid": float(well_formed(task, want, given)),
        "trace_parseable": float(bool(given)),
        "copy_example_penalty": -0.3 if copied else 0.0,
    }
    total = sum(w * terms[k] for k, w in WEIGHTS.items()) + terms["copy_example_penalty"]
    if len(boxes) > 1:
        flags.append("multiple_boxed")
    if not given:
        flags.append("missing_extracted_answer")
    flags.append("answer_exact" if exact else "wrong_final")
    return {
        "extracted_answer": given,
        "reward": round(max(0.0, min(1.0, total)), 6),
        "terms": {k: round(v, 6) for k, v in terms.items()},
        "flags": sorted(set(flags)),
    }


def scores(result: dict, answer: str | None) -> dict[str, float]:
    """Three rewards of one completion: the verifier's, sequence correctness, simple composite."""
    t, want, given = result["terms"], squash(answer), result["extracted_answer"]
    cos = trigram_cosine(want, given)
    parts = {
        "exact": t["answer_exact"], "partial": t["answer_partial"], "ratio": ratio(want, squash(given)), "cosine": cos,
        "format": t["format_valid"], "parseable": t["trace_parseable"], "boxed": t["boxed_valid"],
    }

    def mix(weights: dict[str, float]) -> float:
        return round(max(0.0, min(1.0, sum(w * parts[k] for k, w in weights.items()))), 6)

    return {"verifier": result["reward"], "sequence_correctness": mix(SEQUENCE_WEIGHTS), "composite_simple": mix(COMPOSITE_WEIGHTS)}


_OUT = "extracted_answer string, reward double, terms map<string,double>, flags array<string>, scores map<string,double>"


def with_reward(df: DataFrame, keep: list[str], generated: str | None = None) -> DataFrame:
    """``keep`` and the reward columns of rows with prompt, completion, answer and task_type; nulls read as empty.

    Filter rows before: the optimiser can't move a predicate through this operator.
    """
    cols = ["prompt", "completion", "answer", "task_type", *([generated] if generated else [])]

    def run(batches):
        for b in batches:
            args = [b.column(len(keep) + i).to_pylist() for i in range(len(cols))]
            got = [reward(*x) for x in zip(*args, strict=True)]
            marks = [list(scores(g, a).items()) for g, a in zip(got, args[2], strict=True)]
            arrays = [
                pa.array([g["extracted_answer"] for g in got], pa.string()),
                pa.array([g["reward"] for g in got], pa.float64()),
                pa.array([list(g["terms"].items()) for g in got], pa.map_(pa.string(), pa.float64())),
                pa.array([g["flags"] for g in got], pa.list_(pa.string())),
                pa.array(marks, pa.map_(pa.string(), pa.float64())),
            ]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), *arrays], names=[*keep, "extracted_answer", "reward", "terms", "flags", "scores"])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, *[F.col(c).alias(f"_{c}") for c in cols]).mapInArrow(run, f"{fields}, {_OUT}")


def with_cosine(df: DataFrame, keep: list[str], a: str, b: str) -> DataFrame:
    """``keep`` and ``cosine``, the letter-triple cosine of two text columns rounded to 6."""

    def run(batches):
        for r in batches:
            x, y = r.column(len(keep)).to_pylist(), r.column(len(keep) + 1).to_pylist()
            out = pa.array([round(trigram_cosine(p, q), 6) for p, q in zip(x, y, strict=True)], pa.float64())
            yield pa.RecordBatch.from_arrays([*(r.column(i) for i in range(len(keep))), out], names=[*keep, "cosine"])

    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keep)
    return df.select(*keep, F.col(a).alias("_a"), F.col(b).alias("_b")).mapInArrow(run, f"{fields}, cosine double")
