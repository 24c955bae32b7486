"""Driver queries of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm import encode, languages, mixing, packing, pairs_op, survivors, topn
from corpusmill.session import table

Query = Callable[[SparkSession, str], DataFrame]


def _p1(how) -> Query:
    return lambda s, d: how(table(s, d, "tokenized_records"), table(s, d, "pack_settings"))


def _p3(how) -> Query:
    return lambda s, d: how(table(s, d, "traces"), table(s, d, "train_puzzles"), table(s, d, "source_catalog"))


def _p4(s: SparkSession, d: str) -> DataFrame:
    t = table(s, d, "hard_tail_v5_64_diagnostic")
    return topn.top_n(t, topn.group_name(F.col("task_type")), "hard_tail_score", "row_index", 3, "min_logprob")


def _p5(how) -> Query:
    return lambda s, d: how(table(s, d, "traces"), table(s, d, "tokenized_records"))


def _decoded(s: SparkSession, d: str) -> DataFrame:
    """Digests of the bytes that the ids stand for: those of the texts."""
    raw = encode.decode_column(encode.encode_column(table(s, d, "documents"), ["doc_id"]), ["doc_id"])
    return raw.select("doc_id", F.octet_length("raw").cast("bigint").alias("n_bytes"), F.sha2("raw", 256).alias("sha256"))


def _p7(how) -> Query:
    return lambda s, d: how(mixing.Mixture(table(s, d, "documents"), table(s, d, "mix_targets")))


def queries() -> dict[str, Query]:
    return {
        "p1_packed": _p1(packing.packed),
        "p1_report": _p1(packing.report),
        "p1_valid": _p1(lambda r, t: packing.validity(packing.packed(r, t), t)),
        "p2_found": lambda s, d: pairs_op.defective_pairs(table(s, d, "traces")),
        "p3_found": _p3(survivors.lexicographic),
        "p3_votes": _p3(survivors.votes),
        "p4_found": lambda s, d: _p4(s, d).select(F.col("g").alias("task_type"), F.col("ident").alias("row_index")),
        "p5_found": _p5(pairs_op.cut_records),
        "p5_rates": _p5(pairs_op.cut_rates),
        "p6_ids": lambda s, d: encode.encode_column(table(s, d, "documents"), ["doc_id"]),
        "p6_decoded": _decoded,
        "p7_valid": _p7(mixing.Mixture.validity),
        "p7_mix": _p7(mixing.Mixture.documents),
        "p7_shares": _p7(mixing.Mixture.shares),
        "p7_schedule": _p7(mixing.Mixture.schedule),
        "p8_found": lambda s, d: languages.wrong_labels(table(s, d, "documents")),
        "p8_languages": lambda s, d: languages.languages(table(s, d, "documents")),
    }
