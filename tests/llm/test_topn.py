import math
import random

from pyspark.sql import functions as F

from corpusmill.llm import topn

SCHEMA = "row_index long, task_type string, hard_tail_score double, min_logprob double, g string, place int"


def brute(rows, n=3):
    groups = {}
    for i, t, s, m, *_ in rows:
        if s is None or not math.isfinite(s) or i is None:
            continue
        g = (t or "").strip(" \t ​").lower() or "unknown"
        groups.setdefault(g, {})[i] = (-s, -(m if m is not None and not math.isnan(m) else -math.inf), i)
    return {(g, k[2]) for g, v in groups.items() for k in sorted(v.values())[:n]}


def test_same_as_sorting(spark):
    rnd = random.Random(5)
    rows = []
    for i in range(4000):
        t = rnd.choice(["hot", " HOT\t", "Hot ", rnd.choice([None, "", "  ", f"g{rnd.randint(0, 400)}"])])
        row = (i, t, rnd.choice([None, float("nan"), float("inf"), -math.inf, 0.0, -0.0, round(rnd.uniform(-3, 0), 1)]), rnd.choice([None, float("nan"), -1.0, -2.0]), "x", 1)
        rows += [row] * rnd.choice([1, 1, 2])
    d = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = topn.top_n(d, topn.group_name(F.col("task_type")), "hard_tail_score", "row_index", 3, "min_logprob").collect()
    assert {(r.g, r.ident) for r in got} == brute(rows) and len(got) == len(brute(rows))
    for g in {r.g for r in got}:
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.place)
        assert [r.place for r in mine] == list(range(1, len(mine) + 1))
        assert mine == sorted(mine, key=lambda r: (-r.score, -r.tie, r.ident))


def test_flushed_heaps_meet_again(spark, monkeypatch):
    monkeypatch.setattr(topn, "MAX_GROUPS", 1)
    rows = [(i, f"g{i % 50}", float(-(i % 97)), None, "", 0) for i in range(20_000)]
    import pyarrow as pa

    batches = [
        pa.RecordBatch.from_arrays(
            [pa.array([r[1] for r in rows[k : k + 500]]), pa.array([r[2] for r in rows[k : k + 500]]), pa.array([-math.inf] * 500), pa.array([r[0] for r in rows[k : k + 500]], pa.int64())],
            names=["g", "score", "tie", "ident"],
        )
        for k in range(0, 20_000, 500)
    ]
    heaps = list(topn._heaps(3, True)(iter(batches * 8)))
    assert len(heaps) > 1
    t = pa.Table.from_batches(heaps).sort_by("g").combine_chunks().to_batches()
    out = [x for b in topn._sorted_heaps(3)(iter(t)) for x in zip(b.column(0).to_pylist(), b.column(3).to_pylist(), strict=True)]
    assert set(out) == brute(rows) and len(out) == len(set(out))


def test_empty_and_no_tie_column(spark):
    d = spark.createDataFrame([], SCHEMA)
    assert topn.top_n(d, topn.group_name(F.col("task_type")), "hard_tail_score", "row_index").count() == 0
    d = spark.createDataFrame([(2, "a", 1.0, None, "", 0), (1, "a", 1.0, 5.0, "", 0), (None, "a", 9.0, 1.0, "", 0)], SCHEMA)
    assert [r.ident for r in topn.top_n(d, topn.group_name(F.col("task_type")), "hard_tail_score", "row_index", 1).collect()] == [1]


def test_an_identifier_counts_once_whatever_its_scores(spark):
    rows = [("a", 9.0, 1), ("a", 8.0, 1), ("a", 7.0, 1), ("a", 6.0, 2), ("a", 5.0, 3), ("a", 4.0, 4), ("b", 1.0, 1)]
    d = spark.createDataFrame(rows, "t string, s double, i long")
    for parts in (1, 3):
        got = topn.top_n(d.repartition(parts), topn.group_name(F.col("t")), "s", "i", 3).select("g", "ident", "score", "place").collect()
        assert sorted(map(tuple, got)) == [("a", 1, 9.0, 1), ("a", 2, 6.0, 2), ("a", 3, 5.0, 3), ("b", 1, 1.0, 1)]
