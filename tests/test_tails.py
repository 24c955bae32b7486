import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from corpusmill.operators import tails

SCHEMA = "n long, id string, source string, method string, task_type string, quality_flags string, hard double, mean_logprob double"


def rows(rnd, n):
    ids = [f"i{k}" for k in range(n // 2)]
    return [
        (k, rnd.choice(ids), rnd.choice("AB"), "m", rnd.choice(["t1", "t1", "t2", "t3", None]), "", round(rnd.uniform(-9, 0), 2), rnd.choice([None, -1.0, -2.0])) for k in range(n)
    ]


def digest(*parts):
    return int(hashlib.sha256("::".join(map(str, parts)).encode()).hexdigest(), 16)


def test_holdout(spark):
    data = rows(random.Random(4), 60) + [(100, "one", "A", "m", "solo", "", -1.0, None)]
    d = tails.scored(spark.createDataFrame(data, SCHEMA), "hard")
    held = {r.n for r in tails.holdout(d, 0.1, 5, "n").where("held").collect()}
    want = set()
    for t in {r[4] or "unknown" for r in data}:
        mine = sorted((r for r in data if (r[4] or "unknown") == t), key=lambda r: (digest(t, r[1], r[2], r[3], 5), r[0]))
        want |= {r[0] for r in mine[: max(1, round(len(mine) * 0.1))]}
    assert held == want and 100 in held
    assert tails.holdout(d, 0.0, 5, "n").where("held").count() == 0


def fold(data, per_task, max_rows, seed):
    tasks = {}
    for r in data:
        tasks.setdefault(r[4] or "unknown", []).append(r)
    for q in tasks.values():
        q.sort(key=lambda r: (r[6], 0.0 if r[7] is None else r[7], digest(r[1], r[2], r[3], seed), r[0]))
    seen, picks, counts = set(), [], Counter()
    moved = True
    while moved and len(picks) < max_rows:
        moved = False
        for t in sorted(tasks):
            if len(picks) >= max_rows:
                break
            while counts[t] < per_task and tasks[t]:
                r = tasks[t].pop(0)
                if r[1:4] in seen:
                    continue
                seen.add(r[1:4])
                picks.append(r[0])
                counts[t] += 1
                moved = True
                break
    return picks


def test_round_robin_with_shared_keys(spark):
    for seed in (1, 2, 3):
        data = rows(random.Random(seed), 40)
        d = tails.scored(spark.createDataFrame(data, SCHEMA), "hard")
        for per_task, most in ((3, 256), (8, 11)):
            got = [r["row"] for r in tails.round_robin(d, per_task, most, 9, "n").orderBy("pick").collect()]
            assert got == fold(data, per_task, most, 9)


def test_scores_that_count(spark):
    data = [(1, "a", "A", "m", "t", "x;truncated", -1.0, None), (2, "a", "A", "m", "t", None, float("nan"), None), (3, "a", "A", "m", "", None, float("inf"), None), (4, "a", "A", "m", "", "ok", -2.0, float("nan"))]
    got = tails.scored(spark.createDataFrame(data, SCHEMA), "hard").collect()
    assert [(r.n, r.task, r.mean) for r in got] == [(4, "unknown", 0.0)]


def test_decision_arithmetic(spark):
    sel = [("bit", "s")] * 19 + [("symbolic", "q")] * 17 + [("other", "q")] * 20
    selected = spark.createDataFrame(sel, "task string, source string").withColumn("quality_flags", F.lit(""))
    worst = spark.createDataFrame([("operator xor",)] * 15 + [("operator",)] * 5 + [("zzz",)] * 10, "worst_context string")
    got = {r.path: (round(r.score, 4), r.chosen) for r in tails.choose_path(tails.path_scores(selected, worst, ("s",))).collect()}
    assert got["symbolic_operator"] == (0.5369, "inspect_manually") and got["bit_repair"] == (0.5991, "inspect_manually")


def test_empty(spark):
    d = tails.scored(spark.createDataFrame([], SCHEMA), "hard")
    assert tails.holdout(d, 0.1, 1, "n").count() == 0 and tails.round_robin(d, 3, 9, 1, "n").count() == 0
    assert tails.choose_path(tails.path_scores(d, d.withColumn("worst_context", F.lit("")))).first().chosen == "inspect_manually"
