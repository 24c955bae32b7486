import random

import numpy as np
from pyspark.sql import functions as F

from corpusmill.operators import ranking


def test_ordered_rank_is_that_of_one_sort(spark):
    rnd = random.Random(1)
    rows = [(rnd.choice(["a", "a", "a", "b", None]), i) for i in rnd.sample(range(10_000), 500)]
    d = spark.createDataFrame(rows, "g string, x long")
    got = {(r.g, r.x): r["rank"] for r in ranking.ordered_rank(d, ["g"], ranking.range_bucket(F.col("x"), 700), ["x"]).collect()}
    for g in ("a", "b", None):
        want = sorted(x for h, x in rows if h == g)
        assert [got[g, x] for x in want] == list(range(1, len(want) + 1))


def test_quantiles_interpolate(spark):
    rnd = random.Random(2)
    rows = [(g, float(rnd.choice([rnd.gauss(0, 9), 3.0]))) for g in "ab" for _ in range(333)] + [("c", float("nan")), ("d", 5.0), ("e", None)]
    d = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.q0, r.q1) for r in ranking.quantiles(d, "x", [0.05, 0.5], ["g"]).collect()}
    assert set(got) == {"a", "b", "d"}
    for g in got:
        np.testing.assert_allclose(got[g], np.quantile([x for h, x in rows if h == g], [0.05, 0.5]), rtol=1e-12)


def test_empty_tables(spark):
    d = spark.createDataFrame([], "g string, x long")
    assert ranking.ordered_rank(d, ["g"], ranking.range_bucket(F.col("x")), ["x"]).count() == 0
    assert ranking.quantiles(d, "x", [0.5], ["g"]).count() == 0
    assert ranking.quantiles(d, "x", [0.5]).first().asDict() == {"q0": None, "n": 0, "min": None, "mean": None}
    assert ranking.first_per_key(d, ["g"], F.col("x")).count() == 0
    assert ranking.seeded_sample(d, "g", "x", {"a": 3}, 1).count() == 0


def test_seeded_sample_is_the_library_s(spark):
    d = spark.createDataFrame([("a", i) for i in range(100)] + [("b", i) for i in range(100, 105)] + [(None, 200)], "g string, x long")
    got = sorted((r.x for r in ranking.seeded_sample(d, "g", "x", {"a": 7, "b": 9}, 42).collect()))
    want = sorted(random.Random("42:a").sample(range(100), 7)) + [100, 101, 102, 103, 104, 200]
    assert got == want


def test_first_and_last_with_clashing_names(spark):
    d = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), (None, 3, "z")], "_k0 string, x long, _row string")
    assert {(r["_k0"], r.x) for r in ranking.first_per_key(d, ["_k0"], F.col("x")).collect()} == {("a", 1), (None, 3)}
    assert {(r["_k0"], r.x) for r in ranking.first_per_key(d, ["_k0"], F.col("x"), last=True).collect()} == {("a", 2), (None, 3)}
