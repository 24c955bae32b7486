import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.functions import bits, render
from corpusmill.operators import harvest, ranking, solvers, summaries, tails, tensors, tokens
from corpusmill.sources import catalog


def test_bytes_are_those_of_the_solver(spark):
    d = spark.range(256)
    table = solvers._shifts(np.arange(256))
    cols = [bits.shift8(F.col("id"), k, n) for k in ("ROT", "SHL", "SHR") for n in range(1, 8)]
    got = np.array([list(r) for r in d.orderBy("id").select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).collect()]).T
    assert (got == table).all()
    a, b = np.arange(256, dtype=np.uint8), np.arange(256, dtype=np.uint8)[::-1] // 3
    gates = solvers._gates(a[None, :], b[None, :])[0] if solvers._gates(a[None, :], b[None, :]).ndim == 3 else solvers._gates(a, b)
    other = F.floor((255 - F.col("id")) / 3)
    got = np.array([list(r) for r in d.orderBy("id").select(*[bits.gate8(F.col("id"), other, g).alias(g) for g in bits.GATES]).collect()]).T
    assert (got == gates).all()
    with pytest.raises(KeyError):
        bits.gate8(F.lit(1), F.lit(1), "NAND")
    assert spark.range(1).select(bits.bit_array(F.lit("0110"))).first()[0] == [0, 1, 1, 0]


def test_upper_median(spark):
    rnd = random.Random(1)
    rows = [(g, rnd.choice([1, 2, 3, rnd.randint(0, 500)])) for g in "ab" for _ in range(101 if g == "a" else 100)] + [("c", None), ("d", 4)]
    d = spark.createDataFrame(rows, "g string, x int")
    want = {g: sorted(v)[len(v) // 2] for g in "abd" if (v := [x for h, x in rows if h == g and x is not None])}
    assert {r.g: r.median for r in ranking.upper_median(d, "x", ["g"]).collect()} == want
    every = sorted(x for _, x in rows if x is not None)
    assert ranking.upper_median(d, "x").first().median == every[len(every) // 2]
    assert ranking.upper_median(d.limit(0), "x").count() == 0


def test_orders(spark):
    d = spark.range(50)
    a, b = ([r.id for r in ranking.hash_shuffle(x, ["id"], 3).collect()] for x in (d, d.repartition(4)))
    assert a == b != list(range(50)) and sorted(a) == list(range(50))
    assert sorted(ranking.permutation(9, 0)) == list(range(9)) and ranking.permutation(9, 0) == ranking.permutation(9, 0)
    assert ranking.steps(100, 70, 32) == 2


def test_names(spark):
    d = spark.createDataFrame([("m.experts.1.up_proj.lora_A.w",), ("m.q.w",)], "key string")
    got = [tuple(r) for r in d.select(tensors.restored(F.col("key"), "all_moe"), tensors.restored(F.col("key"), "broken_moe", ("A.w",)), tensors.renamed(F.col("key"), [("m.", "n.")])).collect()]
    assert got == [(True, True, "n.experts.1.up_proj.lora_A.w"), (False, False, "n.q.w")]
    with pytest.raises(ValueError, match="mode"):
        tensors.restored(F.col("key"), "x")
    assert tensors.adapter_spec("a=b:c:0.5") == ("a", "b:c", 0.5)
    with pytest.raises(ValueError, match="weight"):
        tensors.adapter_spec("a=b")


def test_checked_comparison(spark):
    t = spark.createDataFrame([("a", [1.0, 2.0])], "key string, data array<float>")
    assert tensors.checked(tensors.compare(t, t, F.lit("x"))).count() == 1
    with pytest.raises(Exception, match="tensors differ"):
        tensors.checked(tensors.compare(t, t.withColumn("data", F.array(F.lit(2.0), F.lit(-1.0))), F.lit("x"))).collect()


def test_model_hook(spark):
    d = spark.createDataFrame([(1, [3, 4]), (2, [])], "n int, input_ids array<int>")
    got = {r.n: r.logprobs for r in tokens.with_logprobs(d, ["n"], lambda: lambda rows: [[-float(i) for i in x] for x in rows]).collect()}
    assert got == {1: [-3.0, -4.0], 2: []}


def test_small_helpers(spark):
    d = spark.createDataFrame([([" a", "b", None, "a ", ""], {"x": "3", "y": "z"})], "l array<string>, m map<string,string>")
    r = d.select(harvest.stable_unique(F.col("l")), harvest.counts_of(F.col("m")), harvest.matches_any("q, B", F.lit("abc")), harvest.matches_any("", F.lit("x")), render.corpus_text(F.lit("w \n"), F.lit("4"))).first()
    assert tuple(r) == (["a", "b"], {"x": 3}, True, True, "w\n</think>\n\\boxed{4}<|im_end|>")
    assert tails.score_fields("content_min_logprob")[0] == "content_mean_logprob" and set(tails.ADVICE) >= {"inspect_manually", "bit_repair"}
    recs = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string")
    assert [(x.n, x.is_example) for x in summaries.dry_run(recs, recs.where("n = 2"), "n").orderBy("n").collect()] == [(1, False), (2, True)]
    s = spark.createDataFrame([("f", "m", True, "p", "i"), ("f", "m", False, None, "j")], "family string, method string, correct boolean, prediction string, id string")
    assert solvers.method_histogram(s).first().n == 2 and solvers.correct_traces(s, ["id"]).first().completion == "F\nFinal answer: \\boxed{p}"


def test_archives():
    assert catalog.pick_archive(["/x/long/sub.zip", "/a.zip", "/b/sub.zip"], "sub") == "/b/sub.zip"
    assert catalog.checked_config({"peft_type": "LORA", "r": 8})["r"] == 8
    for bad in ({}, {"peft_type": "LORA", "r": 99}):
        with pytest.raises(ValueError):
            catalog.checked_config(bad)


def test_audit_lists_every_task(spark):
    n = 10_050
    d = spark.range(2 * n).select(F.format_string("t%05d", F.col("id") % n).alias("task_type"), F.lit("s").alias("source"), F.lit("").alias("quality_flags"), (-F.col("id")).cast("double").alias("min_logprob"))
    out = summaries.audit_summary(d)
    assert out["rows"] == 2 * n and [tuple(r) for r in out["by_source"].collect()] == [("s", 2 * n)]
    assert sorted(tuple(r) for r in out["by_task_type"].collect()) == [(f"t{i:05}", 2) for i in range(n)]
    assert [tuple(r) for r in out["min_logprob"]["by_task_mean"].collect()] == [(f"t{i:05}", -i - n / 2) for i in range(n)]
