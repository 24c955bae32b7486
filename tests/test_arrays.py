import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill.operators import tensors, tokens
from corpusmill.plans import queries
from corpusmill.sources import tensors as files


def test_masks_and_shift(spark):
    schema = "n int, input_ids array<int>, loss_mask array<int>"
    d = spark.createDataFrame([(1, [5, 6, 7, 8], [0, 0, 1, 1]), (2, [5, 6], [0, 0]), (3, [5], [1]), (4, [], []), (5, None, [1]), (6, [1, 2], [1]), (7, [1, 2], None)], schema)
    ex = {r.n: (r.prompt_len, r.truncated, r.input_ids) for r in tokens.example(d, 3).collect()}
    assert ex == {1: (2, True, [5, 6, 7]), 2: (2, False, [5, 6]), 3: (0, False, [5])}
    sh = {r.n: (r.tokens, r.targets, r.weights) for r in tokens.shifted(d, 2).collect()}
    assert sh == {1: ([5, 6], [6, 7], [0, 1])}
    assert spark.range(1).select(tokens.mask_of_labels(F.array(F.lit(-100), F.lit(4)))).first()[0] == [0, 1]


def _long_records(spark, path):
    """Records of 600, 8,192 and 8,193 ids, all scored from their third id on; id ``i`` is i."""
    rows = [(k, n, list(range(1, n + 1)), [0, 0] + [1] * (n - 2)) for k, n in enumerate((600, 8192, 8193))]
    d = spark.createDataFrame(rows, "rec_id long, n int, input_ids array<int>, loss_mask array<int>")
    d.write.parquet(f"{path}/tokenized_records.parquet")
    return str(path)


def test_examples_are_cut_at_the_full_limit_only(spark, tmp_path):
    d = queries.queries()["token_examples_full"](spark, _long_records(spark, tmp_path))
    got = [tuple(r) for r in d.orderBy("rec_id").select("full_len", "prompt_len", "truncated", "n_ids", "n_scored").collect()]
    assert got == [(600, 2, False, 600, 598), (8192, 2, False, 8192, 8190), (8193, 2, True, 8192, 8190)]


def test_targets_end_at_the_full_limit_only(spark, tmp_path):
    d = queries.queries()["shifted_tokens_full"](spark, _long_records(spark, tmp_path))
    got = [tuple(r) for r in d.orderBy("rec_id").select("n", "weight", "first_target", "last_target").collect()]
    assert got == [(599, 598, 2, 600), (8191, 8190, 2, 8192), (8191, 8190, 2, 8192)]


def test_worst_slice(spark):
    d = spark.createDataFrame([(1, [-1.0, -9.0, -3.0, -9.0], [1, 0, 1, 1]), (2, [], []), (3, [-1.0], [0])], "n int, v array<double>, m array<int>")
    w = tokens.worst_slice(F.col("v"), F.transform("v", lambda x: x.cast("int")), F.col("m"), skip=1, reach=1)
    got = {r.n: (r.scored, r.least, r.place, r.label, r.context) for r in d.select("n", *[c.alias(k) for k, c in w.items()]).collect()}
    assert got == {1: (2, -9.0, 4, -9, [-3, -9]), 2: (0, None, None, None, None), 3: (0, None, None, None, None)}


@pytest.mark.parametrize(("a", "b", "want"), [([1, 2, 3], [1, 2, 4], 2), ([], [1], 0), ([1], [1], 1), ([1, 2], [1, 2, 3], 2), ([None, 1], [None, 2], 1)])
def test_common_prefix(spark, a, b, want):
    d = spark.createDataFrame([(a, b)], "a array<int>, b array<int>")
    assert d.select(tokens.common_prefix(F.col("a"), F.col("b"))).first()[0] == want


def test_cosine_edges(spark):
    rows = [([0.0, 0.0], [0.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0, 1.0], [2.0, 2.0]), ([1.0], [1.0, 2.0]), ([float("nan")], [1.0])]
    d = spark.createDataFrame(rows, "a array<double>, b array<double>")
    got = [r[0] for r in d.select(tensors.cosine(F.col("a"), F.col("b"))).collect()]
    assert got[:2] == [1.0, 0.0] and got[2] == pytest.approx(1.0) and got[3] is None and got[4] is None


@pytest.mark.parametrize(
    ("key", "want"),
    [("m.experts.3.up_proj.lora_A.w", "experts.up_proj.lora_A"), ("m.experts.3.gate.w", "experts.other"), ("m.in_proj.lora_B.w", "in_proj.lora_B"), ("m.q_proj.w", "q_proj.other"), ("x", "other")],
)
def test_categories(spark, key, want):
    assert spark.range(1).select(tensors.category(F.lit(key))).first()[0] == want


def test_low_rank_sum_is_exact_at_full_rank():
    rng = np.random.default_rng(1)
    lefts, rights = [rng.normal(size=(8, 2)) for _ in range(2)], [rng.normal(size=(2, 6)) for _ in range(2)]
    a, b = tensors.low_rank_sum(lefts, rights, 4, 0.5)
    np.testing.assert_allclose(0.5 * b @ a, sum(x @ y for x, y in zip(lefts, rights, strict=True)), atol=1e-10)


def test_files_and_audit(spark, tmp_path):
    rng = np.random.default_rng(2)
    t = {f"m{i}.in_proj.lora_{s}.w": rng.normal(size=(2, 3)).astype(np.float32) for i in range(3) for s in "AB"}
    files.write(str(tmp_path / "x.safetensors"), t)
    spark.dataSource.register(files.TensorSource)
    d = spark.read.format("tensors").load(str(tmp_path))
    got = {r.key: np.array(r.data, np.float32).reshape(r["shape"]) for r in d.collect()}
    assert set(got) == set(t) and all((got[k] == t[k]).all() for k in t)
    heads = spark.read.format("tensors").option("headers", True).load(str(tmp_path))
    assert heads.where("data is null").count() == 6
    same = tensors.compare(d, d, tensors.category(F.col("key"))).collect()
    assert all(r.missing == 0 and r.mean_cosine == pytest.approx(1.0) and r.mean_delta == 0 for r in same)
    pairs = tensors.factor_pairs(d, include="m[01]", exclude="m1").collect()
    assert [p.module for p in pairs] == ["m0.in_proj"]


def test_bfloat(tmp_path):
    import json
    import struct

    head = json.dumps({"t": {"dtype": "BF16", "shape": [2], "data_offsets": [0, 4]}}).encode()
    (tmp_path / "b.safetensors").write_bytes(struct.pack("<Q", len(head)) + head + np.array([0x3F80, 0xC000], "<u2").tobytes())
    assert files.values(files.header(str(tmp_path / "b.safetensors"))[0]).tolist() == [1.0, -2.0]


def test_load_mapping(spark):
    a = spark.createDataFrame([("p.a",), ("p.b",), ("p.c",)], "key string")
    m = spark.createDataFrame([("q.a",), ("p.b",), ("q.b",)], "key string")
    got = {r.key: (r.target, r.shared) for r in tensors.load_mapping(a, m, tensors.key_variants(F.col("key"), [[("p.", "q.")]])).collect()}
    assert got == {"p.a": ("q.a", False), "p.b": ("p.b", False), "p.c": (None, False)}
