import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusmill import __main__ as cli
from corpusmill.functions import render
from corpusmill.operators import merges, notebooks, summaries
from corpusmill.plans import pipelines
from corpusmill.sources import catalog, readers


def test_conversations(spark):
    d = spark.createDataFrame([("p", "", "r", "4"), (None, "done", None, None)], "p string, c string, r string, a string")
    got = [r[0] for r in d.select(render.training_text(*(F.col(x) for x in "pcra"), suffix="?")).collect()]
    assert got[0] == "<|im_start|>user\np?<|im_end|>\n<|im_start|>assistant\nr\n\n\\boxed{4}<|im_end|>" and got[1].endswith("assistant\ndone<|im_end|>")
    m = spark.sql("select array(named_struct('role', 'user', 'content', 'a'), named_struct('role', cast(null as string), 'content', cast(null as string))) m")
    assert m.select(render.conversation(F.col("m"), True)).first()[0] == "<|im_start|>user\na<|im_end|>\n<|im_start|>user\n<|im_end|>\n<|im_start|>assistant\n"


def test_tokenized_examples(spark):
    d = spark.createDataFrame([(1, "ab", "cd"), (2, None, None)], "n int, prompt string, completion string")
    got = {r.n: r for r in render.tokenized(d, ["n"], lambda: lambda s: [ord(c) % 1000 for c in s], 60, "").collect()}
    head = len("<|im_start|>user\nab<|im_end|>\n<|im_start|>assistant\n")
    assert (got[1].prompt_len, got[1].truncated, len(got[1].input_ids), got[1].completion_len, got[1].prefix_mismatch) == (head, True, 60, 60 - head, False)


def test_manifest_of_sources(spark, tmp_path):
    (tmp_path / "train.csv").write_text('id,prompt,answer\na,"p\nq",1\nb,r,2\n')
    (tmp_path / "o.jsonl").write_text("".join(json.dumps({"id": i, "prompt": p, "answer": x, "completion": f"\\boxed{{{x}}}", "task_type": "t", "method": "m"}) + "\n" for i, p, x in (("a", "p\nq", "1"), ("b", "r", "2"), ("z", "?", "3"))))
    (tmp_path / "g.csv").write_text("prompt,cot_trace,answer\nr,work,2\n")
    (tmp_path / "formatted_train_dataset.csv").write_text('user_content,assistant_content\n"r\nPut your final answer inside \\boxed{}.","so \\boxed{2}"\n')
    (tmp_path / "txt").mkdir()
    (tmp_path / "txt" / "a.txt").write_text("x")
    train = readers.csv(spark, str(tmp_path / "train.csv"), ["id", "prompt", "answer"])
    specs = [readers.source_spec(f"{n}:{k}:{tmp_path}/{p}:{t}") for n, k, p, t in (("o", "oracle_jsonl", "o.jsonl", 1), ("g", "generic_csv", "g.csv", 9), ("f", "formatted_csv", "formatted_train_dataset.csv", 9), ("t", "txt_dir", "txt", 9), ("no", "txt_dir", "absent", 1))]
    rows, summary = pipelines.manifest(spark, specs, train, 1)
    got = sorted((r.source, r.id, r.quality_flags) for r in rows.collect())
    assert [g for g in got if g[0] != "o"] == [("f", "b", "prompt_match;source_answer_match;final_boxed_match"), ("g", "b", "prompt_match;source_answer_match;boxed_appended"), ("t", "a", "prompt_match;source_answer_match;boxed_appended")]
    assert len([g for g in got if g[0] == "o"]) == 1
    assert summary["rows"] == 6 and summary["sources"]["o"]["filter_flags"] == {"no_train_join": 1}
    assert [s["exists"] for s in summary["specs"]] == [True, True, True, True, False]
    with pytest.raises(ValueError, match="unknown kind"):
        catalog.load(spark, [{"name": "x", "kind": "y", "path": "z", "target": 0}], train)


def test_hard_tail_and_decision(spark):
    rows = [(i, f"i{i}", "s", "m", ["bit", "eq"][i % 2], "", -float(i), -1.0, "rotate") for i in range(40)]
    audit = spark.createDataFrame(rows, "row_index long, id string, source string, method string, task_type string, quality_flags string, min_logprob double, mean_logprob double, worst_context string")
    m = spark.createDataFrame([("i3", "s", "bit2", "p", "a", "c", "m", "truncated"), ("i4", "s", "new", "p", "a", "c", "m", "")], ", ".join(f"{f} string" for f in readers.TRACE_FIELDS))
    sel, held, summary = pipelines.hard_tail(audit, m, "row_index", max_rows=10)
    assert summary["audit_rows"] == 39 and sel.count() == 10 and held.count() >= 3
    assert sel.join(held, "row_index").count() == 0
    assert pipelines.decide(sel)["path"] in ("bit_repair", "inspect_manually")
    assert summaries.audit_summary(audit)["min_logprob"]["min"] == -39.0


def test_calibration(spark):
    p = spark.createDataFrame([("a", "bit", "p", "01", r"\boxed{01}", "none", "x", "y"), ("b", "bit", "p", "01", r"\boxed{01}", r"\boxed{10}", "x", "z")], "id string, task_type string, prompt string, answer string, chosen string, rejected string, chosen_source string, rejected_source string")
    got = {(r.score, r.dim, r.value): (r.n, r.win_rate) for r in pipelines.calibrate(p).collect()}
    assert got["verifier", "all", ""] == (2, 1.0) and got["composite_simple", "sides", "x>z"] == (1, 1.0) and len(got) == 12


def test_completion(spark):
    train = spark.createDataFrame([("a", "x", "1"), ("b", "x", "2"), ("c", "write the number 4 in the Wonderland numeral system", "IV"), ("d", "?", "9")], "id string, prompt string, answer string")
    shape = "id string, row long, completion string, method string"
    got = {r.id: (r.origin, r.prediction) for r in pipelines.completed(train, spark.createDataFrame([("a", 1, "c", "m")], shape), spark.createDataFrame([("a", 2, "c", "m"), ("b", 3, "c", "m")], shape)).collect()}
    assert got == {"a": ("existing", "1"), "b": ("base", "2"), "c": ("solved", "IV")}


def test_profile(spark):
    train = spark.createDataFrame([("a", "8-bit binary p", "01"), ("b", "roman", "IV")], "id string, prompt string, answer string")
    out = pipelines.profile(train, train.where("id = 'a'").drop("answer"))
    assert (out["id_overlap"], out["prompt_overlap"], out["by_class"]) == (1, 1, {"bit_manipulation": 1, "roman_numerals": 1})


def test_notebook_index(spark, tmp_path):
    d = tmp_path / "own__my-book"
    d.mkdir()
    (d / "kernel-metadata.json").write_text(json.dumps({"id": "own/book", "title": "T", "dataset_sources": ["a/b", "a/b", None], "enable_gpu": True}))
    (d / "n.ipynb").write_text(json.dumps({"metadata": {"kernelspec": {"language": "python"}}, "cells": [{"cell_type": "code", "source": ["a", "b"]}, "odd"]}))
    (d / "bad.json").write_text("{")
    (d / "x.py").write_bytes(b"# lora https://a.b/c \xff")
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "y.py").write_text("1")
    got = {r.folder: r for r in notebooks.index(readers.files(spark, str(tmp_path)), str(tmp_path)).collect()}
    r = got["own__my-book"]
    assert (r.notebook_id, r.title, r.language, r.file_count, r.json_count, r.cell_count, r.source_chars) == ("own/book", "T", "python", 4, 2, 2, 2)
    assert r.dataset_sources == ["a/b"] and r.keyword_counts == {"LoRA": 1} and r.http_urls == ["https://a.b/c"] and r.parse_error_count == 1
    assert got["z"].title is None and got["z"].file_count == 1
    e = pipelines.notebook_index(spark, str(tmp_path), str(tmp_path / "i.json"), str(tmp_path / "csv"))
    assert e.count() == 2 and json.loads((tmp_path / "i.json").read_text())["keyword:LoRA"] == 1


def test_merge_plan_and_merge(spark):
    rng = np.random.default_rng(3)
    rows, full = [], {}
    for name, rank in (("x", 2), ("y", 3)):
        for mod in ("m.in_proj", "m.out_proj"):
            out = 5 if (name, mod) == ("y", "m.out_proj") else 4
            a, b = rng.normal(size=(rank, 6)), rng.normal(size=(out, rank))
            full[name, mod] = (a, b)
            rows += [(name, f"{mod}.lora_A.w", [rank, 6], a.ravel().tolist()), (name, f"{mod}.lora_B.w", [out, rank], b.ravel().tolist())]
    t = spark.createDataFrame(rows, "adapter string, key string, shape array<int>, data array<float>")
    got = {r.module: (r.status, r.action, r.offenders) for r in merges.plan(t, "x", "anchor-copy").collect()}
    assert got == {"m.in_proj": ("compatible", "svd", []), "m.out_proj": ("incompatible", "anchor_copy", ["y"])}
    with pytest.raises(ValueError, match="incompatible"):
        pipelines.merged_adapters(t, {"x": 0.5, "y": 0.5}, {"x": 2.0, "y": 6.0}, "x", 5, 5.0)
    out = {r.key: np.array(r.data).reshape(r["shape"]) for r in pipelines.merged_adapters(t, {"x": 0.5, "y": 0.5}, {"x": 2.0, "y": 6.0}, "x", 5, 5.0, "anchor-copy").collect()}
    want = 0.5 * full["x", "m.in_proj"][1] @ full["x", "m.in_proj"][0] + 0.5 * 2.0 * full["y", "m.in_proj"][1] @ full["y", "m.in_proj"][0]
    np.testing.assert_allclose(out["m.in_proj.lora_B.w"] @ out["m.in_proj.lora_A.w"], want, atol=1e-4)
    assert out["m.out_proj.lora_A.w"].shape == (2, 6) and len(out) == 4
    s = merges.scales(spark.createDataFrame([("m.in_proj", 2), ("k", 4)], "module string, rank int"), spark.createDataFrame([("in_proj", 8.0)], "pattern string, value double"), 16.0)
    assert {r.module: r["scale"] for r in s.collect()} == {"m.in_proj": 4.0, "k": 4.0}


def test_adapter_folder(tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("deep/adapter_config.json", "{}")
        z.writestr("deep/other.txt", "x")
    out = catalog.adapter_folder(str(tmp_path / "a.zip"))
    assert out == str(tmp_path / "a") and (tmp_path / "a" / "adapter_config.json").exists() and not (tmp_path / "a" / "other.txt").exists()
    assert catalog.adapter_folder(out) == out
    with pytest.raises(FileNotFoundError):
        catalog.adapter_folder(str(tmp_path / "none.zip"))


def test_discovery(spark):
    f = spark.createDataFrame([("d", "/a/x.csv", 5), ("d", "/a/nemo_1.jsonl", 9), ("d", "/a/y.bin", 1), ("e", "/b/t/1.txt", 1), ("e", "/b/2.txt", 1), ("e", "/b/t/3.txt", 1)], "dataset string, path string, length long")
    assert sorted((r.kind, r.label) for r in catalog.discover(f).collect()) == [("generic_csv", "d_2"), ("nemo_jsonl", "d")]
    assert catalog.best_text_folder(f).first().folder == "/b/t"
    o = spark.createDataFrame([(0, "b", 0), (0, "a", 1), (0, "b", 2), (1, "c", 3)], "epoch int, problem_id string, pos int")
    c = spark.createDataFrame([("a",), ("b",), ("c",)], "problem_id string")
    assert [r.problem_id for r in catalog.replay_order(o, c).collect()] == ["b", "a"]


def test_command_line(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,prompt,answer\na,write the number 4 in the Wonderland numeral system,IV\n')
    cli.main(["solve", "--train", str(tmp_path / "t.csv"), "--output", str(tmp_path / "out")])
    assert spark.read.json(str(tmp_path / "out")).first().prediction == "IV"
    cli.main(["profile", "--train", str(tmp_path / "t.csv"), "--test", str(tmp_path / "t.csv"), "--output", str(tmp_path / "p.json")])
    assert json.loads((tmp_path / "p.json").read_text())["train_rows"] == 1
    assert cli.caps_of(["a=1", " a =2"]) == {"a": 2}
    with pytest.raises(ValueError, match="COUNT"):
        cli.caps_of(["a"])
