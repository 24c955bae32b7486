import json

from pyspark.sql import functions as F

from corpusmill.operators import candidates, harvest
from corpusmill.plans import files
from corpusmill.sources import catalog, readers, sinks
from corpusmill.streaming import ingest


def test_csv_keeps_zeros_and_line_breaks(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id,prompt,answer\na,"x\ny ""q""",0101\nb,,nan\n')
    rows = readers.csv(spark, str(tmp_path / "t.csv"), ["id", "prompt", "answer"]).collect()
    assert [tuple(r) for r in rows] == [("a", 'x\ny "q"', "0101"), ("b", None, "nan")]
    assert readers.csv_columns(spark, str(tmp_path / "t.csv")) == ["id", "prompt", "answer"]


def test_jsonl_counts_lines(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": "a"}\n\n{"id": "b", "completion": "x"}\n')
    rows = readers.jsonl(spark, str(tmp_path / "t.jsonl"), "id string, completion string").collect()
    assert [(r.row_index, r.id) for r in rows] == [(1, "a"), (3, "b")]


def test_token_lines_count_on_over_parts(spark, tmp_path):
    for part, rows in enumerate(([[1, 2], None, [3]], [[4]], [[5, 6], [7, 8]])):
        (tmp_path / f"part-{part}.json").write_text("".join((json.dumps({"input_ids": x, "labels": x}) if x else "") + "\n" for x in rows))
    (tmp_path / "names.json").write_text("".join(json.dumps({"id": f"n{i}" if i != 4 else None, "answer": str(i)}) + "\r\n" for i in range(1, 7)))
    (tmp_path / "ids").mkdir()
    for part in range(3):
        (tmp_path / f"part-{part}.json").rename(tmp_path / "ids" / f"part-{part}.json")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "48b")
    try:
        got = [(r.id, r.answer, r.input_ids) for r in catalog.load_tokens(spark, str(tmp_path / "ids"), str(tmp_path / "names.json"), "s").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted(got) == [("n1", "1", [1, 2]), ("n3", "3", [3]), ("n5", "5", [5, 6]), ("n6", "6", [7, 8]), ("row_000004", "4", [4])]


def test_token_lines_are_written_and_read_in_parts(spark, tmp_path):
    spark.range(2000).select(F.col("id").alias("rec_id"), F.lit("n").alias("id"), F.array(F.lit(1)).alias("input_ids"), F.array(F.lit(1)).alias("loss_mask")).write.parquet(str(tmp_path / "r"))
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        files._token_lines(spark.read.parquet(str(tmp_path / "r")), str(tmp_path / "out"))
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(list((tmp_path / "out" / "ids").glob("part-*"))) > 1


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_text("work \\boxed{1}")
    (tmp_path / "z.txt").write_text("alone")
    train = spark.createDataFrame([("a", "p", "1")], "id string, prompt string, answer string")
    got = {r.id: r.quality_flags for r in readers.text_folder(spark, str(tmp_path), train, "s").collect()}
    assert got == {"a": "", "z": "prompt_missing;answer_missing"}
    g = spark.createDataFrame([(7, None, "q", r"\boxed{5}", "bit")], "row_index int, id string, user_content string, assistant_content string, type string")
    r = readers.generic_traces(g, "s").first()
    assert (r.id, r.prompt, r.answer, r.task_type) == ("row_000007", "q", "5", "bit")
    t = spark.createDataFrame([(1, [1, 2], [-100, 2]), (2, [1], [1, 2]), (3, None, [1])], "row_index long, input_ids array<int>, labels array<int>")
    names = spark.createDataFrame([(1, "n", "")], "row_index long, id string, answer string")
    assert [(r.id, r.loss_mask, r.quality_flags) for r in readers.pretokenized(t, names, "s").collect()] == [("n", [0, 1], "pretokenized;empty_answer")]
    (tmp_path / "ids.csv").write_text("# no\na,1\n\nb\n")
    assert sorted(r.id for r in readers.id_list(spark, str(tmp_path / "ids.csv")).collect()) == ["a", "b"]
    assert readers.source_spec("n:k:/a/b:12") == {"name": "n", "kind": "k", "path": "/a/b", "target": 12}
    assert readers.kind_of("x/nemo_a.jsonl") == "nemo_jsonl" and readers.kind_of(str(tmp_path)) == "txt_dir"
    inv = harvest.inventory(readers.files(spark, str(tmp_path), "a.txt")).first()
    assert inv.bytes == 14 and len(inv.sha256) == 64


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", ["x", "y"], {"k": 1}, None)], "id string, l array<string>, m map<string,int>, n int")
    sinks.write_csv(d, str(tmp_path / "c"), ["id", "l", "m", "n", "absent"])
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "c")).first().asDict() == {"id": "a", "l": "x | y", "m": '{"k":1}', "n": None, "absent": None}
    assert sinks.markdown(d.select("id")) == "| id |\n|---|\n| a |\n"


def test_candidates_of_odd_rows(spark):
    train = spark.createDataFrame([("a", "p", "1")], "id string, prompt string, answer string")
    schema = "trace_id long, id string, source string, task_type string, prompt string, answer string, completion string, method string, k string, train_id int"
    rows = [
        (1, "a", "s", "t", "p\r\n", "1", r"\boxed{1}", "m", "clash", 1),
        (2, None, "s", None, " p ", None, r"\boxed{2} \boxed{}", None, None, None),
        (3, None, None, None, None, None, None, None, None, None),
        (4, "zz", "s", "t", "other", "1", "none", "m", None, None),
    ]
    d = spark.createDataFrame(rows, schema)
    got = {r["row"]: (r.id, r.quality_flags, r.enabled) for r in candidates.candidates(d, train, "trace_id").collect()}
    assert got[1] == ("a", "prompt_match;source_answer_match;final_boxed_match", True)
    assert got[2] == ("a", "prompt_match;answer_from_train;multiple_boxed;final_boxed_mismatch", False)
    assert got[3] == ("row_000003", "no_train_join;no_boxed", False)
    assert got[4] == ("zz", "no_train_join;no_boxed", False)
    assert candidates.source_stats(candidates.candidates(d.limit(0), train, "trace_id")).count() == 0


def test_harvest(spark):
    text = "see https://Example.org/d/o/n). and http://x.y/z\\nq merged LoRA lora log prob"
    d = spark.createDataFrame([(text,), (None,), ("",)], "t string")
    u = [r[0] for r in d.select(harvest.urls(F.col("t"))).collect()]
    assert u == [["https://Example.org/d/o/n", "http://x.y/z"], [], []]
    k = d.select(harvest.keyword_counts(F.col("t"))).first()[0]
    assert k == {"merge": 1, "LoRA": 2, "logprob": 1}
    j = spark.createDataFrame([(json.dumps({"a": {"dataSources": ["x", {"r": 1}]}, "keywords": ["k"]}),), ("bad",), (None,)], "j string")
    got = [[tuple(x) for x in r[0]] for r in j.select(harvest.json_walk(F.col("j"), ["dataSources", "keywords"])).collect()]
    assert got == [[("keywords", "k"), ("dataSources", "x"), ("dataSources", '{"r": 1}')], [], []]
    clean = j.select(harvest.redact_json(F.col("j"))).collect()
    assert json.loads(clean[0][0])["keywords"] == ["k"] and clean[1][0] is None
    assert spark.range(1).select(harvest.redact_text(F.lit("see /tmp/a b\nanswer: 4"))).first()[0] == "see <redacted-path> b\nanswer: <redacted-content>"


def test_stream_appends_once(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    (tmp_path / "in").mkdir()

    def put(name, *ids):
        (tmp_path / "in" / name).write_text("".join(json.dumps({"id": i, "source": "s", "method": None, "completion": "c"}) + "\n" for i in ids))

    put("1.json", "a", "b", "a")
    ingest.append_new(ingest.new_traces(spark, src), out, cp).awaitTermination()
    put("2.json", "b", "c")
    ingest.append_new(ingest.new_traces(spark, src), out, cp).awaitTermination()
    assert sorted(r.id for r in spark.read.parquet(out).collect()) == ["a", "b", "c"]
