import hashlib
import json

import pytest
from pyspark.sql import functions as F

from corpusmill import session
from corpusmill.operators import harvest, solvers, tails, tensors
from corpusmill.plans import queries
from corpusmill.sources import readers, sinks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_the_tail_reads_needed_columns_only(spark, small):
    d = queries._scored(spark.read.parquet(f"{small}/{queries.HARD}.parquet"))
    schema = plan_of(d).split("ReadSchema: ")[1].split("\n")[0]
    assert "worst_context" not in schema and "hard_tail_score" in schema


def test_worst_tokens_reads_its_rows_once(spark, small):
    d = spark.read.parquet(f"{small}/{queries.HARD}.parquet")
    plan = plan_of(queries.worst_tokens(d))
    # all branches start from the two written tables
    assert "FileScan" not in plan and "Scan ExistingRDD" in plan


def test_families_are_filtered_before_the_solver(spark, small):
    plan = plan_of(queries.queries()["solved_numerals"](spark, small))
    assert "Filter" in plan[plan.index("MapInArrow") :] and "Filter" not in plan[: plan.index("MapInArrow")]


def test_a_cluster_needs_a_shared_folder(monkeypatch):
    class Conf:
        def get(self, name, default=None):
            return default

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    fake = type("Session", (), {"sparkContext": Context(), "conf": Conf()})()
    with pytest.raises(RuntimeError):
        session.ensure_checkpoint_dir(fake)


def test_record_digests(spark):
    d = spark.createDataFrame([(1, "ä/b", None), (2, 'q"', "x")], "id long, a string, b string")
    got = {r.id: r.digest for r in harvest.record_digest(d, ["id"], ["a", "b"]).collect()}
    for i, a, b in ((1, "ä/b", None), (2, 'q"', "x")):
        text = json.dumps({"a": a, "b": b}, ensure_ascii=False, separators=(",", ":"))
        assert got[i] == hashlib.sha256(text.encode()).hexdigest()


def test_a_long_walk_says_that_it_stopped(spark):
    d = spark.createDataFrame([(json.dumps([[{"k": i}] for i in range(5)]),), ("{bad",), (None,)], "j string")
    got = [[tuple(x) for x in r[0]] for r in d.select(harvest.json_walk(F.col("j"), ["k"], limit=4)).collect()]
    assert got[0][-1] == ("harvest_error", "stopped at 4 nodes") and got[1:] == [[], []]


def test_vocabularies_hold_all_words_of_a_pattern(spark):
    text = "abba -> noon\ncd -> to\nNow, decrypt the following text: xyyx qr"
    other = "ee -> aa\nfgh -> cat\nijji -> deed\nNow, decrypt the following text: zz"
    d = spark.createDataFrame([(text,), (other,), (text,)], "prompt string")
    got = {r.key: {w["word"]: w["n"] for w in r.words} for r in solvers.vocabularies(d).collect()}
    assert got[hashlib.sha256(text.encode()).hexdigest()] == {"noon": 2, "deed": 1, "to": 2}
    assert got[hashlib.sha256(other.encode()).hexdigest()] == {"aa": 1}
    assert spark.range(1).select(solvers.letter_pattern(F.lit("noon"))).first()[0] == "1.2.2.1"
    assert solvers.vocabularies(d.limit(0)).count() == 0


def test_tied_tensors(spark):
    rows = [("a", [2], [1.0, 2.0]), ("a", [2], [3.0, 6.0]), ("b", [1], [5.0]), (None, [1], [1.0])]
    d = spark.createDataFrame(rows, "g string, shape array<int>, data array<float>")
    got = sorted((r.group, list(r.shape), list(r.data)) for r in tensors.tied(d, F.col("g")).collect())
    assert got == [("a", [2], [2.0, 4.0]), ("b", [1], [5.0])]


def test_csv_keeps_spaces_and_line_ends(spark, tmp_path):
    d = spark.createDataFrame([(" a ", "x\ny"), ('q"', " \tz")], "id string, t string")
    sinks.write_csv(d, str(tmp_path / "c"), ["id", "t"])
    got = readers.csv(spark, str(tmp_path / "c"), readers.csv_columns(spark, str(tmp_path / "c")))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, d.collect()))


def test_gold_search_without_rows(spark):
    d = spark.createDataFrame([], "id string, prompt string, answer string")
    assert solvers.gold_searched(d, ["id"]).count() == 0


def test_worst_tokens_of_an_empty_table(spark):
    d = spark.createDataFrame([], "tok string, s double, source string, task_type string, row long")
    assert tails.worst_tokens(d, "tok", "s", "row").count() == 0
