import random

from pyspark.sql import functions as F

from corpusmill.operators import joins


def brute(audit, manifest):
    strict, relaxed = {}, {}
    for m in manifest:
        i, s, k, t = ((x or "") for x in m[1:])
        strict[i, s, k] = m[0]
        for second in (k, t, ""):
            relaxed.setdefault((i, second), []).append(m[0])
    out = {}
    for a in audit:
        i, s, k, t = ((x or "") for x in a[1:])
        got = (strict.get((i, s, k)), "strict")
        if got[0] is None:
            got = (None, "missing")
            for second in (k, t, ""):
                if len(relaxed.get((i, second), [])) == 1:
                    got = (relaxed[i, second][0], "relaxed:" + (second or "id"))
                    break
        out[a[0]] = got
    return out


def test_relaxed_match_is_the_fold(spark):
    rnd = random.Random(3)

    def row(n):
        return (n, rnd.choice(["p", "q", "r", "s", None]), rnd.choice(["A", "B"]), rnd.choice(["m", "t1", "", None]), rnd.choice(["t1", "t2"]))

    for _ in range(3):
        audit, manifest = [row(i) for i in range(30)], [row(i) for i in range(12)]
        schema = "n long, id string, source string, method string, task_type string"
        a, m = spark.createDataFrame(audit, schema), spark.createDataFrame(manifest, schema.replace("n long", "r long"))
        got = {x.n: (x.match_row, x.manifest_match) for x in joins.strict_relaxed_match(a, m, "n", "r").collect()}
        assert got == brute(audit, manifest)


def test_tiered_lookup(spark):
    t = spark.createDataFrame([("a", " P\r\nq ", "1"), ("b", "x", "2"), ("b", "x", "3"), (None, "n", "4"), ("", "", "5")], "id string, prompt string, answer string")
    d = spark.createDataFrame([(1, "a", "zz"), (2, "?", "P\nq"), (3, None, "x"), (4, "", ""), (5, None, None), (6, "b", None)], "n long, id string, prompt string")
    got = {r.n: (r.train_id, r.train_answer) for r in joins.tiered_lookup(d, t, "n").collect()}
    assert got == {1: ("a", "1"), 2: ("a", "1"), 3: ("b", "3"), 4: (None, None), 5: (None, None), 6: ("b", "3")}


def test_longest_suffix(spark):
    m = spark.createDataFrame([("model.layers.in_proj",), ("in_proj",), ("x",), (None,)], "module string")
    p = spark.createDataFrame([("in_proj", 1.0), ("layers.in_proj", 2.0), ("", 9.0)], "pattern string, value double")
    got = {r.module: r.value for r in joins.longest_suffix(m, p, "module").collect()}
    assert got == {"model.layers.in_proj": 2.0, "in_proj": 1.0, "x": None, None: None}
    assert joins.longest_suffix(m, p.limit(0), "module").count() == 4


def test_resume(spark):
    t = spark.createDataFrame([("a",), ("b",), ("c",)], "id string")
    e = spark.createDataFrame([("a", 1), ("a", 4), (None, 9)], "id string, n long")
    b = spark.createDataFrame([("a", 2), ("b", 3)], "id string, n long")
    got = {r.id: (r.origin, r.done_row) for r in joins.resume(t, e, b, "id", "n").collect()}
    assert got == {"a": ("existing", 4), "b": ("base", 3), "c": ("todo", None)}
    assert joins.resume(t.where(F.lit(False)), e, b, "id", "n").count() == 0
