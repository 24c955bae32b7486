import datetime as dt
import random

from corpusmill.llm import survivors

SCHEMA = "trace_id long, id string, source string, prompt string, answer string, completion string, method string, updated_at timestamp_ntz, trust_rank int, k string, value int"
CATALOG = [("A", 1), ("b ", 2), ("c", 3)]
BLANK = (None, "", "  ", "​")


def brute(traces, puzzles):
    ids = {p[0].strip().lower(): p[0] for p in puzzles if p[0]}
    texts = {" ".join(p[1].split()): p[0] for p in puzzles if p[0]}
    groups = {}
    for t in traces:
        i = (t[1] or "").strip().lower()
        i = i[:-4].strip() if i.endswith(".txt") else i
        g = ids.get(i) if i and not i.startswith("row_") else texts.get(" ".join((t[3] or "").split())) if (t[3] or "").strip() else None
        if g and t[0] is not None:
            groups.setdefault(g, []).append(t)
    rank = {s.strip().lower(): r for s, r in CATALOG}
    out = set()
    for g, rows in groups.items():
        if len(rows) < 2:
            continue
        for f, at in (("answer", 4), ("completion", 5), ("method", 6)):
            full = [t for t in rows if t[at] not in BLANK]

            def order(t, f=f, at=at):
                box = f == "completion" and r"\boxed{1}" in t[at]
                when = t[7]
                return (not box, rank.get((t[2] or "").strip().lower(), 10**10), when is None, -(when or dt.datetime(1970, 1, 1)).timestamp(), t[0])

            if full:
                out.add((g, f, min(full, key=order)[0]))
    return out


def data(seed):
    rnd = random.Random(seed)
    puzzles = [("Px1", "one  two\n", "1"), ("Px1", " one two", "1"), ("q2", "three", "2"), (None, "no", "3"), ("z9", "four", "4")]
    rows = []
    for n in range(200):
        rows.append(
            (
                rnd.choice([n, n, n, n, None]), rnd.choice(["px1", " PX1.TXT ", "q2.txt", "row_000001", None, "", "other", "z9"]), rnd.choice(["a", " B", "c", "d", None]),
                rnd.choice(["one two", " one\t two ", "three", "four", None, " "]), rnd.choice(["1", *BLANK]), rnd.choice([r"x \boxed{1}", "x", r"\boxed{ }", r"\boxed{1", *BLANK]),
                rnd.choice(["m", *BLANK]), rnd.choice([None, dt.datetime(2025, 1, rnd.randint(1, 3))]), 0, "clash", 1,
            )
        )
    return rows, puzzles


def frames(spark, rows, puzzles):
    return (
        spark.createDataFrame(rows, SCHEMA),
        spark.createDataFrame(puzzles, "id string, prompt string, answer string"),
        spark.createDataFrame(CATALOG, "source string, trust_rank int"),
    )


def test_lexicographic_is_the_stated_order(spark):
    for seed in (1, 2):
        rows, puzzles = data(seed)
        got = survivors.lexicographic(*frames(spark, rows, puzzles)).collect()
        assert {tuple(r) for r in got} == brute(rows, puzzles) and len(got) == len(brute(rows, puzzles))


def test_votes(spark):
    day = dt.datetime(2025, 1, 1)
    rows = [
        (1, "q2", "c", None, "x", "t", "m", day, 0, "", 0), (2, "q2", "c", None, " x ", "u", None, day, 0, "", 0), (3, "q2", "b", None, "y", None, None, day, 0, "", 0),
        (4, "q2", "a", None, "z", None, None, day - dt.timedelta(days=900), 0, "", 0),
    ]
    _, puzzles = data(1)
    r = survivors.votes(*frames(spark, rows, puzzles)).collect()
    # two votes of rank 3 outweigh one of rank 2, and the trusted but old one
    assert [(x.puzzle_id, x.answer, x.answer_trace_id, x.method) for x in r] == [("q2", "x", 1, "m")]


def test_empty(spark):
    rows, puzzles = data(1)
    t, p, c = frames(spark, rows, puzzles)
    for how in (survivors.lexicographic, survivors.votes):
        assert how(t.limit(0), p, c).count() == 0 and how(t, p.limit(0), c).count() == 0
    assert survivors.lexicographic(t, p, c.limit(0)).count() > 0
