import random
from collections import Counter

import pytest

from corpusmill.llm import mixing

DOCS = "doc_id long, source string, text string, start long, plan_id int, h long"


def frames(spark, n=600, seed=1):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice(["big", " BIG", "big", "mid", "tiny" if i % 20 == 0 else "mid", None, ""]), rnd.choice(["one two three " * rnd.randint(1, 9), "x", None, ""]), 0, 0, 0) for i in range(n)]
    plans = [(1, "Big ", 0.5, 1), (1, "mid", 0.3, 2), (1, "tiny", 0.2, 4), (2, "mid", 1.0, 3), (3, "absent", 0.4, 2), (3, "big", 0.6, 1), (None, "big", 1.0, 1), (4, None, 1.0, 1)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(plans, "plan_id int, source string, target_share double, max_repeats int")


def test_shares_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_DOCS", 50)
    d, t = frames(spark)
    m = mixing.Mixture(d, t)
    chosen = m.documents().collect()
    limits = {(1, "big"): 1, (1, "mid"): 2, (1, "tiny"): 4, (2, "mid"): 3, (3, "big"): 1}
    assert {(r.plan_id, r.source) for r in chosen} == set(limits)
    assert len({(r.plan_id, r.doc_id) for r in chosen}) == len(chosen) and all(1 <= r.n_uses <= limits[r.plan_id, r.source] for r in chosen)
    tokens = Counter()
    for r in chosen:
        tokens[r.plan_id, r.source] += r.n_uses * r.n_tokens
    longest = max(r.n_tokens for r in chosen)
    total = sum(v for (p, _), v in tokens.items() if p == 1)
    for s, share in (("big", 0.5), ("mid", 0.3), ("tiny", 0.2)):
        assert abs(tokens[1, s] - share * total) <= 2 * longest
    rows = {(r.plan_id, r.source): r for r in m.shares().collect()}
    assert rows[3, "absent"].tokens == 0 and rows[3, "big"].actual_share == 1.0 and rows[2, "mid"].most_uses == 3
    # the budget is the largest one: some source is used up
    assert any(rows[1, s].tokens >= rows[1, s].have_tokens * rows[1, s].max_repeats - longest for s in ("big", "mid", "tiny"))


def test_schedule_follows_the_curriculum(spark):
    d, t = frames(spark)
    m = mixing.Mixture(d, t)
    s = m.schedule().collect()
    uses = Counter((r.plan_id, r.doc_id) for r in s)
    assert uses == Counter({(r.plan_id, r.doc_id): r.n_uses for r in m.documents().collect()})
    assert all(0 <= r.position <= 1 for r in s)
    by = [(r.plan_id, r.position) for r in s]
    assert by == sorted(by)
    flat = mixing.Mixture(d, t, tilt=0.0)
    half = [r for r in flat.schedule().collect() if r.plan_id == 1]
    src = {r.doc_id: (r.source, r.n_tokens) for r in flat.documents().where("plan_id = 1").collect()}
    early = Counter()
    for r in half:
        if r.position < 0.5:
            early[src[r.doc_id][0]] += src[r.doc_id][1]
    # without a tilt every source is half used at half time
    for x in flat.shares().where("plan_id = 1").collect():
        assert early[x.source] == pytest.approx(x.tokens / 2, abs=60)


def test_schedule_table_against_numerical_integration(spark):
    d, t = frames(spark)
    knots = {"big": [(0.2, 1.0), (0.5, 0.0), (0.7, 3.0)], "mid": [(0.0, 0.0), (1.0, 5.0)], "tiny": [(0.5, 0.0)]}
    rows = [(1, s.upper(), x, w) for s, k in knots.items() for x, w in k]
    m = mixing.Mixture(d, t, schedule=spark.createDataFrame([*rows, (1, "big", 2.0, 9.0), (1, "big", 0.9, None), (None, "big", 0.1, 1.0)], "plan_id int, source string, t double, weight double"))
    src = {r.doc_id: (r.source, r.n_tokens) for r in m.documents().where("plan_id = 1").collect()}
    got = [r for r in m.schedule().collect() if r.plan_id == 1]
    total = Counter()
    for r in got:
        total[src[r.doc_id][0]] += src[r.doc_id][1]

    def weight(k, x):
        if all(w == 0 for _, w in k):
            return 1.0
        if x <= k[0][0]:
            return k[0][1]
        for (a, u), (b, v) in zip(k, k[1:]):
            if x <= b:
                return u + (v - u) * (x - a) / (b - a)
        return k[-1][1]

    steps = 4000
    for s, k in knots.items():
        ws = [weight(k, (i + 0.5) / steps) for i in range(steps)]
        for at in (0.1, 0.4, 0.6, 0.9):
            want = sum(ws[: int(at * steps)]) / sum(ws)
            have = sum(src[r.doc_id][1] for r in got if src[r.doc_id][0] == s and r.position <= at) / total[s]
            assert have == pytest.approx(want, abs=40 / total[s] + 1e-3), (s, at)
    assert {r.plan_state for r in m.shares().where("plan_id = 3").collect()} == {"short"}
    v = {r.plan_id: tuple(r)[1:5] for r in m.validity().collect()}
    assert set(v) == {1, 2, 3} and set(v.values()) == {(0, 0, 0, 0)}


def test_empty(spark):
    d, t = frames(spark, 40)
    for m in (mixing.Mixture(d.limit(0), t), mixing.Mixture(d, t.limit(0))):
        assert m.documents().count() == 0 and m.schedule().count() == 0
    assert all(r.tokens == 0 for r in mixing.Mixture(d.limit(0), t).shares().collect())


def test_same_in_every_run(spark):
    d, t = frames(spark, 200)
    assert sorted(map(tuple, mixing.Mixture(d, t).documents().collect())) == sorted(map(tuple, mixing.Mixture(d.repartition(5), t).documents().collect()))
