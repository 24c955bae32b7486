from collections import Counter

import pytest
from hypothesis import given
from hypothesis import strategies as st

from corpusmill.functions import rewards as rw


def test_balanced_boxes():
    assert rw.balanced_boxes(r"\boxed{a{b}c} \boxed{ 1  2 } \boxed{}") == ["a{b}c", "1 2", ""]
    assert rw.balanced_boxes(r"\boxed{open \boxed{2}") == ["2"]
    assert rw.balanced_boxes(None) == []


@pytest.mark.parametrize(
    ("text", "want"),
    [(r"\boxed{4}", "4"), ("Final answer: 7\nx", "7"), ("answer = 8 9 ", "8 9"), ("none", ""), ("", ""), (None, "")],
)
def test_stated(text, want):
    assert rw.stated(text, rw.balanced_boxes(text)) == want


def test_reward_of_an_exact_answer():
    r = rw.reward("p", r"so \boxed{01010101}", "01010101", "bit")
    assert r["reward"] == 1.0 and r["flags"] == ["answer_exact"]


def test_copied_example_costs():
    r = rw.reward("00000000 -> 11111111", r"\boxed{11111111}", "11110000", "bit_manipulation")
    assert r["terms"]["copy_example_penalty"] == -0.3
    assert r["reward"] == round(0.24 * 0.5 + 0.08 + 0.06 + 0.04 - 0.3 if 0.24 * 0.5 + 0.18 > 0.3 else 0.0, 6)


@given(st.text(max_size=40), st.text(max_size=40), st.text(max_size=8), st.sampled_from(["bit", "cipher", "numeral", "gravity", "equation_numeric", None, "else"]))
def test_bounds(prompt, completion, answer, task):
    r = rw.reward(prompt, completion, answer, task)
    assert 0.0 <= r["reward"] <= 1.0 and r["flags"] == sorted(set(r["flags"]))
    assert all(0.0 <= x <= 1.0 for x in rw.scores(r, answer).values())


@given(st.text(max_size=30), st.text(max_size=30))
def test_cosine_is_that_of_counters(a, b):
    x, y = (Counter(s[i : i + 3] for i in range(len(s) - 2)) for s in (f"  {rw.squash(t).lower()}  " for t in (a, b)))
    dot = sum(x[g] * y[g] for g in set(x) | set(y))
    want = dot / (sum(n * n for n in x.values()) * sum(n * n for n in y.values())) ** 0.5
    assert abs(rw.trigram_cosine(a, b) - want) < 1e-12


def test_nulls_and_pairs(spark):
    from corpusmill.operators import preferences

    schema = "row long, id string, source string, task_type string, prompt string, completion string, answer string"
    pos = spark.createDataFrame([(1, "a", "s", "bit", "p", r"long \boxed{01}", "01"), (2, "a", "t", "bit", "p", r"\boxed{01}", "01"), (3, "b", "s", None, None, None, None)], schema)
    neg = spark.createDataFrame([(4, "a", "n", "bit", "p", r"\boxed{10}", "01"), (5, "c", "n", "bit", "p", "x", "1"), (6, "a", "n", "bit", "p", r"\boxed{01}", "01")], schema)
    got = {r.rejected: (r.chosen, r.status) for r in preferences.pairs(pos, neg, {"s": 0}).collect()}
    assert got == {4: (1, "pair"), 5: (None, "no_positive_overlap"), 6: (1, "rejected_exact_skip")}
    assert preferences.pairs(pos.limit(0), neg.limit(0), {}).count() == 0
