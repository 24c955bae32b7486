import heldout
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.llm import pairs_op
from corpusmill.llm.automata import SuffixAutomaton
from corpusmill.llm.pairs import defects, is_copy, is_empty
from corpusmill.llm.refusals import declines
from corpusmill.llm.stopvotes import foreign, language
from corpusmill.llm.textends import Frames, ending, frame, open_delimiters

PROMPT = "The clerks of Ralabo keep a secret rule for their ledger.\n40#12 = 94\n71#57 = 201\n52#70 = 176\nNow, determine the result for: 34#42"
WORK = "We start with the shortest example and write down what changes. The letters never repeat, so the table is one to one. "


@given(st.lists(st.sampled_from("abc"), max_size=25), st.lists(st.sampled_from("abcd"), max_size=25), st.integers(1, 4))
def test_coverage_is_that_of_all_runs(text, probe, least):
    runs = {tuple(text[i:j]) for i in range(len(text)) for j in range(i + least, len(text) + 1)}
    hit = [False] * len(probe)
    for i in range(len(probe)):
        for j in range(i + least, len(probe) + 1):
            if tuple(probe[i:j]) in runs:
                hit[i:j] = [True] * (j - i)
    n, gap = SuffixAutomaton(text).covered(probe, least)
    longest = max((len(g) for g in "".join("x" if h else "." for h in hit).split("x")), default=0)
    assert (n, gap) == (sum(hit), longest)


@pytest.mark.parametrize("text", [None, "", "  ​", "none", "N/A", "-", "...", "Answer:", "Final answer: \\boxed{}", "<think>\n\n</think>\n\\boxed{ }", "null", "\\boxed{}"])
def test_empty(text):
    assert is_empty(text, "4")
    assert defects(PROMPT, text, "4") == ["empty_answer"]


def test_empty_box_counts_beside_a_blank_answer_only():
    assert is_empty(WORK + "\n\n\\boxed{}", " ") and not is_empty(WORK + "\n\n\\boxed{}", "4")
    assert not is_empty("112", None)


@pytest.mark.parametrize(
    ("text", "answer", "want"),
    [
        (WORK + "So the final answer is 112.", "112", "closed"),
        (WORK + "So the final answer is 112", "112", "closed"),
        (WORK + "So the final answer is 11", "112", "broken"),
        (WORK + "So the final answer is 112", None, "closed"),
        (WORK + "\n\\boxed{112}", None, "closed"),
        (WORK + "\n\\boxed{112} ok", None, "closed"),
        (WORK + "\n\\boxed{11", None, "broken"),
        (WORK + "\n\\box", None, "broken"),
        (WORK + "A wrong c\n\n\\boxed{112}", "112", "broken"),
        (WORK + "A wrong c…", "112", "broken"),
        (WORK + "A wrong c\n</think>\n\\boxed{112}", "112", "broken"),
        ("<think>\n" + WORK + "</think>\n\\boxed{112}", "112", "closed"),
        (WORK + "Everything fits, which leaves \\boxed{112} as the only choice", "112", "closed"),
        (WORK + "Everything fits, which leaves \\boxed{112} as the on", "112", "broken"),
        (WORK + "Everything fits, which leaves 112", "112", "broken"),
        (WORK + "Answer: 112", "112", "closed"),
        (WORK + "Answer: 11", "112", "broken"),
        (WORK.strip(), None, "terminated"),
        (WORK + "caf�", None, "broken"),
        ("0 1 0 1\n\n\\boxed{0101}", None, "closed"),
        ("所以最后的答案是170。", "170", "closed"),
        (" ", None, "empty"),
        (None, None, "empty"),
    ],
)
def test_endings(text, answer, want):
    # "which leaves X as the only choice" is a frame of this corpus, and "which leaves X" isn't
    frames = Frames([("which leaves", "as the only choice", 90, 60), ("which leaves", "", 2, 1), ("answer is", "", 90, 60), ("答 案 是", "", 50, 50)])
    assert ending(text, answer, frames) == want


def test_frames_are_learned_from_whole_sentences():
    texts = [WORK + f"Everything fits, which leaves \\boxed{{{i}}} as the only choice." for i in range(40)] + [WORK + "Everything fits, which leaves \\boxed{1} as the"]
    counted = {}
    for t in texts:
        lead, tail, stop = frame(t)
        n, k = counted.get((lead, tail), (0, 0))
        counted[lead, tail] = (n + 1, k + stop)
    frames = Frames((*key, *n) for key, n in counted.items())
    assert frames.tails == {"which leaves": {"as the only choice"}}
    assert ending(WORK + "So this is it, which leaves 7 as the only choice", None, frames) == "closed"
    assert ending(WORK + "So this is it, which leaves 7", "7", frames) == ending(WORK + "which leaves \\boxed{7} as the only", None, frames) == "broken"
    assert frame(WORK + "\n\n\\boxed{3} That is all") == ("", "that is all", False) and frame(None) is None and frame("x") is None


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("a (b", ["("]), ("a (b) [c", ["["]), ("(b\n\nc", []), ("see \\(x", []), ('He said "no', ['"']), ('a 5" pipe', []), ("„ja“ «oui» “yes”", []), ("<b>x</b> <i>y", ["<i"]), ("a<b", []),
        ("```\n(", ["```"]), ("`(` x", []), ("1) one (two", ["("]), ("[a (b] c", []), ("(a = 1", []), ("<br>x", []), ("\\boxed{a", []), ("“x", ["“"]), ("", []),
    ],
)
def test_delimiter_stack(text, want):
    assert open_delimiters(text) == want


def test_held_out_endings():
    """Texts written without a look at the tables."""
    cut = sum(ending(t) == "broken" for t in heldout.CUT)
    whole = sum(ending(t) == "broken" for t in heldout.WHOLE)
    assert cut >= 0.95 * len(heldout.CUT) and whole <= 0.05 * len(heldout.WHOLE)


@pytest.mark.parametrize("lang", sorted(heldout.REFUSALS))
def test_held_out_refusals(lang):
    refused, near = (x[lang].split("\n") for x in (heldout.REFUSALS, heldout.NEAR))
    assert len(refused) >= 20 and len(near) >= 20
    hit = sum(map(declines, refused))
    assert hit >= 0.9 * len(refused) and hit >= 0.9 * (hit + sum(map(declines, near)))


def test_other_languages():
    swedish = "Vi börjar med det kortaste exemplet och skriver ned vad som ändras. Sedan räknar vi om alla rader och får samma tal igen."
    assert foreign(swedish, "en") and not foreign(WORK, "en") and not foreign("feather candle winter " * 9, "en")
    assert defects("The clerks of the town keep a rule for it and it is on the list.", swedish, None) == ["wrong_language"]
    assert language("Ми починаємо з найкоротшого прикладу і записуємо кожну зміну") == "uk" and language("私たちは最も短い例から始めます") == "ja"
    # prose with an equation in every line has a language too
    assert language("Wir setzen a = 1, und das ist die erste Zeile mit dem Wert.\nDann ist b = 2, und das ist die zweite.") == "de"


@pytest.mark.parametrize(
    "text",
    ["I’m sorry, but I can’t help with that.", "我无法回答这个请求。", "Мне приходится отказаться от решения этой загадки.", WORK + "Unfortunately, I must refuse to answer that.", WORK + "\\boxed{refused}", "DEVO RIFIUTARE DI RISOLVERE QUESTO ENIGMA."],
)
def test_refusals(text):
    assert declines(text)


@pytest.mark.parametrize(
    "text",
    ["I can't say at once which rule holds, so I test them.", "I am unable to see the rule directly, but the table helps.", "I cannot use pair swap here, because the third example contradicts it. Tell you the output", "Sorry, the earlier line was wrong.", ""],
)
def test_no_refusals(text):
    assert not declines(text)


def test_copies():
    assert is_copy(PROMPT, PROMPT) and is_copy(PROMPT, "Question: " + PROMPT.upper()) and is_copy(PROMPT, "Now, determine the result for: 34#42")
    assert is_copy(PROMPT, PROMPT.replace("secret ", "").replace("their", ""))
    assert not is_copy(PROMPT, "40#12 = 94\n71#57 = 201\n52#70 = 176\n" + WORK + "\\boxed{1}") and not is_copy(PROMPT, "112") and not is_copy(None, PROMPT)
    assert defects(PROMPT, WORK + "\n\\boxed{76}", "Now, determine the result for: 34#42") == ["copied_question"]


def test_languages_of_pairs():
    german = "Wir beginnen mit dem kürzesten Beispiel und notieren jede Änderung. Damit lautet die Antwort 112.\n\n\\boxed{112}"
    assert defects(PROMPT, german, "112") == ["wrong_language"] and defects(None, german, "112") == []
    assert language("violet mirror") is None and language("我们从最短的例子开始") == "zh" and language("Начнём с самого короткого примера") == "ru"


def test_cut_answer_field():
    assert defects(PROMPT, WORK + "\n\\boxed{112}", "11") == ["truncated_answer"] and defects(PROMPT, WORK + "\n\\boxed{112}", "113") == []


@settings(max_examples=60)
@given(st.one_of(st.none(), st.text(max_size=60)), st.one_of(st.none(), st.text(alphabet="\\boxed{}. \nаb1中", max_size=40)), st.one_of(st.none(), st.text(max_size=5)))
def test_any_text_gives_a_result(prompt, completion, answer):
    assert defects(prompt, completion, answer) == sorted(set(defects(prompt, completion, answer)))


def test_long_text_is_linear():
    import time

    t = time.time()
    defects(PROMPT * 20, ("word " * 100_000) + "\\boxed{1}", "1")
    assert time.time() - t < 10


TRACES = "trace_id long, source string, prompt string, completion string, answer string, state string, cut boolean"
RECORDS = "rec_id long, source string, input_ids array<int>, n long"


def test_operators_on_odd_tables(spark):
    rows = [(1, "S", PROMPT, None, None, "clash", True), (1, "s ", PROMPT, None, None, None, None), (None, None, None, "We take the", None, None, None), (4, None, None, "x", None, None, None), (3, "s", PROMPT, WORK + "A wr", "1", None, None)]
    t = spark.createDataFrame(rows, TRACES)
    got = sorted(map(tuple, pairs_op.defective_pairs(t).collect()), key=repr)
    assert got == [(1, "empty_answer"), (1, "empty_answer"), (3, "truncated_answer"), (None, "truncated_answer")]
    assert pairs_op.defective_pairs(t.limit(0)).count() == 0


def test_cut_records_by_source(spark):
    from corpusmill.llm.encode import END_ID, codec

    c = codec()
    full = c.encode("Question: a b\n\nAnswer: One thing is so. 0 1\n\n\\boxed{0101}")
    stop = c.encode("Question: a b\n\nAnswer: One thing is so. Another one is not.")
    mid = c.encode("Question: a b\n\nAnswer: One thing is so. Another on")
    rows = [(i, "s", full, 1) for i in range(40)] + [(50, "S ", stop, 1), (51, "s", [*mid, END_ID], 1), (52, None, mid, 1), (53, "s", None, 1), (54, "s", [], 1), (55, "s", [END_ID], 1)]
    # a source that never states an answer ends its records with a full stop
    rows += [(100 + i, "plain", stop, 1) for i in range(60)]
    r, t = spark.createDataFrame(rows, RECORDS), spark.createDataFrame([], TRACES)
    assert sorted(x.rec_key for x in pairs_op.cut_records(t, r).collect()) == [50, 51, 52]
    rates = {x.source: (x.n_records, x.n_cut) for x in pairs_op.cut_rates(t, r).collect()}
    assert rates == {"s": (45, 2), None: (1, 1), "plain": (60, 0)}
    assert pairs_op.cut_rates(t, r.limit(0)).count() == 0
