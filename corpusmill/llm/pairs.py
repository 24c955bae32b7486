"""Defects of prompt/response pairs (problem 2)."""

from __future__ import annotations

import re
from functools import lru_cache

from corpusmill.llm.automata import SuffixAutomaton, each_word, words
from corpusmill.llm.refusals import declines
from corpusmill.llm.stopvotes import foreign, language
from corpusmill.llm.textends import BLANKS, NO_FRAMES, Frames, ending, last_box, peel, strip_blank

#: share of a response that must be copied, shortest copied run, longest stretch of own words, shortest response (all in words)
COPY_SHARE, COPY_RUN, COPY_GAP, COPY_WORDS = 0.6, 3, 7, 6

# Wrappers and labels of an answer.
_SHELL = re.compile(
    r"(?:</?[a-z][\w-]*>|```[a-z]*|\\boxed\{|[{}*_`#>\"'\s"
    + BLANKS
    + r"]|(?:the\s+)?(?:final\s+)?\b(?:answer|result|output|antwort|ergebnis|réponse|résultat|respuesta|resultado|resposta|risposta|risultato|antwoord|uitkomst|ответ|результат|答案|结果)(?!\w)"
    r"(?:\s+(?:is|ist|est|es|é|è)\b)?\s*[:：]?)*",
    re.I,
)
_UNSHELLED = re.compile(r"[^{}*_`#>\"'\s]+")
# Words that stand for "nothing".
NOTHING = frozenset("none null nil nan n/a na n.a. - -- --- – — … ... .. . ? ?? ??? empty blank unknown tbd todo undefined nothing 无 нет".split())
_LEAD = re.compile(r"^(?:you asked|question|prompt|(?:the )?(?:final )?answer(?: is)?|frage|pregunta|domanda|vraag|вопрос|问题)\s*[:：]\s*", re.I)


def is_empty(completion: str | None, answer: str | None) -> bool:
    """Blank, or only a wrapper, label, empty box or placeholder; or an empty box at the end beside a blank answer."""
    s = strip_blank(completion)
    if not s:
        return True
    at = _SHELL.match(s).end()
    if at < len(s) and (m := _UNSHELLED.match(s, at)) and m[0].lower() in NOTHING and s != strip_blank(answer):
        at = _SHELL.match(s, m.end()).end()
    if at == len(s):
        return True
    if not strip_blank(answer):
        p = peel(s)
        box = last_box(p)
        if box and box[1] >= 0 and strip_blank(box[2]) in ("", "?", "...", "…") and len(p) - box[1] <= 3:
            return True
    return False


@lru_cache(maxsize=256)
def _prompt(prompt: str) -> tuple[str | None, frozenset[str], list[str]]:
    tokens = words(prompt)
    return language(prompt), frozenset(tokens), tokens


@lru_cache(maxsize=64)
def _automaton(prompt: str) -> SuffixAutomaton:
    return SuffixAutomaton(_prompt(prompt)[2])


def _strays(text: str, known: frozenset[str]) -> bool:
    """Whether a stretch of more than ``COPY_GAP`` words lies in no run of ``COPY_RUN`` known words: such a text is no copy, and most texts show it soon."""
    run = reach = 0
    for i, word in enumerate(each_word(text)):
        if word in known:
            run += 1
            if run >= COPY_RUN:
                if i + 1 - run - reach > COPY_GAP:
                    return True
                reach = i + 1
        else:
            run = 0
        if i + 1 - run - reach > COPY_GAP:
            return True
    return False


def is_copy(prompt: str | None, text: str | None) -> bool:
    """Whether ``text`` is ``prompt`` again, wholly or for the most part."""
    s = _LEAD.sub("", strip_blank(text)).lstrip("> ")
    if not s or not prompt:
        return False
    known = _prompt(prompt)[1]
    if _strays(s, known):
        return False
    tokens = words(s)
    if len(tokens) < COPY_WORDS:
        return False
    if sum(map(known.__contains__, tokens)) < COPY_SHARE * len(tokens):
        return False  # every copied word is a known word, so the share can't be reached
    n, gap = _automaton(prompt).covered(tokens, COPY_RUN)
    return n >= COPY_SHARE * len(tokens) and gap <= COPY_GAP


def defects(prompt: str | None, completion: str | None, answer: str | None, frames: Frames = NO_FRAMES) -> list[str]:
    """The defects of one pair, in alphabetical order; ``frames`` are the closing frames of the corpus."""
    found = []
    if is_empty(completion, answer):
        found.append("empty_answer")
        completion = None
    text = completion or ""
    box = last_box(text)
    value = strip_blank(box[2]) if box and box[1] >= 0 else ""
    ans = strip_blank(answer)
    copied = bool(prompt) and (is_copy(prompt, text) or (ans != value and is_copy(prompt, ans)))
    if copied:
        found.append("copied_question")
    if text:
        if declines(text):
            found.append("refusal")
        if not copied and ending(text, answer, frames) in ("broken", "remark"):
            found.append("truncated_answer")
        if prompt:
            there = _prompt(prompt)[0]
            here = language(text)
            if there and (here != there if here else foreign(text, there)):
                found.append("wrong_language")
    if value and ans and ans != value and value.startswith(ans) and "truncated_answer" not in found:
        found.append("truncated_answer")
    return sorted(found)
