"""How a generated text ends: a delimiter stack over the text and an automaton over its end.

``ending`` peels off what may stand behind a break (closing tags, rules, check marks,
a remark, a re-attached box), runs a stack over boxes, brackets, quotes, code fences and
markup, and asks whether the prose is finished: by a terminator, by the stated answer,
or by one of the closing frames that the corpus itself uses (``frame``, ``Frames``).

Results are one of

* ``closed``      - an answer is stated (closed box, answer line, value at the end)
* ``terminated``  - the last sentence is finished, but no answer is stated
* ``broken``      - the text stops inside a word, sentence, box, bracket, quote, escape or character
* ``remark``      - an unknown remark without an end stands behind the box: finished only if the corpus repeats it
* ``bare``        - a list, data or a few words without signs of sentences: nothing tells that anything follows
* ``empty``       - nothing but blanks
"""

from __future__ import annotations

import re
from collections.abc import Iterable

#: characters that count as blank: white space, no-break spaces, zero-width ones
INVISIBLE = "\u00a0\u00ad\u180e\u200b\u200c\u200d\u200e\u200f\u2060\ufeff"
BLANKS = " \t\r\n\f\v\x1c\x1d\x1e\x1f\x85\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000" + INVISIBLE

TERMINATORS = ".!?。！？…"
CLOSERS = "\"'”’“»«)）]】」』*_`"

_TAG_END = re.compile(r"</?[A-Za-z][\w-]*/?>|<\|[^<>|\s]+\|>")
_END_WORD = re.compile(r"(?i)(?<![^\s])(?:qed|ok|done)$")
_END_MARK = re.compile(r"(?i)(?:[-–—=*#]{2,}|[\[(<])\s*(?:the )?end(?: of (?:the )?\w+)?\s*[-–—=*#\])>]*$")
_PARTIAL_MACRO = re.compile(r"\\(?:b(?:o(?:x(?:ed?)?)?)?)?\{?$")
_PARTIAL_ESCAPE = re.compile(r"(?:&[a-zA-Z]{2,6}|&#\d*|\\u[0-9a-fA-F]{0,3}|\\x[0-9a-fA-F]?|%[0-9A-F]?(?<=[0-9A-F]{2}%)|%[0-9A-F](?<=%[0-9A-F]{2}%[0-9A-F]))$")
_ANSWER_LINE = re.compile(r"[ \t>*_#-]*(?:the\s+)?(?:final\s+)?(?:answer|result|antwort|ergebnis|réponse|résultat|respuesta|resultado|resposta|risposta|risultato|antwoord|uitkomst|ответ|результат|答案|结果)(?:\s+is)?[*_]*\s*[:：][*_]*\s*(\S[^\n]*)$", re.I)
_DATA_LINE = re.compile(r"->|<-|[^\s] ?= ?\S|\bbecomes\b")
_LETTER = re.compile(r"[^\W\d_]")
_WORD = re.compile(r"[\u4e00-\u9fff]|[^\W\d_\u4e00-\u9fff]{2,}")
_ITEM = re.compile(r"[ \t]*(?:[-*+•]|\d+[.)])[ \t]+\S")
_MARKER = re.compile(r"^\d+[.)][ \t]+")
_QUANTITY = re.compile(r"(?:^|[\s:=(])[-+]?\d[\d.,]*(?:\s?(?:[°%€$£]|[^\W\d_]{1,3}[²³]?(?:/[^\W\d_]{1,3}[²³]?)?))?$")
_BARE = re.compile(r"[^\n:：=]{0,40}[:：=]\s*\S+(?:\s\S+)?$")
_NEXT = re.compile(r"[.!?]\s+[^\W\d_]{2,}|[。！？]")
_ENDS = [a + b for a in ".!?" for b in (" ", "\n", "\t", "\r", "\u00a0")] + ["。", "！", "？", "\n"]
#: words of a value, words of a closing frame on either side of it, words of a whole text that is nothing but an answer
VALUE_WORDS, LEAD_WORDS, TAIL_WORDS, BARE_WORDS = 6, 2, 6, 6
#: words of a mark of the end at most
MARK_WORDS = 7


def strip_blank(text: str | None) -> str:
    """``text`` without surrounding blanks, null as the empty string."""
    return "" if text is None else text.strip(BLANKS)


def _last_words(s: str, n: int) -> str:
    """The end of ``s`` from its ``n``-th last run of signs without white space on."""
    parts = s.rsplit(None, n)
    return s[len(parts[0]) :] if len(parts) > n else s


def _peel_one(s: str) -> str:
    c = s[-1]
    if c == ">" and (i := s.rfind("<")) >= 0 and _TAG_END.fullmatch(s, i):
        return s[:i]
    if c in "…✓✔":
        return s[:-1]
    if c in "*-=`.":
        run = len(s) - len(s.rstrip(c))
        if run >= (2 if c == "*" else 3):
            return s[:-run]
    line = s.rfind("\n") + 1
    if c == ")" and (i := s.rfind("(", line)) > 0 and s[i - 1] in " \t\n" and (inner := s[i + 1 : -1]) and 1 < len(inner.split()) <= 4 and not any(x.isdigit() for x in inner) and "(" not in inner:
        return s[:i]  # a remark behind the text
    low = s[-4:].lower()
    if low.endswith(("qed", "ok", "done")) and (m := _END_WORD.search(s, len(s) - 4)):
        return s[: m.start()]
    # a mark of the end has few words
    last = _last_words(s, MARK_WORDS)
    if "end" in last.lower() and (m := _END_MARK.search(s, max(line, len(s) - len(last)))):
        return s[: m.start()].rstrip("-–—=*#")
    return s


def peel(text: str) -> str:
    """``text`` without blanks and trailers at its end."""
    s = text.rstrip(BLANKS)
    while s:
        t = _peel_one(s)
        if t is s or t == s:
            return s
        s = t.rstrip(BLANKS)
    return s


def last_box(text: str) -> tuple[int, int, str] | None:
    """Start, end (-1 when unclosed) and content of the last box, by a brace stack."""
    i = text.rfind("\\boxed{")
    if i < 0:
        return None
    depth = 0
    for j in range(i + 6, len(text)):
        c = text[j]
        if c == "{":
            depth += 1
        elif c == "}":
            depth -= 1
            if not depth:
                return i, j + 1, text[i + 7 : j]
    return i, -1, text[i + 7 :]


_PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "「": "」", "『": "』", "《": "》", "“": "”", "«": "»", "„": "“"}
_CLOSES = {v: k for k, v in _PAIRS.items()}
_DELIMITER = re.compile(r"```|`[^`\n]+`|\$[^$\n]+\$|\\.|[()\[\]{}（）【】「」『』《》“”„«»\"]|</?[A-Za-z][\w-]*(?:\s[^<>\n]*)?/?>|\n[ \t\r]*\n")
_VOID = frozenset("br hr img input meta link p li td tr th".split())


def open_delimiters(text: str) -> list[str]:
    """What is open at the end of ``text``: brackets and quotes of its last paragraph, code fences and tags of all of it.

    Escaped signs, inline code and formulas are skipped; an opening sign counts where prose has one, before a word
    and behind a space, and not on a line of data, so that the symbols of puzzles don't count.
    """
    stack: list[str] = []
    for m in _DELIMITER.finditer(text):
        s, c = m[0], m[0][0]
        if s == "```":
            if "```" in stack:
                del stack[stack.index("```") :]
            else:
                stack.append("```")
            continue
        if "```" in stack or (c in "`$\\" and len(s) > 1):
            continue
        if c == "\n":
            stack = [x for x in stack if x[0] == "<"]  # brackets and quotes live within a paragraph
            continue
        at, end = m.span()
        if c == "<" and len(s) > 1:
            name = s.strip("</>").split()[0].lower()
            if s[1] == "/":
                if f"<{name}" in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(f"<{name}") :]
            elif not s.endswith("/>") and name not in _VOID and not (at and text[at - 1].isalnum()) and not _on_data_line(text, at):
                stack.append(f"<{name}")
            continue
        if c == '"':
            if '"' in stack:
                del stack[stack.index('"') :]
            elif (not at or text[at - 1] in " \t\n([{（—–") and end < len(text) and text[end].isalnum() and not _on_data_line(text, at):
                stack.append('"')
            continue
        if c == "“" and "„" in stack:
            del stack[len(stack) - 1 - stack[::-1].index("„") :]
        elif c in _PAIRS:
            wide = c not in "([{"
            if end < len(text) and (wide or ((not at or text[at - 1] in " \t\n([{\"“„«") and (text[end].isalnum() or text[end] in "([{\"“„«"))) and not _on_data_line(text, at):
                stack.append(c)
        elif _CLOSES.get(c) in stack:
            del stack[len(stack) - 1 - stack[::-1].index(_CLOSES[c]) :]
    return stack


def _on_data_line(text: str, at: int) -> bool:
    a = text.rfind("\n", 0, at) + 1
    b = text.find("\n", at)
    return bool(_DATA_LINE.search(text, a, len(text) if b < 0 else b))


# closing frames -------------------------------------------------------------------------


def _lead(head: str) -> str:
    """The last words before a value, in lower case."""
    line = head[head.rfind("\n") + 1 :].lower()
    words = _WORD.findall(_last_words(line, 8))
    if len(words) < 3:
        words = _WORD.findall(line)
    return " ".join(words[-3:] if words and "\u4e00" <= words[-1] <= "\u9fff" else words[-LEAD_WORDS:])


def _tail(text: str) -> str:
    """The words behind a value, without what ends the sentence."""
    return " ".join(text.strip(BLANKS).rstrip(TERMINATORS + CLOSERS).strip(BLANKS + ",;:，；：").lower().split())


def _is_tail(t: str) -> bool:
    return len(t.split()) <= TAIL_WORDS and len(t) <= 60


def _at_value(sentence: str, value: str) -> int:
    """Where ``value`` last stands in ``sentence`` as a whole word, -1 if nowhere."""
    i = len(sentence)
    while (i := sentence.rfind(value, 0, i)) >= 0:
        j = i + len(value)
        left = i > 0 and sentence[i - 1].isalnum() and value[0].isalnum() and not "\u4e00" <= sentence[i - 1] <= "\u9fff"
        right = j < len(sentence) and sentence[j].isalnum() and value[-1].isalnum() and not "\u4e00" <= sentence[j] <= "\u9fff"
        if not left and not right:
            return i
        i += len(value) - 1
        if i <= 0:
            return -1
    return -1


def _sentence(body: str) -> tuple[str, str]:
    """The last sentence of ``body`` without its terminator, and the terminator."""
    t = body.rstrip(CLOSERS + BLANKS)
    stem = t.rstrip(TERMINATORS)
    return stem[_last_sentence(stem) :], t[len(stem) :]


def remark(text: str) -> str | None:
    """The words behind a box on a line of its own, when they don't end in a terminator."""
    s = peel(text)
    box = last_box(s)
    if not box or box[1] < 0 or _goes_on(s[box[1] :]):
        return None
    after = s[box[1] :].strip(BLANKS)
    bare = s[: box[0]].rstrip(" \t" + INVISIBLE)
    return _tail(after) if after and after[-1] not in TERMINATORS and (not bare or bare[-1] in "\r\n>") else None


def _body(text: str) -> tuple[str, str]:
    """``text`` without a box on a line of its own at the end, and the content of that box or of the last one, in place of which stands its value."""
    s = peel(text)
    box = last_box(s)
    if not box or box[1] < 0:
        return s, ""
    start, end, value = box
    value = value.strip(BLANKS)
    before = s[:start].rstrip(" \t" + INVISIBLE)
    if not s[end:].strip(BLANKS) and (not before or before[-1] in "\r\n>"):
        return peel(before), value
    return s[:start] + value + s[end:], value


def frame(text: str | None, answer: str | None = None) -> tuple[str, str, bool] | None:
    """(lead, tail, terminated) of a text whose last sentence states a known value: the words on both sides of it."""
    if not text:
        return None
    if (tail := remark(text)) is not None:
        return ("", tail, False) if _is_tail(tail) else None
    body, value = _body(text)
    value = value or strip_blank(answer)
    if not body or not value:
        return None
    if (i := _at_value(body, value)) < 0 or _goes_on(body[i + len(value) :]):
        return None
    lead, tail, stop = _lead(body[:i]), _tail(body[i + len(value) :]), _sentence(body)[1]
    return (lead, tail, bool(stop)) if lead and _is_tail(tail) else None


class Frames:
    """The closing frames of a corpus: how the sentences that state an answer begin and end.

    A frame is kept when it ends sentences with a terminator, and makes up at least ``SHARE``
    of its lead's sentences; what a cut leaves of a frame has neither.  Remarks behind a box have
    an empty lead and need no terminator.
    """

    SHARE = 0.05

    def __init__(self, counted: Iterable[tuple[str, str, int, int]] = ()):
        """``counted``: lead, tail, sentences, and how many of them have a terminator."""
        rows = list(counted)
        total: dict[str, int] = {}
        for lead, _, n, _ in rows:
            total[lead] = total.get(lead, 0) + n
        self.tails: dict[str, set[str]] = {}
        for lead, tail, n, stopped in rows:
            if (stopped or not lead) and n >= self.SHARE * total[lead]:
                self.tails.setdefault(lead, set()).add(tail)
        self._words = {len(x.split()) for x in self.tails}
        self._end = tuple(sorted({t for tails in self.tails.values() for t in tails if t}))

    def whole(self, lead: str, tail: str) -> bool:
        """Whether a sentence with the value between ``lead`` and ``tail`` is finished: by a known frame, or, with an unknown lead, by the value itself."""
        known = self.tails.get(lead)
        return tail in known if known else not tail or tail in self._end

    def states(self, sentence: str) -> bool:
        """Whether ``sentence``, the end of a text, without a known value ends by one of the frames around some short value."""
        # a lead, a value and a tail have no more words than this
        low = _last_words(sentence[sentence.rfind("\n") + 1 :].lower(), 2 * (VALUE_WORDS + TAIL_WORDS))
        tokens = [(m.start(), m.end()) for m in _WORD.finditer(low)]
        for k in range(len(tokens) - 1, -1, -1):
            end = tokens[k][1]
            if "\u4e00" <= low[tokens[k][0]] <= "\u9fff":
                lead = " ".join(low[a:b] for a, b in tokens[max(0, k - 2) : k + 1])
            else:
                lead = " ".join(low[a:b] for a, b in tokens[max(0, k + 1 - LEAD_WORDS) : k + 1])
            known = self.tails.get(lead)
            if not known:
                continue
            rest = low[end:].strip(BLANKS + ":：").rstrip(BLANKS)
            for tail in known:
                value = rest[: len(rest) - len(tail)] if rest.endswith(tail) else ""
                if 0 < len(value.split()) <= VALUE_WORDS and not _NEXT.search(value):
                    return True
        return False


NO_FRAMES = Frames()


def _style_is_open(body: str) -> bool:
    """Whether the lines of ``body`` don't end in terminators: a list, or nothing but one short answer."""
    lines = [x for x in body.split("\n") if x.strip(BLANKS)]
    if _ITEM.match(lines[-1]):
        items = [x.rstrip(BLANKS) for x in lines[:-1] if _ITEM.match(x)]
        return bool(items) and not any(x[-1] in TERMINATORS for x in items) and _WORD.search(lines[-1]) is not None
    if len(lines) > 1 or len(body.split()) > BARE_WORDS or any(x in body for x in _ENDS):
        return False
    return bool(_QUANTITY.search(body) or _BARE.fullmatch(body)) or len(body.split()) == 1


def _prose(body: str, value: str, frames: Frames) -> str:
    """The ending of prose without a box behind it."""
    b = body.rstrip(BLANKS)
    if not b:
        return "terminated"
    if b[-1] == "\ufffd" or _PARTIAL_MACRO.search(b, max(0, len(b) - 8)) or _PARTIAL_ESCAPE.search(b, max(0, len(b) - 8)):
        return "broken"
    m = _ANSWER_LINE.match(b, b.rfind("\n") + 1)
    if m and len(m[1].split()) <= 8:
        v = strip_blank(m[1]).rstrip(".。*_")
        if value and v != value and value.startswith(v):
            return "broken"
        return "closed"
    last, stop = _sentence(b)
    # an answer may itself consist of signs that end sentences or close brackets
    if value and _ends_with(b, value):
        head = b[: len(b.rstrip(BLANKS)) - len(value)] if b.endswith(value) else b[: b.rindex(value)]
        return "closed" if stop or frames.whole(_lead(head), "") else "broken"
    if value and (i := _at_value(b, value)) >= 0 and not _goes_on(b[i + len(value) :]):
        tail = _tail(b[i + len(value) :])
        if _is_tail(tail) and frames.whole(_lead(b[:i]), tail):
            return "closed"
    if stop:
        return "closed" if frames.states(b.rstrip(CLOSERS + BLANKS).rstrip(TERMINATORS)) else "terminated"
    if not value and frames.states(b):
        return "closed"
    if not _LETTER.search(last) or _DATA_LINE.search(b, b.rfind("\n") + 1) or b.endswith("```"):
        return "data"
    return "data" if not value and _style_is_open(b) else "broken"


def _ends_with(body: str, value: str) -> bool:
    """Whether ``body`` ends by ``value``, one terminator and closing signs aside."""
    for b in (body, body.rstrip(CLOSERS), body[:-1] if body[-1] in TERMINATORS else body, body.rstrip(CLOSERS).rstrip(TERMINATORS)):
        if b.endswith(value):
            i = len(b) - len(value)
            if not (i and b[i - 1].isalnum() and value[0].isalnum() and not "\u4e00" <= b[i - 1] <= "\u9fff"):
                return True
    return False


def _last_sentence(text: str) -> int:
    """Where the last sentence of ``text`` begins."""
    return max((i + len(e) for e in _ENDS if (i := text.rfind(e)) >= 0), default=0)


def _open_box_before(text: str, end: int) -> bool:
    """Whether a box opened before ``end`` is still open there."""
    i = text.rfind("\\boxed{", 0, end)
    return i >= 0 and text.find("}", i, end) < 0


def ending(text: str | None, answer: str | None = None, frames: Frames = NO_FRAMES) -> str:
    """Classify the end of ``text``; ``answer`` helps to tell a whole value from a cut one."""
    if text is None:
        return "empty"
    s = peel(text)
    if not s.strip(BLANKS):
        return "empty"
    if text.rstrip(BLANKS).endswith("```") and text.count("```") % 2 == 0 and "\\boxed{" not in text:
        return "bare"  # a closed block of code
    ans = strip_blank(answer)
    box = last_box(s)
    if box is None or box[1] >= 0 and _goes_on(s[box[1] :]):
        got = _prose(s, ans or (box[2].strip(BLANKS) if box else ""), frames)
        if got == "data":
            return "broken" if _sentence_style(s) else "bare"
        return "broken" if got == "terminated" and open_delimiters(text) else got
    start, end, value = box
    if end < 0:
        return "broken"
    value = value.strip(BLANKS)
    after = s[end:].strip(BLANKS)
    before = s[:start]
    if _open_box_before(s, start):
        return "broken"
    bare = before.rstrip(" \t" + INVISIBLE)
    own_line = not bare or bare[-1] in "\r\n>"
    if after and after[-1] not in TERMINATORS and not frames.whole("" if own_line else _lead(bare), _tail(after)):
        return "remark" if own_line else "broken"
    if own_line:
        inner = peel(before)
        if inner and (_prose(inner, value or ans, frames) == "broken" or open_delimiters(before)):
            return "broken"
    elif not after and not frames.whole(_lead(bare), ""):
        return "broken"
    return "closed"


def _goes_on(after: str) -> bool:
    """Whether more than the rest of its sentence stands behind a box."""
    a = after.rstrip(BLANKS + TERMINATORS + CLOSERS).lstrip(BLANKS)
    return "\n" in a or any(e in a for e in _ENDS)


def _sentence_style(text: str) -> bool:
    """Whether the text is prose of sentences, so that its last one needs an end too."""
    lines = [_MARKER.sub("", x.strip(BLANKS)) or x for x in text.split("\n") if x.strip(BLANKS)]
    return any(x[-1] in TERMINATORS and _LETTER.search(x) for x in lines[:-1]) or any(e in lines[-1] for e in _ENDS[:-1])
