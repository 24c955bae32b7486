"""Suffix automaton over the words of a text."""

from __future__ import annotations

import re
from collections.abc import Iterator

_TOKEN = re.compile(r"[一-鿿]|[^\W_一-鿿]+|[^\w\s]")


def words(text: str) -> list[str]:
    """Lower-case words, single Han characters and single signs of ``text``."""
    return _TOKEN.findall(text.lower())


def each_word(text: str) -> Iterator[str]:
    """The same, one at a time."""
    return (m[0] for m in _TOKEN.finditer(text.lower()))


class SuffixAutomaton:
    """Minimal automaton of all word sequences that occur in one text."""

    __slots__ = ("_next", "_link", "_len")

    def __init__(self, tokens: list[str]):
        nxt: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for tok in tokens:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and tok not in nxt[p]:
                nxt[p][tok] = cur
                p = link[p]
            if p >= 0:
                q = nxt[p][tok]
                if length[q] == length[p] + 1:
                    link[cur] = q
                else:
                    twin = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and nxt[p].get(tok) == q:
                        nxt[p][tok] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self._next, self._link, self._len = nxt, link, length

    def covered(self, tokens: list[str], least: int) -> tuple[int, int]:
        """How many of ``tokens`` lie in a run of ``least`` or more that occurs in the text, and the longest stretch that doesn't."""
        nxt, link, length = self._next, self._link, self._len
        state = run = total = reach = gap = 0
        for i, tok in enumerate(tokens):
            while state and tok not in nxt[state]:
                state = link[state]
                run = length[state]
            if tok in nxt[state]:
                state = nxt[state][tok]
                run += 1
            else:
                run = 0
            if run >= least:
                start = max(reach, i + 1 - run)
                gap = max(gap, start - reach)
                total += i + 1 - start
                reach = i + 1
        return total, max(gap, len(tokens) - reach)

