"""Language of short prose by stopword votes.

Every listed word votes for the languages it belongs to, split evenly among them;
Han and Cyrillic letters vote for zh and ru.  The winner needs a lead.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter

# Frequent function words.
STOPWORDS = {
    "en": "the of and to is that for with was it on as are this by be from at we not but i so if when only you in".split(),
    "de": "der die das und ist nicht ein eine zu den mit von dem auf wird wir im für sich es aus wie ich kann keine bei jede dann".split(),
    "fr": "le la les des est et un une du que dans pour pas qui sur au ne ce se nous en je cette ces à chaque selon par".split(),
    "es": "el la los las de y que en un una es por con no a se del al su como esta este para lo me pero cada cuando".split(),
    "pt": "o a os as de e que em um uma é por com não para se do da na ao mais como mas esta este isso me cada".split(),
    "it": "il la i gli le di e che un una è per con non si del della da alla questo questa ma ogni come a mi sono se".split(),
    "nl": "de het een en van is dat niet te op voor met zijn er aan als wordt bij ik kan geen deze dit naar wij we hun elke".split(),
}
_VOTE: dict[str, tuple[tuple[str, float], ...]] = {}
for _lang, _words in STOPWORDS.items():
    for _w in _words:
        _plain = "".join(c for c in unicodedata.normalize("NFD", _w) if not unicodedata.combining(c))
        for _form in {_w, _plain}:
            _VOTE.setdefault(_form, ())
            if _lang not in dict(_VOTE[_form]):
                _VOTE[_form] += ((_lang, 1.0),)
_VOTE = {w: tuple((lang, 1.0 / len(v)) for lang, _ in v) for w, v in _VOTE.items()}

_VOTE_BYTES = {w.encode(): v for w, v in _VOTE.items() if w.isascii()}
_LETTERS = bytes(c if chr(c).isascii() and chr(c).isalpha() else 32 for c in range(256))

_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?:^|[.!?]\s+|\n)[^\W\d_a-z][^.!?\n]{20,}[.!?]")
_HAN = re.compile("[一-鿿]")
_CYR = re.compile("[Ѐ-ӿ]+")
_UKR = re.compile("[іїєґІЇЄҐ]")
_KANA = re.compile("[ぁ-ヿ]")
#: share of Ukrainian letters among Cyrillic ones; words of a text that is called foreign, and its most share of words of the language
UKR_SHARE, FOREIGN_WORDS, FOREIGN_SHARE = 0.02, 12, 0.06


#: different function words, Han or Cyrillic words, that make a line with signs of data a line of prose
LINE_WORDS = 3


def _prose_lines(text: str) -> str:
    """Without lines that are nothing but data, which have words of their own whatever the language around them."""
    if "->" in text or "=" in text or " becomes " in text:
        return "\n".join(x for x in text.split("\n") if not ("->" in x or "=" in x or " becomes " in x) or _is_prose(x))
    return text


def _is_prose(line: str) -> bool:
    return len(_VOTE.keys() & set(_WORD.findall(line.lower()))) >= LINE_WORDS or len(_HAN.findall(line)) >= 2 * LINE_WORDS or len(_CYR.findall(line)) >= 2 * LINE_WORDS


def votes(text: str) -> tuple[str | None, float, float]:
    """(winner or None, its votes, votes of the second); lines of data don't vote."""
    text = _prose_lines(text)
    tally: dict[str, float] = {}
    if not text.isascii():
        if han := len(_HAN.findall(text)):
            tally["zh"] = han / 2.0
        if cyr := _CYR.findall(text):
            tally["ru"] = sum(map(len, cyr)) / 6.0
            if (marks := len(_UKR.findall(text))) and marks >= UKR_SHARE * sum(map(len, cyr)):
                tally["uk"] = tally.pop("ru")
        if (kana := len(_KANA.findall(text))) and kana >= 0.2 * (kana + han):
            tally["ja"] = (kana + tally.pop("zh", 0.0)) / 2.0
    if text.isascii():
        # the same words, by a table of bytes
        counts, listed = Counter(text.lower().encode().translate(_LETTERS).split()), _VOTE_BYTES
    else:
        counts, listed = Counter(_WORD.findall(text.lower())), _VOTE
    for w in counts.keys() & listed.keys():
        n = counts[w]
        for lang, v in listed[w]:
            tally[lang] = tally.get(lang, 0.0) + n * v
    if not tally:
        return None, 0.0, 0.0
    top = sorted(tally.items(), key=lambda x: (-x[1], x[0]))
    return top[0][0], top[0][1], top[1][1] if len(top) > 1 else 0.0


def language(text: str, least: float = 1.5, lead: float = 1.5) -> str | None:
    """The language of ``text`` or None without ``least`` votes or a lead of the factor ``lead``."""
    lang, first, second = votes(text)
    return lang if first >= least and first >= lead * second else None


def foreign(text: str, lang: str) -> bool:
    """Whether ``text`` is prose, but hardly has function words or letters of ``lang``: it is in a language without votes."""
    words = _WORD.findall(_prose_lines(text))
    if lang in ("zh", "ru"):
        own = len((_HAN if lang == "zh" else _CYR).findall(text))
        return len(words) >= FOREIGN_WORDS and own < FOREIGN_SHARE * len(words)
    # sentences, not lists of words: some begin with a capital and end with a stop
    if len(words) < FOREIGN_WORDS or not _SENTENCE.search(text):
        return False
    return sum(lang in dict(_VOTE.get(w.lower(), ())) for w in words) < FOREIGN_SHARE * len(words)
