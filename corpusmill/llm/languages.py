"""Languages of documents and paragraphs by fused evidence (problem 8).

The languages are those that the labels name: word and letter-triple likelihoods come from
a stratified, bounded sample of labelled documents, cleaned by one round of the votes of
each half of its texts on the other.  A paragraph that hardly has words of any of them is in ``other``.  The likelihoods
of the paragraphs are fused with the declared label, with markup language and address suffix
where there are such columns, and with the prior of the host, whose labels are smoothed
towards those of its group and these towards all (grouped aggregation).  Each paragraph is in
the document's main language but for a share ``MIXED``, so the main language, that of the
largest posterior, is the one of most paragraphs; label and host decide close cases.

Edge cases: null, empty and white-space texts, and texts of headings, data or code
only, have no language and give no row; blank labels and placeholders are missing;
a text in ``other`` never makes a label wrong; a null doc_id passes through.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusmill.llm.encode import source_name
from corpusmill.session import spread

# Spellings of languages' names besides the two letters, and words for no label.
NAMES = {
    "de": "deu ger german deutsch", "en": "eng english", "es": "spa spanish español espanol castellano", "fr": "fra fre french français francais",
    "it": "ita italian italiano", "nl": "nld dut dutch nederlands", "pt": "por portuguese português portugues", "ru": "rus russian русский", "zh": "zho chi cmn chinese 中文",
    "pl": "pol polish polski", "sv": "swe swedish svenska", "uk": "ukr ukrainian українська", "ja": "jpn japanese 日本語", "cs": "ces cze czech čeština", "da": "dan danish dansk",
    "tr": "tur turkish türkçe", "ko": "kor korean 한국어", "ar": "ara arabic العربية", "fi": "fin finnish suomi", "hu": "hun hungarian magyar", "ro": "ron rum romanian română",
}
MISSING = frozenset("und unk unknown xx xxx ?? ? ??? n/a na none null nil nan - -- mul zxx other undefined undetermined".split())
_SPELLED = {w: lang for lang, names in NAMES.items() for w in [lang, *names.split()]}
# Languages of address suffixes.
SUFFIXES = {
    "de": "de", "at": "de", "uk": "en", "us": "en", "au": "en", "ie": "en", "nz": "en", "es": "es", "mx": "es", "ar": "es", "cl": "es", "co": "es", "fr": "fr", "it": "it", "nl": "nl",
    "pt": "pt", "br": "pt", "ru": "ru", "cn": "zh", "tw": "zh", "pl": "pl", "se": "sv", "ua": "uk", "jp": "ja", "cz": "cs", "dk": "da", "tr": "tr", "kr": "ko", "fi": "fi", "hu": "hu", "ro": "ro",
}

#: labelled documents of a language the model is fitted on at most, languages at most, documents a language needs, and the documents' length in characters
SAMPLE_DOCS, MOST_LANGS, LEAST_DOCS, SAMPLE_CHARS = 700, 60, 5, (40, 20_000)
#: pseudo-documents of a prior and its weight; trust in a label, in markup and in an address suffix; share of paragraphs in another language
PRIOR_DOCS, PRIOR_WEIGHT, LABEL_TRUST, MARKUP_TRUST, ADDRESS_TRUST, MIXED = 20.0, 0.3, 0.6, 0.7, 0.5, 0.01
#: weight of a letter triple and of a word, and the most that a paragraph's text can say, as its tokens aren't independent
TRIPLE_WEIGHT, TEXT_WEIGHT, MOST_EVIDENCE = 0.25, 0.6, 12.0
#: share of its language's usual known words that a paragraph needs, else it is in another language; tokens from which that is judged
KNOWN_SHARE, KNOWN_TOKENS = 0.3, 5
#: how much more often a language's paragraphs must read as it than those of another code, else both are one language
APART = 0.5
#: posterior a paragraph needs to count as in another language, and the letters of a paragraph of prose
SURE, LEAST_WORDS, LEAST_HAN = 0.95, 3, 4
OTHER = "other"

_BREAK = re.compile("\r\n|[\n\r\v\f\x1c-\x1e\x85\u2028\u2029]")
_BLANKISH = re.compile(r"[\s­᠎​-‏⁠﻿]*\Z")
_TOKEN = re.compile(r"[一-鿿]|[^\W\d_一-鿿]+")
_CODE = re.compile(r"<<|>>|0b[01]|->|\^|:=|==|[{};]\s*$|^\s*(?:def|return|import|class)\b|^\s*[\w.]+\s*=\s")
_CODE_LABEL = re.compile("[a-z]{2,3}")
_WORD = re.compile(r"[^\W\d_]{3,}")
_MOJIBAKE = re.compile("[ÃÂÐÑ][\u0080-¿]")


def declared(label: str | None) -> str | None:
    """Code a label names (two letters where the name is known), ``?`` for what is no code, None for a missing label."""
    s = re.sub(r"[\s­​-‏⁠﻿]+", " ", label or "").strip().lower()
    if not s or s in MISSING:
        return None
    head = re.split(r"[-_ (,;/]", s)[0]
    return _SPELLED.get(s) or _SPELLED.get(head) or (head if _CODE_LABEL.fullmatch(head) else "?")


def declared_column(label: Column) -> Column:
    """The same in the JVM, null for a missing label and for what is no code."""
    spelled = F.create_map(*[F.lit(x) for kv in _SPELLED.items() for x in kv])
    s = F.lower(F.trim(F.regexp_replace(label, r"[\s\x{ad}\x{200b}-\x{200f}\x{2060}\x{feff}]+", " ")))
    head = F.element_at(F.split(s, r"[-_ (,;/]"), 1)
    code = F.coalesce(F.try_element_at(spelled, s), F.try_element_at(spelled, head), F.when(head.rlike("^[a-z]{2,3}$"), head))
    return F.when(~s.isin(*MISSING) & (s != ""), code)


def paragraphs(text: str) -> list[str]:
    """Non-blank parts between empty or white-space-only lines."""
    out: list[str] = []
    part: list[str] = []
    for line in _BREAK.split(text):
        if _BLANKISH.match(line):
            if part:
                out.append("\n".join(part))
                part = []
        else:
            part.append(line)
    if part:
        out.append("\n".join(part))
    return out


def fold(text: str) -> str:
    """Lower case without accents."""
    if text.isascii():
        return text.lower()
    return "".join(c for c in unicodedata.normalize("NFKD", text.lower()) if not unicodedata.combining(c))


def mended(text: str) -> str:
    """Composed, without invisible signs inside words; doubly encoded text is decoded."""
    if text.isascii():
        return text
    if _MOJIBAKE.search(text):
        try:
            text = text.encode("latin-1").decode()
        except UnicodeError:
            text = re.sub("[ÃÂÐÑ][\u0080-¿]+", _redecode, text)
    if "\u00ad" in text or "\u200b" in text:
        text = text.replace("\u00ad", "").replace("\u200b", "")
    return text if unicodedata.is_normalized("NFC", text) else unicodedata.normalize("NFC", text)


def _redecode(m: re.Match) -> str:
    try:
        return m[0].encode("latin-1").decode()
    except UnicodeError:
        return m[0]


def prose_tokens(part: str) -> list[str]:
    """Lower-case words and Han characters of a paragraph of prose; empty for headings, data and code."""
    lines = [x for x in part.split("\n") if not x.lstrip().startswith(("#", "|", "```"))]
    text = "\n".join(x for x in lines if not (_CODE.search(x) and len(_WORD.findall(x)) < 4))
    tokens = _TOKEN.findall(text.lower())
    words = 0
    for t in tokens:
        words += len(t) > 1
        if words == LEAST_WORDS:
            return tokens
    return tokens if sum("一" <= t <= "鿿" for t in tokens) >= LEAST_HAN else []


def parts_of(text: str | None) -> list[tuple[int, list[str]]]:
    """(para_no, tokens) of the paragraphs of prose."""
    return [(no, t) for no, p in enumerate(paragraphs(mended(text or "")), 1) if (t := prose_tokens(p))]


class Model:
    """Log likelihoods of words, and of letter triples for words the sample doesn't have."""

    CACHE = 200_000  # words whose rows are remembered

    def __init__(self, texts: list[tuple[str, str]], counts: dict[str, int] | None = None):
        """``counts``: labels of each code in the whole corpus, of which ``texts`` may be an even sample; those of the texts if None."""
        docs = Counter(lang for lang, _ in texts)
        texts = [(lang, text) for lang, text in texts if docs[lang] >= LEAST_DOCS]
        pairs = [(half, lang, t) for half, (lang, text) in zip(_halves(texts), texts, strict=True) for _, t in parts_of(text)]
        labels = [lang for _, lang, _ in pairs]
        halves = [x for half in (0, 1) if (x := self._held_out(pairs, half))]
        # a second name for a language's texts is a wrong label, no language; the commoner name stays
        known = sorted(set(labels), key=lambda x: (-(counts or docs).get(x, 0), x))
        known = _told_apart(known, labels, self._read(pairs, halves, known))
        read = self._read(pairs, halves, known)
        # nor is a code whose own paragraphs mostly read as other languages
        votes, agree = Counter(labels), Counter(lang for lang, x in zip(labels, read, strict=True) if x == lang)
        clean = [(x, t) for (_, _, t), x in zip(pairs, read, strict=True) if x in known and 2 * agree[x] >= votes[x]]
        self._fit(clean)
        self.floor = np.full(len(self.langs), 1.0)
        if clean:
            self.floor = self._floors(self.langs, clean, self.scores([t for _, t in clean])[1])

    def _held_out(self, pairs: list[tuple[int, str, list[str]]], half: int) -> tuple | None:
        """(rows, languages, log likelihoods, shares of known words) of the paragraphs of one half by the texts of the other.

        A fit on a paragraph's own text knows it by heart and agrees with any label.
        """
        rows = [k for k, p in enumerate(pairs) if p[0] == half]
        self._fit([(lang, t) for h, lang, t in pairs if h != half])
        return (rows, self.langs, *self.scores([pairs[k][2] for k in rows])) if rows and self.langs else None

    def _read(self, pairs: list[tuple[int, str, list[str]]], halves: list[tuple], among: list[str]) -> list[str]:
        """The language out of ``among`` that each paragraph reads as; its label where the other half hardly knows its words."""
        read = [lang for _, lang, _ in pairs]
        for rows, langs, total, known in halves:
            cols = [i for i, x in enumerate(langs) if x in among]
            if not cols:
                continue
            names, total, known = [langs[i] for i in cols], total[:, cols], known[:, cols]
            at = total.argmax(axis=1)
            best, parts = [names[i] for i in at], [pairs[k][2] for k in rows]
            floor = self._floors(names, [(x if x == read[k] else "", t) for k, x, t in zip(rows, best, parts, strict=True)], known)
            odd = self._strangers(known, at, floor, parts) | ~total.any(axis=1)
            for k, x, stranger in zip(rows, best, odd, strict=True):
                if not stranger:
                    read[k] = x
        return read

    @staticmethod
    def _floors(langs: tuple[str, ...] | list[str], pairs: list[tuple[str, list[str]]], known: np.ndarray) -> np.ndarray:
        """What share of its words a paragraph of each language needs in the list: a part of what its paragraphs usually have, the lower tenth."""
        own: dict[str, list[int]] = defaultdict(list)
        for r, (lang, t) in enumerate(pairs):
            if len(t) >= KNOWN_TOKENS:
                own[lang].append(r)
        return np.array([KNOWN_SHARE * float(np.quantile(known[own[x], i], 0.1)) if own[x] else 0.0 for i, x in enumerate(langs)])

    @staticmethod
    def _strangers(known: np.ndarray, at: np.ndarray, floor: np.ndarray, parts: list[list[str]]) -> np.ndarray:
        """Which paragraphs hardly have words of their likeliest language."""
        return (known[np.arange(len(parts)), at] < floor[at]) & (np.array([len(t) for t in parts]) >= KNOWN_TOKENS)

    def _fit(self, pairs: list[tuple[str, list[str]]]) -> None:
        words: dict[str, Counter] = defaultdict(Counter)
        triples: dict[str, Counter] = defaultdict(Counter)
        raw: dict[str, Counter] = defaultdict(Counter)
        for lang, tokens in pairs:
            raw[lang].update(tokens)
        for lang in raw:
            for w, n in raw[lang].items():
                words[lang][fold(w)] += n
            for w, n in words[lang].items():
                for g in self._grams(w):
                    triples[lang][g] += n
        self.langs = tuple(sorted(x for x in words if words[x]))
        self.words, self.word_logs, own = self._logs(words)
        self.triples, self.triple_logs, _ = self._logs(triples)
        # for each word, in which languages it was seen at all
        self.word_seen = own
        self._rows: dict[str, tuple[int, tuple[int, ...]]] = {}

    @staticmethod
    def _grams(w: str) -> list[str]:
        s = f" {w} "
        return [s[i : i + 3] for i in range(len(s) - 2)] if len(s) > 2 else [s]

    def _logs(self, counts: dict[str, Counter]) -> tuple[dict[str, int], np.ndarray, np.ndarray]:
        """Row numbers of the entries, one row of log likelihoods for each, and the languages that have it."""
        seen: Counter = Counter()
        for lang in self.langs:
            seen.update(counts[lang])
        total = {lang: sum(counts[lang].values()) + 0.5 * len(seen) for lang in self.langs}
        # single sightings are mostly names and noise of the sample
        kept = [w for w, n in seen.items() if n > 1]
        n = np.array([[counts[x][w] for x in self.langs] for w in kept], float).reshape(len(kept), len(self.langs))
        share = n / np.array([max(1.0, sum(counts[x].values())) for x in self.langs]) if self.langs else n
        rows = np.log((n + 0.5) / np.array([total[x] for x in self.langs])) if self.langs else n
        # a word counts as a language's own when it isn't far commoner in another
        return {w: i for i, w in enumerate(kept)}, rows, (share >= 0.1 * share.max(axis=1, initial=0.0, keepdims=True)) & (n > 0)

    def _row(self, token: str) -> tuple[int, tuple[int, ...]]:
        """Row of a word, or -1 and the rows of its triples."""
        w = fold(token)
        i = self.words.get(w, -1)
        got = (i, () if i >= 0 else tuple(j for g in self._grams(w) if (j := self.triples.get(g)) is not None))
        if len(self._rows) >= self.CACHE:
            self._rows.clear()
        self._rows[token] = got
        return got

    def scores(self, parts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihoods and shares of known words of each list of tokens, one column for each language."""
        rows, n = self._rows, len(parts)
        at, ends, rare, rare_ends = [], [], [], []
        for tokens in parts:
            for t in tokens:
                i, grams = rows.get(t) or self._row(t)
                if i >= 0:
                    at.append(i)
                else:
                    rare += grams
            ends.append(len(at))
            rare_ends.append(len(rare))
        sizes = np.array([max(1, len(t)) for t in parts], float).reshape(n, 1)
        total = TEXT_WEIGHT * _sums(self.word_logs, at, ends) + TRIPLE_WEIGHT * _sums(self.triple_logs, rare, rare_ends)
        return total, _sums(self.word_seen, at, ends) / sizes

    def judge_all(self, docs: list[tuple]) -> list[list[tuple[int, str, float]]]:
        """For each (text, label, host prior, markup, address suffix) its (para_no, language, confidence); number 0 is the document."""
        parts = [parts_of(d[0]) for d in docs]
        flat = [t for p in parts for _, t in p]
        if not flat or not self.langs:
            return [[] for _ in docs]
        total, known = self.scores(flat)
        # what a paragraph says is bounded: its tokens repeat each other
        ll = np.maximum(total - total.max(axis=1, keepdims=True), -MOST_EVIDENCE)
        at = total.argmax(axis=1)
        stranger = self._strangers(known, at, self.floor, flat)
        silent = ~total.any(axis=1)
        prior = self._priors(docs)
        post = _softmax(ll + 0.5 * np.repeat(prior, [len(p) for p in parts], axis=0))
        n = max(2, len(self.langs))
        # each paragraph is in the main language, or with the share MIXED in any other
        says = np.log((1 - MIXED) * post + MIXED * (1 - post) / (n - 1))
        first, sure = post.argmax(axis=1), post.max(axis=1)
        out, i = [], 0
        for p, q in zip(parts, prior, strict=True):
            rows = [r for r in range(i, i + len(p)) if not silent[r]]
            out.append(self._fuse(p, i, rows, says, first, sure, stranger, q) if rows else [])
            i += len(p)
        return out

    def _priors(self, docs: list[tuple]) -> np.ndarray:
        """Log priors of documents by host, label, markup and address suffix."""
        n = len(self.langs)
        host = np.array([[1.0] * n if not d[2] else [d[2].get(x, 0.0) for x in self.langs] if isinstance(d[2], dict) else d[2] for d in docs], float).reshape(len(docs), n)
        prior = PRIOR_WEIGHT * np.log(np.maximum(host, 1e-6))
        made: dict[tuple, np.ndarray] = {}
        for row, (_, label, _, markup, suffix) in zip(prior, docs, strict=True):
            key = (label, markup, suffix)
            if key not in made:
                add = np.zeros(n)
                for named, trust in ((declared(label), LABEL_TRUST), (declared(markup), MARKUP_TRUST), (SUFFIXES.get(suffix or ""), ADDRESS_TRUST)):
                    if named in self.langs and n > 1:
                        add += math.log((1 - trust) / (n - 1))
                        add[self.langs.index(named)] += math.log(trust) - math.log((1 - trust) / (n - 1))
                made[key] = add
            row += made[key]
        return prior

    def _fuse(self, part, start, rows, says, first, sure, stranger, prior) -> list[tuple[int, str, float]]:
        own = [r for r in rows if not stranger[r]]
        if 2 * len(own) <= len(rows) and len(own) < len(rows):
            # most of the prose is in none of the languages
            return [(0, OTHER, round(1.0 - len(own) / len(rows), 6))]
        fused = prior + says[own].sum(axis=0)
        best = int(fused.argmax())
        out = [(0, self.langs[best], 1.0 / float(np.exp(fused - fused[best]).sum()))]
        for r in rows:
            if stranger[r]:
                out.append((part[r - start][0], OTHER, 1.0))
            elif first[r] != best and sure[r] >= SURE:
                out.append((part[r - start][0], self.langs[first[r]], float(sure[r])))
        return out

    def judge(self, text: str | None, label: str | None = None, host: dict[str, float] | None = None, markup: str | None = None, suffix: str | None = None):
        """Main language (None without prose) and the rows of one document."""
        rows = self.judge_all([(text, label, host, markup, suffix)])[0]
        return (rows[0][1] if rows else None), rows


def _halves(texts: list[tuple[str, str]]) -> list[int]:
    """0 or 1 for each (label, text): copies of a text are in one half, and each label has as many texts in either as that allows."""
    half: dict[str, int] = {}
    sizes: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for lang, text in texts:
        if text not in half:
            n = sizes[lang]
            half[text] = int(n[1] < n[0])
            n[half[text]] += 1
    return [half[text] for _, text in texts]


def _told_apart(codes: list[str], labels: list[str], read: list[str]) -> list[str]:
    """The codes, commonest first, without those whose paragraphs read as a commoner one nearly as often as that one's own do."""
    seen = Counter(zip(labels, read, strict=True))

    def same(a: str, b: str) -> bool:
        own, other = seen[a, a] + seen[a, b], seen[b, a] + seen[b, b]
        return bool(own and other) and seen[a, a] / own - seen[b, a] / other < APART

    kept: list[str] = []
    for b in codes:
        if not any(same(a, b) for a in kept):
            kept.append(b)
    return kept


def _sums(rows: np.ndarray, at: list[int], ends: list[int]) -> np.ndarray:
    """Sums of the rows ``at``, one for each end."""
    width = rows.shape[1] if rows.ndim == 2 else 0
    if not at:
        return np.zeros((len(ends), width))
    run = np.zeros((len(at) + 1, width))
    np.cumsum(rows[at], axis=0, out=run[1:])
    e = np.array(ends)
    return run[e] - run[np.r_[0, e[:-1]]]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(documents: DataFrame, sample: int = SAMPLE_DOCS) -> Model:
    """The model of at most ``sample`` labelled documents of each language, chosen by the hash of their ids.

    The languages are the ``MOST_LANGS`` commonest codes of the labels.  The hash thins each language to about its
    share before anything is gathered, so each task hands on its few.
    """
    h = F.xxhash64("doc_id")
    labelled = documents.select("doc_id", "text", declared_column(F.col("lang")).alias("code")).where("code is not null").where(F.length("text").between(*SAMPLE_CHARS))
    counts = labelled.groupBy("code").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "code").limit(MOST_LANGS).collect()
    if not counts:
        return Model([])
    every = F.create_map(*[F.lit(x) for r in counts for x in (r.code, max(1, r.n // sample))])
    thin = labelled.withColumns({"h": h, "every": F.try_element_at(every, F.col("code"))}).where(F.col("every").isNotNull() & (F.pmod(F.col("h"), F.col("every")) == 0))
    # at most some twice the sample of each language is left
    rows = thin.select("code", "h", "text").collect()
    by: dict[str, list] = defaultdict(list)
    for r in rows:
        by[r.code].append((r.h, r.text))
    return Model([(code, text) for code in sorted(by) for _, text in sorted(by[code])[:sample]], {r.code: r.n for r in counts})


def group_of(source: Column) -> Column:
    """Group of a host: the last two parts of a name with dots, else the letters it begins with."""
    return F.when(source.contains("."), F.regexp_extract(source, r"([^.]+\.[^.]+)$", 1)).otherwise(F.regexp_extract(source, r"^([^\d_\-]*)", 1))


def host_priors(documents: DataFrame) -> DataFrame:
    """(source, prior): shares of the languages of a host's labels, smoothed towards those of its group, and these towards those of all."""
    by = (
        documents.select(F.coalesce(source_name(F.col("source")), F.lit("")).alias("source"), declared_column(F.col("lang")).alias("code"))
        .where("code is not null")
        .groupBy("source", "code")
        .agg(F.count(F.lit(1)).cast("double").alias("n"))
        .withColumn("grp", group_of(F.col("source")))
    )
    every = by.groupBy("code").agg(F.sum("n").alias("all_n")).orderBy(F.desc("all_n"), "code").limit(MOST_LANGS).collect()
    share = {r.code: r.all_n / sum(x.all_n for x in every) for r in every}
    if not share:
        return by.select("source", F.lit(None).cast("map<string,double>").alias("prior")).limit(0)
    langs = F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(p).alias("p0")) for c, p in share.items()]))

    def smoothed(d: DataFrame, key: str, parent: str) -> Column:
        return (F.coalesce("n", F.lit(0.0)) + PRIOR_DOCS * F.col(parent)) / (F.coalesce("m", F.lit(0.0)) + PRIOR_DOCS)

    grp = by.groupBy("grp", "code").agg(F.sum("n").alias("n"))
    size = by.groupBy("grp").agg(F.sum("n").alias("m"))
    grid = size.select("grp", "m", langs.alias("l")).select("grp", "m", "l.code", "l.p0").join(grp, ["grp", "code"], "left")
    grid = grid.select("grp", "code", smoothed(grid, "grp", "p0").alias("p1"))
    host = by.groupBy("source", "grp").agg(F.sum("n").alias("m")).join(grid, "grp").join(by.select("source", "code", "n"), ["source", "code"], "left")
    return host.groupBy("source").agg(F.map_from_entries(F.collect_list(F.struct("code", smoothed(host, "source", "p1").alias("p")))).alias("prior"))


def languages(documents: DataFrame, model: Model | None = None, markup: str = "markup_lang", address: str = "url") -> DataFrame:
    """(doc_id, para_no, true_lang, confidence, label): each document's main language as number 0 and every paragraph in another one.

    ``label`` is the code the document declares, ``?`` for what is no code, null when missing.  ``markup`` and ``address`` name the
    columns of a markup language and an address; they are used where the table has them.
    """
    model = model or fit(documents)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def run(batches):
        m = shared.value
        for b in batches:
            ids, labels, *rest = (b.column(k).to_pylist() for k in (0, 2, 1, 2, 3, 4, 5))
            rows = [
                (doc, no, lang, round(conf, 6), declared(label))
                for doc, label, found in zip(ids, labels, m.judge_all(list(zip(*rest, strict=True))), strict=True)
                for no, lang, conf in found
            ]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 5
            types = (pa.int64(), pa.int32(), pa.string(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=["doc_id", "para_no", "true_lang", "confidence", "label"])

    none = F.lit(None).cast("string")
    suffix = F.regexp_extract(F.lower(address), r"^(?:[a-z]+://)?(?:[^/?#@]*@)?[^/:?#]*\.([a-z]+)(?=[:/?#]|$)", 1) if address in documents.columns else none
    docs = documents.select(
        "doc_id", "text", "lang", F.coalesce(source_name(F.col("source")), F.lit("")).alias("_host"), (F.col(markup) if markup in documents.columns else none).alias("_markup"), suffix.alias("_suffix")
    )
    fused = spread(docs).join(host_priors(documents).withColumnRenamed("source", "_host"), "_host", "left")
    # the prior in the order of the model's languages
    prior = F.when(F.col("prior").isNotNull(), F.array(*[F.coalesce(F.try_element_at("prior", F.lit(x)), F.lit(0.0)) for x in model.langs]).cast("array<double>")).alias("prior")
    fused = fused.select("doc_id", "text", "lang", prior, "_markup", "_suffix")
    return fused.mapInArrow(run, "doc_id bigint, para_no int, true_lang string, confidence double, label string")


def wrong_labels(documents: DataFrame, model: Model | None = None) -> DataFrame:
    """(doc_id, para_no, true_lang): documents whose label is missing or names another language, and paragraphs in another language; none in ``other``."""
    found = languages(documents, model).where(F.col("true_lang") != OTHER)
    return found.where((F.col("para_no") > 0) | F.col("label").isNull() | (F.col("label") != F.col("true_lang"))).select("doc_id", "para_no", "true_lang")
