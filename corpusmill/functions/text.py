"""Column expressions on strings: normal forms, ladders, boxes, answers.

White space is one explicit class, so that the JVM and other engines agree on it.
Three kinds of box readers are kept apart, as their grammars differ.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that Unicode calls white space.
WS = r"[\t\n\x{0B}\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"

# Names of task families and their aliases in the two maps.
REWARD_TASKS = {
    "bit": "bit_manipulation",
    "cipher": "text_cipher",
    "numeral": "numeral_system",
    "gravity": "gravity_physics",
    "equation_symbolic": "symbolic_equation",
    "equation_numeric": "symbolic_equation",
}
MANIFEST_TASKS = {
    "gravity": "gravity_physics",
    "cipher": "text_cipher",
    "numeral": "numeral_system",
    "equation_or_cryptarithm": "symbolic_equation",
}


def text_of(c: Column) -> Column:
    """Null as the empty string."""
    return F.coalesce(c.cast("string"), F.lit(""))


def strip_ws(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def rstrip_ws(c: Column) -> Column:
    """Without white space of any kind at the end."""
    return F.regexp_replace(c, f"{WS}+$", "")


def collapse_ws(c: Column) -> Column:
    """Stripped, and every run of white space as one space."""
    return strip_ws(F.regexp_replace(c, f"{WS}+", " "))


def normal_prompt(c: Column) -> Column:
    """Stripped, CRLF as LF; null as empty."""
    return F.replace(strip_ws(text_of(c)), F.lit("\r\n"), F.lit("\n"))


def normal_answer(c: Column) -> Column:
    """Stripped; null as empty."""
    return strip_ws(text_of(c))


def clean_answer(c: Column) -> Column:
    """Stripped with inner white space collapsed; null as empty."""
    return collapse_ws(text_of(c))


def first_filled(*cols: Column) -> Column:
    """The first column that is neither null nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cols])


def mapped(c: Column, names: dict[str, str]) -> Column:
    """``c`` by an alias map, itself where there is no entry."""
    return reduce(lambda acc, kv: F.when(c == kv[0], kv[1]).otherwise(acc), names.items(), c)


def reward_task(c: Column) -> Column:
    """Task family by the aliases of rewards; blank is ``unknown``."""
    s = strip_ws(text_of(c))
    return F.coalesce(F.nullif(mapped(s, REWARD_TASKS), F.lit("")), F.lit("unknown"))


def manifest_task(c: Column) -> Column:
    """Task family by the aliases of manifests."""
    return mapped(c, MANIFEST_TASKS)


def _ladder(rungs: list[tuple[str, Column]], default: str) -> Column:
    """The name of the first rung that holds."""
    return reduce(lambda acc, r: F.when(r[1], r[0]).otherwise(acc), reversed(rungs), F.lit(default))


def corpus_class(prompt: Column) -> Column:
    """Twelve classes of a prompt; null is ``other``."""
    t = F.lower(text_of(prompt))

    def has(*needles: str) -> Column:
        return reduce(lambda a, b: a | b, (t.contains(n) for n in needles))

    # Needles in order.
    return _ladder(
        [
            ("bit_manipulation", has("bit manipulation", "8-bit binary")),
            ("text_cipher", has("secret encryption", "used on text")),
            ("numeral_system", has("different numeral system")),
            ("gravity_physics", has("gravitational constant")),
            ("unit_conversion", has("unit conversion")),
            ("symbolic_equation", has("transformation rules is applied to equations")),
            ("symbol_transformation", has("symbol") & has("transformation")),
            ("algebra", has("equation", "algebra", "solve for")),
            ("sequence", has("sequence")),
            ("roman_numerals", has("roman")),
            ("base_conversion", has("base") & has("number")),
        ],
        "other",
    )


def audit_class(prompt: Column) -> Column:
    """Seven classes of a prompt, by the ladder of audits; null is ``unknown``."""
    t = F.lower(text_of(prompt))
    # Needles in order.
    return _ladder(
        [
            ("bit_manipulation", t.contains("bit manipulation") | t.contains("8-bit")),
            ("text_cipher", t.contains("secret encryption rules are used on text") | t.contains("decrypt the following text")),
            ("numeral_system", t.contains("roman")),
            ("gravity_physics", t.contains("distance") & t.contains("for t =")),
            ("unit_conversion", t.contains("convert the following measurement")),
            ("symbolic_equation", t.contains("secret set of transformation rules is applied to equations")),
        ],
        "unknown",
    )


def answer_shape(answer: Column) -> Column:
    """binary, number, roman, text or other; null reads as the word None."""
    s = strip_ws(F.coalesce(answer, F.lit("None")))
    return _ladder(
        [
            ("binary", s.rlike(r"^[01]+\z")),
            ("number", s.rlike(r"^-?[0-9]+(\.[0-9]+)?\z")),
            ("roman", s.rlike(r"^(?i)[ivxlcdm]+\z")),
            ("text", s.rlike(r"^(?i)[a-z ]+\z")),
        ],
        "other",
    )


def prefix(c: Column, n: int = 180) -> Column:
    """First ``n`` characters of the collapsed text."""
    return F.substring(collapse_ws(text_of(c)), 1, n)


# boxes ------------------------------------------------------------------------


def has_box(c: Column) -> Column:
    return F.coalesce(c.contains("\\boxed{"), F.lit(False))


def count_boxes(c: Column) -> Column:
    """How often a box is opened."""
    return ((F.length(c) - F.length(F.replace(c, F.lit("\\boxed{"), F.lit("")))) / 7).cast("int")


def flat_boxes(c: Column) -> Column:
    """Stripped contents of all boxes without inner braces, empty ones kept."""
    return F.transform(F.regexp_extract_all(text_of(c), F.lit(r"\\boxed\{([^{}]*)\}"), 1), strip_ws)


def final_box(c: Column) -> Column:
    """The last flat box that isn't empty, else empty."""
    return F.coalesce(F.try_element_at(F.filter(flat_boxes(c), lambda x: x != ""), F.lit(-1)), F.lit(""))


def closing_box(c: Column) -> Column:
    """From the first box to the last brace, for texts that end with one; else empty."""
    return F.regexp_extract(text_of(c), rf"(?s)\\boxed\{{(.*)\}}{WS}*\z", 1)


def append_box(completion: Column, answer: Column) -> Column:
    """The completion with the answer in a box behind it."""
    return F.concat(rstrip_ws(completion), F.lit("\n\n\\boxed{"), answer, F.lit("}"))


def ensure_box(completion: Column, answer: Column) -> tuple[Column, Column]:
    """(completion with a box, flags): a text with a box stays."""
    text = text_of(completion)
    boxed = F.when(has_box(text), text).otherwise(append_box(text, text_of(answer)))
    many = F.when(count_boxes(text) > 1, F.array(F.lit("multiple_boxed"))).otherwise(F.array().cast("array<string>"))
    return boxed, F.when(has_box(text), many).otherwise(F.array(F.lit("boxed_appended")))


# flags --------------------------------------------------------------------------


def split_flags(c: Column) -> Column:
    """Parts of a ``;``-joined string, empty ones dropped, repeated ones kept."""
    return F.filter(F.split(text_of(c), ";"), lambda x: x != "")


def join_flags(*flags: Column) -> Column:
    """Flags (null where not set) as one ``;``-joined string in order, each once."""
    return F.array_join(F.array_distinct(F.array_compact(F.array(*flags))), ";")


# Flags that keep a record out of training.
FILTER_FLAGS = ("no_train_join", "prompt_mismatch", "source_answer_mismatch", "final_boxed_mismatch", "no_boxed", "oracle_true", "reasoning_full_disabled")


# answers -------------------------------------------------------------------------

NUMBER = r"^-?[0-9]+(\.[0-9]+)?\z"


def number_of(c: Column) -> Column:
    """A plain decimal as double, null otherwise."""
    return F.when(c.rlike(NUMBER), c.try_cast("double"))


def stated_answer(text: Column, boxes: Column, generated: Column | None = None) -> Column:
    """A given answer, else the last box, else what follows ``final answer:`` or ``answer:``, else empty."""
    lines = [
        F.regexp_extract(text_of(text), rf"(?im)final answer{WS}*[:=]{WS}*([^\n]+)$", 1),
        F.regexp_extract(text_of(text), rf"(?im)answer{WS}*[:=]{WS}*([^\n]+)$", 1),
    ]
    given = [clean_answer(generated)] if generated is not None else []
    last = F.try_element_at(boxes, F.lit(-1))
    found = [F.nullif(x, F.lit("")) for x in given]
    return F.coalesce(*found, F.when(F.size(boxes) > 0, collapse_ws(last)), *[F.nullif(collapse_ws(x), F.lit("")) for x in lines], F.lit(""))


def _float(c: Column) -> Column:
    """Text as a double the way a plain float parser reads it: underscores between digits, inf and nan allowed, type suffixes not."""
    low = F.lower(c)
    plain = F.when(low.rlike(r"^[+-]?([0-9]+(_[0-9]+)*)?(\.([0-9]+(_[0-9]+)*)?)?(e[+-]?[0-9]+)?\z") & low.rlike("[0-9]"), F.replace(low, F.lit("_"), F.lit("")).try_cast("double"))
    endless = F.when(low.rlike(r"^\+?(inf|infinity)\z"), F.lit(float("inf"))).when(low.rlike(r"^-(inf|infinity)\z"), F.lit(float("-inf")))
    return F.coalesce(plain, endless, F.when(low.rlike(r"^[+-]?nan\z"), F.lit(float("nan"))))


def same_answer(stored: Column, given: Column) -> Column:
    """Binary answers exactly, numbers within 1 percent or 1e-5, all else without case; NaN equals nothing."""
    s, g = strip_ws(stored), strip_ws(given)
    a, b = _float(s), _float(g)
    near = ~F.isnan(a) & ~F.isnan(b) & ((a == b) | ((F.abs(a - b) <= F.greatest(F.lit(0.01) * F.greatest(F.abs(a), F.abs(b)), F.lit(1e-5))) & (F.abs(a) < float("inf")) & (F.abs(b) < float("inf"))))
    same = F.lower(s) == F.lower(g)
    return F.when(s.rlike(r"^[01]+\z"), same).when(a.isNotNull() & b.isNotNull(), near).otherwise(same)


def bit_share(answer: Column, given: Column) -> Column:
    """Share of equal places of two bit strings over the longer length; 0 for anything else."""
    places = F.zip_with(F.split(answer, ""), F.split(given, ""), lambda x, y: F.coalesce((x == y).cast("int"), F.lit(0)))
    hits = F.aggregate(places, F.lit(0), lambda acc, x: acc + x)
    longest = F.greatest(F.length(answer), F.length(given))
    return F.when(given.rlike(r"^[01]+\z") & (F.length(answer) > 0), hits / longest).otherwise(0.0)


def number_share(answer: Column, given: Column) -> Column:
    """1 for equal numbers down to 0 at a relative error of a quarter; null unless both are numbers."""
    a, b = number_of(answer), number_of(given)
    off = F.abs(a - b) / F.greatest(F.abs(a), F.lit(1.0))
    return F.when(off.isNotNull(), F.greatest(F.lit(0.0), 1.0 - F.least(off / 0.25, F.lit(1.0))))


# numerals and formats ---------------------------------------------------------------

# Roman digits of each decimal place.
_ROMAN = [("I", "V", "X"), ("X", "L", "C"), ("C", "D", "M")]


def roman(n: Column) -> Column:
    """Roman numeral of a positive whole number, empty for 0."""
    parts = [F.repeat(F.lit("M"), F.floor(n / 1000).cast("int"))]
    for place in (2, 1, 0):
        one, five, ten = _ROMAN[place]
        d = F.floor(n / 10**place).cast("int") % 10
        forms = [one * k if k < 4 else one + five if k == 4 else five + one * (k - 5) if k < 9 else one + ten for k in range(10)]
        parts.append(F.element_at(F.array(*[F.lit(x) for x in forms]), d + 1))
    return F.concat(*parts)


def bits8(n: Column) -> Column:
    """The low eight bits as text."""
    return F.lpad(F.bin(n.bitwiseAND(255)), 8, "0")


def stable_hash(seed: int, *parts: Column) -> Column:
    """Hex digest of the parts and the seed, null parts as the word None; sorts as the number does."""
    return F.sha2(F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("None")) for p in parts], F.lit(str(seed))), 256)
