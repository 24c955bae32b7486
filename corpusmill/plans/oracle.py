"""The core queries in DuckDB's SQL."""

from __future__ import annotations

from corpusmill.functions.text import FILTER_FLAGS, MANIFEST_TASKS, REWARD_TASKS, WS  # noqa: F401
from corpusmill.operators import harvest, tails
from corpusmill.plans.queries import HARD, PRIORITY, SEED, SUFFIXES


def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def _squash(x: str) -> str:
    return _strip(f"regexp_replace({x}, '{WS}+', ' ', 'g')")


def _prompt(x: str) -> str:
    return f"replace({_strip(f"coalesce({x}, '')")}, chr(13) || chr(10), chr(10))"


_BOXES = rf"list_transform(regexp_extract_all(coalesce(completion, ''), '\\boxed\{{([^{{}}]*)\}}', 1), lambda b: {_strip('b')})"
_FINAL = f"coalesce(list_filter({_BOXES}, lambda b: b <> '')[-1], '')"


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _case(x: str, names: dict[str, str]) -> str:
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + f" ELSE {x} END"


def _float(x: str) -> str:
    low = f"lower({x})"
    plain = rf"CASE WHEN regexp_full_match({low}, '[+-]?([0-9]+(_[0-9]+)*)?(\.([0-9]+(_[0-9]+)*)?)?(e[+-]?[0-9]+)?') AND regexp_matches({low}, '[0-9]') THEN try_cast(replace({low}, '_', '') AS double) END"
    return f"coalesce({plain}, CASE WHEN regexp_full_match({low}, '[+]?(inf|infinity)') THEN 'inf'::double WHEN regexp_full_match({low}, '-(inf|infinity)') THEN '-inf'::double WHEN regexp_full_match({low}, '[+-]?nan') THEN 'nan'::double END)"


_FAMILY = r"""CASE WHEN regexp_matches(prompt, '(?i)write the number\s+\d+') THEN 'numeral_system'
  WHEN regexp_matches(prompt, 'For t = [0-9.]+s, distance') THEN 'gravity_physics'
  WHEN regexp_matches(prompt, '[0-9.]+ m becomes ') THEN 'unit_conversion'
  WHEN regexp_matches(prompt, '[01]{8} -> [01]{8}') THEN 'bit_manipulation'
  WHEN regexp_matches(prompt, '(?m)^[a-z ]+ -> [a-z ]+$') THEN 'text_cipher'
  WHEN regexp_matches(prompt, '(?m)^\S{5} = \S+$') THEN 'symbolic_equation' ELSE 'unknown' END"""

_CORPUS = """CASE WHEN t LIKE '%bit manipulation%' OR t LIKE '%8-bit binary%' THEN 'bit_manipulation'
  WHEN t LIKE '%secret encryption%' OR t LIKE '%used on text%' THEN 'text_cipher'
  WHEN t LIKE '%different numeral system%' THEN 'numeral_system'
  WHEN t LIKE '%gravitational constant%' THEN 'gravity_physics'
  WHEN t LIKE '%unit conversion%' THEN 'unit_conversion'
  WHEN t LIKE '%transformation rules is applied to equations%' THEN 'symbolic_equation'
  WHEN t LIKE '%symbol%' AND t LIKE '%transformation%' THEN 'symbol_transformation'
  WHEN t LIKE '%equation%' OR t LIKE '%algebra%' OR t LIKE '%solve for%' THEN 'algebra'
  WHEN t LIKE '%sequence%' THEN 'sequence' WHEN t LIKE '%roman%' THEN 'roman_numerals'
  WHEN t LIKE '%base%' AND t LIKE '%number%' THEN 'base_conversion' ELSE 'other' END"""

_AUDIT = """CASE WHEN t LIKE '%bit manipulation%' OR t LIKE '%8-bit%' THEN 'bit_manipulation'
  WHEN t LIKE '%secret encryption rules are used on text%' OR t LIKE '%decrypt the following text%' THEN 'text_cipher'
  WHEN t LIKE '%roman%' THEN 'numeral_system' WHEN t LIKE '%distance%' AND t LIKE '%for t =%' THEN 'gravity_physics'
  WHEN t LIKE '%convert the following measurement%' THEN 'unit_conversion'
  WHEN t LIKE '%secret set of transformation rules is applied to equations%' THEN 'symbolic_equation' ELSE 'unknown' END"""

_ROMAN_LISTS = [
    ["", "C", "CC", "CCC", "CD", "D", "DC", "DCC", "DCCC", "CM"],
    ["", "X", "XX", "XXX", "XL", "L", "LX", "LXX", "LXXX", "XC"],
    ["", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX"],
]


def _roman(n: str) -> str:
    places = " || ".join(f"['{"','".join(x)}'][(({n}) // {10 ** (2 - i)} % 10 + 1)::int]" for i, x in enumerate(_ROMAN_LISTS))
    return f"repeat('M', (({n}) // 1000)::int) || {places}"


def _first_by(table: str, key: str, order: str) -> str:
    return f"(SELECT * FROM {table} QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY {order}) = 1)"


_GOLD = "(SELECT t.*, gold FROM traces t JOIN (SELECT id, max(answer) AS gold FROM train_puzzles WHERE id IS NOT NULL GROUP BY id) g ON t.id = g.id)"

_SCORED = f"""(SELECT *, coalesce(nullif(task_type, ''), 'unknown') AS task, hard_tail_score AS score,
    CASE WHEN mean_logprob IS NOT NULL AND isfinite(mean_logprob) THEN mean_logprob ELSE 0.0 END AS mean
  FROM {_first_by(HARD, "row_index", "arrived_at NULLS FIRST")}
  WHERE hard_tail_score IS NOT NULL AND isfinite(hard_tail_score)
    AND NOT list_has_any(string_split(coalesce(quality_flags, ''), ';'), ['truncated', 'prefix_mismatch']))"""

_CANDIDATES = f"""
WITH t AS (SELECT id AS train_id, prompt AS tp, answer AS ta FROM train_puzzles),
by_id AS (SELECT * FROM t WHERE train_id <> '' QUALIFY row_number() OVER (PARTITION BY train_id ORDER BY (train_id, tp, ta) DESC) = 1),
by_text AS (SELECT *, {_prompt("tp")} AS k FROM t WHERE {_prompt("tp")} <> '' QUALIFY row_number() OVER (PARTITION BY {_prompt("tp")} ORDER BY (train_id, tp, ta) DESC) = 1),
j AS (SELECT x.*, coalesce(a.train_id, b.train_id) AS tid, coalesce(a.tp, b.tp) AS tp, coalesce(a.ta, b.ta) AS ta
  FROM traces x LEFT JOIN by_id a ON x.id = a.train_id LEFT JOIN by_text b ON a.train_id IS NULL AND {_prompt("x.prompt")} = b.k),
c AS (SELECT *, {_prompt("prompt")} AS rp, {_strip("coalesce(answer, '')")} AS ra,
    CASE WHEN tid IS NOT NULL THEN {_prompt("tp")} ELSE {_prompt("prompt")} END AS p,
    {_strip("CASE WHEN tid IS NOT NULL THEN coalesce(ta, '') ELSE coalesce(answer, '') END")} AS a, {_BOXES} AS boxes, {_FINAL} AS box FROM j),
f AS (SELECT *, list_filter([
    CASE WHEN tid IS NULL THEN 'no_train_join' END,
    CASE WHEN tid IS NOT NULL AND rp <> '' AND rp = p THEN 'prompt_match' END,
    CASE WHEN tid IS NOT NULL AND rp <> '' AND rp <> p THEN 'prompt_mismatch' END,
    CASE WHEN tid IS NOT NULL AND rp = '' THEN 'prompt_from_train' END,
    CASE WHEN tid IS NOT NULL AND ra <> '' AND ra = a THEN 'source_answer_match' END,
    CASE WHEN tid IS NOT NULL AND ra <> '' AND ra <> a THEN 'source_answer_mismatch' END,
    CASE WHEN tid IS NOT NULL AND ra = '' THEN 'answer_from_train' END,
    CASE WHEN len(boxes) > 1 THEN 'multiple_boxed' END,
    CASE WHEN len(boxes) > 0 AND box = a THEN 'final_boxed_match' END,
    CASE WHEN len(boxes) > 0 AND box <> a THEN 'final_boxed_mismatch' END,
    CASE WHEN len(boxes) = 0 AND a <> '' THEN 'boxed_appended' END,
    CASE WHEN len(boxes) = 0 AND a = '' THEN 'no_boxed' END,
    CASE WHEN method = 'replay' THEN 'oracle_true' END], lambda x: x IS NOT NULL) AS flags FROM c),
cand AS (SELECT trace_id AS row, coalesce(tid, nullif(id, ''), 'row_' || lpad(trace_id::varchar, 6, '0')) AS id, source, p, flags,
    lower(p) AS t, task_type, array_to_string(flags, ';') AS quality_flags, NOT list_has_any(flags, [{", ".join(f"'{x}'" for x in FILTER_FLAGS)}]) AS enabled,
    length(CASE WHEN len(boxes) = 0 AND a <> '' THEN regexp_replace(coalesce(completion, ''), '{WS}+$', '') || chr(10) || chr(10) || '\\boxed{{' || a || '}}' ELSE coalesce(completion, '') END) AS n_chars FROM f)
""".replace("'\\\\boxed{'", "'\\boxed{'")


def _has(*names: str) -> str:
    return "sum(" + " + ".join(f"list_contains(flags, '{n}')::bigint" for n in names) + ")::bigint"


def _partials() -> str:
    a, g = _squash("gold"), _squash(_FINAL)
    num = r"'-?[0-9]+(\.[0-9]+)?'"
    return f"""SELECT trace_id,
      round(CASE WHEN regexp_full_match(g, '[01]+') AND length(a) > 0 THEN
        coalesce(list_sum(list_transform(range(1, least(length(a), length(g)) + 1), lambda i: (a[i:i] = g[i:i])::int)), 0) / greatest(length(a), length(g))::double ELSE 0.0 END, 9) AS bit_share,
      round(CASE WHEN regexp_full_match(a, {num}) AND regexp_full_match(g, {num}) THEN
        greatest(0.0, 1.0 - least(abs(a::double - g::double) / greatest(abs(a::double), 1.0) / 0.25, 1.0)) END, 9) AS number_share
    FROM (SELECT trace_id, {a} AS a, {g} AS g FROM {_GOLD})"""


def _same() -> str:
    s, g = _strip("gold"), _strip("answer")
    return f"""SELECT trace_id, CASE WHEN regexp_full_match(s, '[01]+') THEN lower(s) = lower(g)
        WHEN x IS NOT NULL AND y IS NOT NULL THEN NOT isnan(x) AND NOT isnan(y) AND (x = y OR (isfinite(x) AND isfinite(y) AND abs(x - y) <= greatest(0.01 * greatest(abs(x), abs(y)), 1e-5)))
        ELSE lower(s) = lower(g) END AS same
      FROM (SELECT trace_id, s, g, {_float("s")} AS x, {_float("g")} AS y FROM (SELECT trace_id, {s} AS s, {g} AS g FROM {_GOLD} WHERE answer IS NOT NULL))"""


def _cosine() -> str:
    def grams(x: str) -> str:
        return f"list_transform(range(1, length({x}) - 1), lambda i: substr({x}, i::int, 3))"

    def text(x: str) -> str:
        return f"'  ' || lower({_squash(f"coalesce({x}, '')")}) || '  '"

    def count(g: str, xs: str) -> str:
        return f"len(list_filter({xs}, lambda q: q = {g}))"

    norm = "list_sum(list_transform(list_distinct({0}), lambda g: " + count("g", "{0}") + " * " + count("g", "{0}") + "))"
    return f"""SELECT trace_id, round(dot / sqrt((na * nb)::double), 6) AS cosine FROM (
      SELECT trace_id, coalesce(list_sum(list_transform(list_distinct(a), lambda g: {count("g", "a")} * {count("g", "b")})), 0) AS dot, {norm.format("a")} AS na, {norm.format("b")} AS nb
      FROM (SELECT trace_id, {grams("x")} AS a, {grams("y")} AS b FROM (SELECT trace_id, {text("gold")} AS x, {text(_FINAL)} AS y FROM {_GOLD})))"""


def _relaxed() -> str:
    c = ", ".join(f"coalesce({x}, '') AS {x}" for x in ("id", "source", "method", "task_type"))
    single = "(SELECT id, second, min(row) AS one FROM offers GROUP BY id, second HAVING count(*) = 1)"
    joins = " ".join(f"LEFT JOIN {single} s{i} ON a.id = s{i}.id AND s{i}.second = {k}" for i, k in enumerate(("a.method", "a.task_type", "''")))
    return f"""WITH m AS (SELECT {c}, trace_id AS row FROM traces), a AS (SELECT row_index, arrived_at, {c} FROM {HARD}),
      strict AS (SELECT id, source, method, max(row) AS row FROM m GROUP BY ALL),
      offers AS (SELECT id, row, unnest([method, task_type, '']) AS second FROM m)
      SELECT row_index, arrived_at, coalesce(st.row, s0.one, s1.one, s2.one) AS match_row,
        CASE WHEN st.row IS NOT NULL THEN 'strict' WHEN s0.one IS NOT NULL THEN 'relaxed:' || coalesce(nullif(a.method, ''), 'id')
          WHEN s1.one IS NOT NULL THEN 'relaxed:' || coalesce(nullif(a.task_type, ''), 'id') WHEN s2.one IS NOT NULL THEN 'relaxed:id' ELSE 'missing' END AS manifest_match
      FROM a LEFT JOIN strict st ON a.id = st.id AND a.source = st.source AND a.method = st.method {joins}"""


def _decision() -> str:
    def hits(p: str) -> str:
        return f"coalesce(sum(regexp_matches(coalesce(worst_context, ''), '{p}')::double), 0.0)"

    named = " OR ".join(f"contains(lower(coalesce(source, '')), '{s}')" for s in ("mossgate", "oakrill"))
    return f"""WITH s AS (SELECT * FROM {_SCORED} WHERE score < -10), w AS (SELECT * FROM s WHERE score < -14),
      a AS (SELECT greatest(count(*), 1) AS n, coalesce(sum(contains(lower(task), 'bit')::double), 0) AS bt, coalesce(sum(({named})::double), 0) AS bs,
        coalesce(sum((contains(lower(task), 'symbolic') OR contains(lower(task), 'equation'))::double), 0) AS st,
        coalesce(sum(len(list_filter(string_split(coalesce(quality_flags, ''), ';'), lambda f: f IN {_in(tails.FORMAT_FLAGS)}))::double), 0) AS ff FROM s),
      b AS (SELECT greatest(count(*), 1) AS m, {hits(tails.BIT)} AS bc, {hits(tails.SYMBOLIC)} AS sc, {hits(tails.FORMAT)} AS fc FROM w),
      p AS (SELECT unnest(['symbolic_operator', 'bit_repair', 'formatting_repair', 'adapter_arithmetic']) AS path,
        unnest([st / n + 0.35 * sc / m, bt / n + 0.25 * bs / n + 0.35 * bc / m, 0.5 * ff / n + 0.6 * fc / m, 0.05]) AS score FROM a, b),
      o AS (SELECT *, row_number() OVER (ORDER BY score DESC, path DESC) AS k FROM p),
      t AS (SELECT max(CASE WHEN k = 1 THEN score END) AS s1, max(CASE WHEN k = 2 THEN score END) AS s2, max(CASE WHEN k = 1 THEN path END) AS p1 FROM o)
      SELECT path, round(score, 9) AS score, CASE WHEN s1 < 0.25 OR s1 - s2 < 0.08 THEN 'inspect_manually' ELSE p1 END AS chosen FROM p, t"""


def _worst_tokens() -> str:
    def top(col: str, out: str) -> str:
        return f"""(SELECT token, string_agg(name || ':' || k, '|' ORDER BY r) AS {out} FROM (
          SELECT token, name, k, row_number() OVER (PARTITION BY token ORDER BY k DESC, name) AS r FROM (
            SELECT token, {col} AS name, count(*) AS k FROM d GROUP BY ALL)) WHERE r <= 5 GROUP BY token)"""

    return f"""WITH d AS (SELECT worst_context AS token, min_logprob AS v, coalesce(source, '') AS source, coalesce(task_type, '') AS task, row_index AS row
        FROM {_SCORED} WHERE worst_context IS NOT NULL AND min_logprob IS NOT NULL AND isfinite(min_logprob)),
      e AS (SELECT token, string_agg(row::varchar, '|' ORDER BY row) AS examples FROM (SELECT token, row FROM d QUALIFY row_number() OVER (PARTITION BY token ORDER BY row) <= 5) GROUP BY token)
      SELECT token, count(*) AS n, round(avg(v) * count(*), 6) / count(*) AS mean_score, min(v) AS min_score, any_value(top_sources) AS top_sources, any_value(top_tasks) AS top_tasks, any_value(examples) AS examples
      FROM d JOIN {top("source", "top_sources")} USING (token) JOIN {top("task", "top_tasks")} USING (token) JOIN e USING (token) GROUP BY token"""


def _rates() -> str:
    dec = r"([0-9]+(?:\.[0-9]+)?)"

    def rates(kind: str, pair: str, target: str, power: int) -> str:
        def each(k: int) -> str:
            return f"list_transform(regexp_extract_all(prompt, '{pair}', {k}), lambda v: v::double)"

        x = "x" if power == 1 else "(x * x)"
        return f"""SELECT k, id, answer, '{kind}' AS family, CASE WHEN len(xs) > 0 AND length(tt) > 0 AND list_min(xs) > 0 THEN printf('%.2f', rate * t{' * t' * (power - 1)}) END AS prediction FROM (
          SELECT *, CASE WHEN lo <= hi THEN (lo + hi) / 2 ELSE sxy / sxx END AS rate, try_cast(tt AS double) AS t FROM (
            SELECT *, list_max(list_transform(list_zip(xs, ys), lambda p: (p[2] - 0.005) / p[1])) AS lo, list_min(list_transform(list_zip(xs, ys), lambda p: (p[2] + 0.005) / p[1])) AS hi,
              list_sum(list_transform(list_zip(xs, ys), lambda p: p[1] * p[2])) AS sxy, list_sum(list_transform(xs, lambda x: x * x)) AS sxx FROM (
              SELECT k, id, answer, list_transform({each(1)}, lambda x: {x}) AS xs, {each(2)} AS ys, regexp_extract(prompt, '{target}', 1) AS tt FROM f WHERE family = '{kind}')))"""

    fall = rates("gravity_physics", rf"For t = {dec}s, distance = {dec} m", rf"(?i)determine the falling distance for t = {dec}s", 2)
    unit = rates("unit_conversion", rf"{dec} m becomes {dec}", rf"(?i)convert the following measurement:\s*{dec} m", 1)
    return f"""WITH f AS (SELECT row_number() OVER () AS k, *, {_FAMILY} AS family FROM train_puzzles), r AS ({fall} UNION ALL {unit})
      SELECT id, family, prediction, coalesce(prediction IS NOT NULL AND CASE WHEN regexp_full_match(trim(coalesce(answer, '')), '[01]+') THEN trim(answer) = prediction
        ELSE abs(try_cast(answer AS double) - prediction::double) <= greatest(0.01 * greatest(abs(try_cast(answer AS double)), abs(prediction::double)), 1e-5) END, false) AS correct FROM r"""


def oracle_sql() -> dict[str, str]:
    usable = "input_ids IS NOT NULL AND loss_mask IS NOT NULL AND len(input_ids) > 0 AND len(input_ids) = len(loss_mask)"
    page = r"concat(coalesce(text, ''), chr(10) || 'Merged adapter of ', coalesce(source, ''), ': see https://www.Example.org/datasets/', coalesce(source, ''), '/', doc_id::varchar, '. Its reward, rewards.')"
    url = r'''(?i)https?://[^\s\]\)\}"''<>\\]+'''
    urls = f"list_transform(regexp_extract_all({page}, '{url}'), lambda u: regexp_replace(regexp_replace(u, '\\\\[nrt].*', ''), '[.,;:!?)\\]}}''\"`]+$', ''))"
    priority = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " ELSE 99 END"
    even = "SELECT vec_id::varchar AS key, label, embedding::double[] AS data FROM embeddings WHERE vec_id % 2 = 0"
    odd = "SELECT (vec_id - 1)::varchar AS key, embedding::double[] AS data FROM embeddings WHERE vec_id % 2 = 1"
    pats = ", ".join(f"('{p}', {v}::double)" for p, v in SUFFIXES)
    kw = {k: f"len(regexp_extract_all({page}, '(?i){p}'))" for k, p in harvest.KEYWORDS.items()}
    cosine = "CASE WHEN sqrt(list_dot_product(a, a) * list_dot_product(b, b)) = 0 THEN CASE WHEN a = b THEN 1.0 ELSE 0.0 END ELSE list_dot_product(a, b) / sqrt(list_dot_product(a, a) * list_dot_product(b, b)) END"
    sql = {
        "prompt_classes": f"SELECT trace_id, {_CORPUS} AS corpus_class, {_AUDIT} AS audit_class FROM (SELECT trace_id, lower(coalesce(prompt, '')) AS t FROM traces)",
        "class_heads": f"SELECT * FROM (SELECT id, family, prefix, row_number() OVER (PARTITION BY family ORDER BY id, prefix)::int AS place FROM (SELECT DISTINCT id, {_FAMILY} AS family, substr({_squash('prompt')}, 1, 180) AS prefix FROM train_puzzles)) WHERE place <= 5",
        "answer_shapes": rf"""SELECT trace_id, CASE WHEN regexp_full_match(s, '[01]+') THEN 'binary' WHEN regexp_full_match(s, '-?[0-9]+(\.[0-9]+)?') THEN 'number'
          WHEN regexp_full_match(s, '(?i)[ivxlcdm]+') THEN 'roman' WHEN regexp_full_match(s, '(?i)[a-z ]+') THEN 'text' ELSE 'other' END AS shape FROM (SELECT trace_id, {_strip("coalesce(answer, 'None')")} AS s FROM traces)""",
        "normal_forms": f"""SELECT trace_id, {_prompt('prompt')} AS prompt_n, {_strip("coalesce(answer, '')")} AS answer_n, {_squash("coalesce(answer, '')")} AS answer_c,
          coalesce(nullif({_case('k', REWARD_TASKS)}, ''), 'unknown') AS task_n FROM (SELECT *, {_strip("coalesce(task_type, '')")} AS k FROM traces)""",
        "train_overlap": f"SELECT trace_id, coalesce(id IN (SELECT id FROM train_puzzles WHERE id IS NOT NULL), false) AS id_known, {_prompt('prompt')} IN (SELECT {_prompt('prompt')} FROM train_puzzles) AS prompt_known FROM traces",
        "flat_boxes": rf"SELECT trace_id, len({_BOXES})::int AS n_boxes, {_FINAL} AS final_box, coalesce(regexp_extract(coalesce(completion, ''), '(?s)\\boxed\{{(.*)\}}{WS}*$', 1), '') AS closing_box FROM traces",
        "ensured_boxes": rf"""SELECT trace_id, CASE WHEN n > 0 THEN c ELSE regexp_replace(c, '{WS}+$', '') || chr(10) || chr(10) || '\boxed{{' || coalesce(answer, '') || '}}' END AS completion,
          CASE WHEN n > 1 THEN 'multiple_boxed' WHEN n = 1 THEN '' ELSE 'boxed_appended' END AS flags
          FROM (SELECT trace_id, answer, coalesce(completion, '') AS c, (length(coalesce(completion, '')) - length(replace(coalesce(completion, ''), '\boxed{{', ''))) // 7 AS n FROM traces)""",
        "stated_answers": rf"""SELECT trace_id, CASE WHEN len({_BOXES}) > 0 THEN {_squash(f"{_BOXES}[-1]")} ELSE
          coalesce(nullif({_squash(f"regexp_extract(coalesce(completion, ''), '(?im)final answer{WS}*[:=]{WS}*([^\n]+)$', 1)")}, ''), {_squash(f"regexp_extract(coalesce(completion, ''), '(?im)answer{WS}*[:=]{WS}*([^\n]+)$', 1)")}, '') END AS stated FROM traces""",
        "same_answers": _same(),
        "partial_scores": _partials(),
        "roman_numerals": f"SELECT o_orderkey, {_roman('o_orderkey % 3999 + 1')} AS roman, right('00000000' || bin(o_orderkey & 255), 8) AS bits FROM orders",
        "trigram_cosines": _cosine(),
        "candidate_flags": f"{_CANDIDATES} SELECT row, id, coalesce(nullif(coalesce(task_type, ''), ''), {_AUDIT}) AS task_type, quality_flags, enabled, n_chars::int AS n_chars FROM cand",
        "source_stats": f"""{_CANDIDATES} SELECT source, count(*) AS raw_rows, count(*) - {_has('no_train_join')} AS train_joined, {_has('prompt_match', 'prompt_from_train')} AS prompt_match,
          {_has('source_answer_match', 'answer_from_train')} AS source_answer_match, count(*) - {_has('boxed_appended', 'no_boxed')} AS boxed_checked, {_has('final_boxed_match')} AS boxed_match,
          {_has('final_boxed_mismatch')} AS boxed_mismatch, {_has('boxed_appended')} AS boxed_appended, {_has('oracle_true')} AS oracle_true, sum(enabled::bigint)::bigint AS enabled_rows FROM cand GROUP BY source""",
        "flag_counts": f"{_CANDIDATES} SELECT source, flag, count(*) AS n FROM (SELECT source, unnest(flags) AS flag FROM cand WHERE NOT enabled) WHERE flag IN {_in(FILTER_FLAGS)} GROUP BY ALL",
        "kept_records": f"""SELECT trace_id, id, source FROM traces WHERE source IN {_in(PRIORITY)} AND id IN (SELECT id FROM train_puzzles WHERE id IS NOT NULL) AND {_strip("coalesce(prompt, '')")} <> '' AND {_strip("coalesce(answer, '')")} <> ''
          AND NOT list_has_any(string_split(coalesce(quality_flags, ''), ';'), ['no_boxed', 'multiple_boxed'])""",
        "relaxed_matches": _relaxed(),
        "key_winners": "SELECT id, min(trace_id) AS first_row, max(trace_id) AS last_row, max_by(struct_pack(a := answer), trace_id).a AS last_answer FROM traces WHERE id IS NOT NULL GROUP BY id",
        "resumed_work": """SELECT p.id, CASE WHEN e.r IS NOT NULL THEN 'existing' WHEN b.r IS NOT NULL THEN 'base' ELSE 'todo' END AS origin, coalesce(e.r, b.r) AS done_row
          FROM (SELECT DISTINCT id FROM train_puzzles WHERE id IS NOT NULL) p LEFT JOIN (SELECT id, max(trace_id) AS r FROM traces WHERE source = 'mossgate' GROUP BY id) e ON p.id = e.id
          LEFT JOIN (SELECT id, max(trace_id) AS r FROM traces WHERE source IN ('oakrill', 'quillmoor') GROUP BY id) b ON p.id = b.id""",
        "hash_holdout": f"""SELECT row_index, task, row_number() OVER (PARTITION BY task ORDER BY h, row_index) <= greatest(1, round_even(count(*) OVER (PARTITION BY task) * 0.08, 0)) AS held
          FROM (SELECT row_index, task, sha256(concat_ws('::', task, coalesce(id, 'None'), coalesce(source, 'None'), coalesce(method, 'None'), '{SEED}')) AS h FROM {_SCORED})""",
        "score_summary": f"SELECT count(*) AS n, min(score) AS min, round(quantile_cont(score, 0.01), 9) AS p01, round(quantile_cont(score, 0.05), 9) AS p05, round(quantile_cont(score, 0.5), 9) AS p50, round(avg(score), 9) AS mean FROM {_SCORED}",
        "repair_decision": _decision(),
        "worst_tokens": _worst_tokens(),
        "best_positives": f"""SELECT id, row AS positive, source FROM (SELECT id, trace_id AS row, source, completion FROM {_GOLD} WHERE {_FINAL} = {_strip('gold')})
          QUALIFY row_number() OVER (PARTITION BY id ORDER BY {priority}, length(coalesce(completion, '')), row) = 1""",
        "margin_sets": " UNION ALL ".join(
            f"SELECT {d} AS dim, {v} AS value, count(*) AS n, round(avg(m) * count(*), 6) / count(*) AS mean_margin, round(avg((m > 0)::double), 9) AS win_rate FROM (SELECT coalesce(source, '') AS source, coalesce(method, '') AS method, mean_logprob - min_logprob AS m FROM {_SCORED}) WHERE isfinite(m) GROUP BY ALL"
            for d, v in (("'all'", "''"), ("'source'", "source"), ("'method'", "method"))
        ),
        "margin_medians": f"SELECT coalesce(source, '') AS source, round(quantile_cont(mean_logprob - min_logprob, 0.5), 9) AS median FROM {_SCORED} WHERE isfinite(mean_logprob - min_logprob) GROUP BY 1",
        "token_examples": f"""SELECT rec_id, len(input_ids)::int AS full_len, coalesce(nullif(coalesce(list_position(loss_mask, 1), 0), 0) - 1, len(loss_mask))::int AS prompt_len, len(input_ids) > 256 AS truncated,
          least(len(input_ids), 256)::int AS n_ids, coalesce(list_sum(loss_mask[1:256]), 0)::bigint AS n_scored FROM tokenized_records WHERE {usable}""",
        "shifted_tokens": f"""SELECT rec_id, n::int AS n, list_sum(loss_mask[2:n + 1])::bigint AS weight, input_ids[2] AS first_target, input_ids[n + 1] AS last_target
          FROM (SELECT *, least(len(input_ids) - 1, 512) AS n FROM tokenized_records WHERE {usable} AND len(input_ids) >= 2) WHERE list_max(loss_mask[2:n + 1]) > 0""",
        "pad_batches": f"""SELECT rec_id, batch, length, (max(length) OVER (PARTITION BY batch) - length)::int AS pad FROM (
          SELECT rec_id, len(input_ids)::int AS length, (row_number() OVER (ORDER BY rec_id) - 1) // 32 AS batch FROM tokenized_records WHERE {usable})""",
        "token_totals": f"SELECT coalesce(source, '') AS source, count(*) AS records, sum(len(input_ids))::bigint AS n_ids, sum(coalesce(list_sum(loss_mask), 0))::bigint AS n_scored FROM tokenized_records WHERE {usable} GROUP BY 1",
        "worst_slices": """SELECT vec_id, len(s)::int AS scored, round(list_sum(s) / len(s), 6) AS mean, list_min(s) AS least, (list_position(s, list_min(s)) + 16)::int AS place,
          (least(list_position(s, list_min(s)) + 24, len(e)) - greatest(list_position(s, list_min(s)) + 8, 1) + 1)::int AS n_context FROM (SELECT vec_id, embedding::double[] AS e, embedding[17:]::double[] AS s FROM embeddings)""",
        "common_prefixes": """WITH d AS (SELECT id, rec_id, input_ids FROM tokenized_records WHERE id IS NOT NULL AND len(input_ids) > 0),
          f AS (SELECT id, rec_id AS first_rec, input_ids AS f FROM d QUALIFY row_number() OVER (PARTITION BY id ORDER BY rec_id) = 1)
          SELECT rec_id, first_rec, coalesce(list_position(list_transform(range(1, least(len(input_ids), len(f)) + 1), lambda i: input_ids[i] = f[i]), false) - 1, least(len(input_ids), len(f)))::int AS prefix FROM d JOIN f USING (id)""",
        "tensor_audit": f"""SELECT label AS category, count(*) AS tensors, sum((b IS NULL)::bigint)::bigint AS missing, sum((b IS NOT NULL AND len(a) <> len(b))::bigint)::bigint AS other_shape,
          round(avg({cosine}), 6) AS mean_cosine, round(min({cosine}), 6) AS min_cosine, round(avg(list_sum(list_transform(list_zip(a, b), lambda p: abs(p[1] - p[2]))) / len(a)), 6) AS mean_delta
          FROM (SELECT e.label, e.data AS a, o.data AS b FROM ({even}) e LEFT JOIN ({odd}) o ON e.key = o.key) GROUP BY label""",
        "tensor_overlay": f"""SELECT e.key, CASE WHEN e.key::bigint % 3 <> 0 THEN 'reference' WHEN o.data IS NULL THEN 'missing' ELSE 'source' END AS origin,
          round(list_sum(CASE WHEN e.key::bigint % 3 = 0 AND o.data IS NOT NULL THEN o.data ELSE e.data END), 5) AS total FROM ({even}) e LEFT JOIN ({odd}) o ON e.key = o.key""",
        "suffix_patterns": f"""WITH p AS (SELECT * FROM (VALUES {pats}) v(pattern, value)), h AS (SELECT DISTINCT method FROM {HARD} WHERE method IS NOT NULL),
          m AS (SELECT method, pattern, value FROM h JOIN p ON suffix(method, pattern) QUALIFY row_number() OVER (PARTITION BY method ORDER BY length(pattern) DESC) = 1)
          SELECT row_index, arrived_at, pattern, value FROM {HARD} LEFT JOIN m USING (method)""",
        "page_references": f"""SELECT doc_id, len(u)::int AS n_urls, u[1] AS first_url, CASE WHEN regexp_matches(u[1], '(?i)^https?://(www\\.)?example\\.org/') AND string_split(u[1], '/')[4] IN ('datasets', 'd')
            AND len(list_filter(string_split(u[1], '/')[4:], lambda x: x <> '')) >= 3 THEN 'dataset:' || array_to_string(list_filter(string_split(u[1], '/')[4:], lambda x: x <> '')[2:3], '/') END AS ref, n_adapter, n_reward
          FROM (SELECT doc_id, {urls} AS u, {kw["adapter"]}::int AS n_adapter, {kw["reward"]}::int AS n_reward FROM documents)""",
        "keyword_documents": " UNION ALL ".join(f"SELECT '{k}' AS keyword, count(*) AS documents, sum(n)::bigint AS hits FROM (SELECT {x} AS n FROM documents) WHERE n > 0 HAVING count(*) > 0" for k, x in kw.items()),
        "json_entries": "SELECT event_id, key, json_extract_string(props, '$.' || key) AS value FROM (SELECT event_id, props, unnest(json_keys(props)) AS key FROM events WHERE props IS NOT NULL)",
        "redacted_documents": r"""SELECT doc_id, CASE WHEN text <> '' AND NOT regexp_full_match(text, '-?[0-9]+(\.[0-9]+)?') THEN '<text:' || length(text) || '>' ELSE text END AS text,
          CASE WHEN lang <> '' AND NOT regexp_full_match(lang, '-?[0-9]+(\.[0-9]+)?') THEN '<text:' || length(lang) || '>' ELSE lang END AS lang,
          CASE WHEN source <> '' AND NOT regexp_full_match(source, '-?[0-9]+(\.[0-9]+)?') THEN '<text:' || length(source) || '>' ELSE source END AS source, n_chars, created_at, ingested_at FROM documents""",
        "text_digests": "SELECT doc_id::varchar AS path, octet_length(encode(text))::bigint AS bytes, sha256(text) AS sha256 FROM documents WHERE text IS NOT NULL",
        "plain_words": "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(line, ' ')) AS word FROM (SELECT unnest(regexp_extract_all(prompt, '(?m)^(.+?) -> ([a-z ]+)$', 2)) AS line FROM train_puzzles)) WHERE word <> '' GROUP BY word",
        "solved_numerals": f"""SELECT id, CASE WHEN n IS NOT NULL THEN {_roman('n')} END AS prediction, coalesce(lower(trim(answer)) = lower({_roman('n')}), false) AS correct FROM (
          SELECT id, answer, try_cast(regexp_extract(prompt, '(?i)write the number\\s+(\\d+)\\s+in the Wonderland numeral system', 1) AS bigint) AS n FROM train_puzzles WHERE {_FAMILY} = 'numeral_system')""",
        "solved_rates": _rates(),
    }
    # the same at the full limits
    sql["token_examples_full"] = sql["token_examples"].replace("256", "8192")
    sql["shifted_tokens_full"] = sql["shifted_tokens"].replace("512", "8191")
    return sql
