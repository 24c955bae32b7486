"""The queries of sources, sinks and pipelines in DuckDB's SQL."""

from __future__ import annotations

from corpusmill.functions.render import END, PROMPT_SUFFIX, TURN
from corpusmill.functions.text import MANIFEST_TASKS, REWARD_TASKS, WS
from corpusmill.operators import solvers
from corpusmill.plans import oracle as o
from corpusmill.plans.files import WORDS
from corpusmill.plans.queries import HARD, PRIORITY

_WORDS = str(WORDS)
_USABLE = "len(input_ids) > 0 AND len(input_ids) = len(loss_mask)"


def _flags() -> str:
    """Stored flags behind the flag of several boxes, each once and in order."""
    return f"""list_filter(list_concat(CASE WHEN len({o._BOXES}) > 1 THEN ['multiple_boxed'] ELSE [] END, string_split(coalesce(quality_flags, ''), ';')), lambda x: x <> '')"""


def _ordered_distinct(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def _mapped(x: str, names: dict[str, str]) -> str:
    return o._case(x, names)


_TASK = f"coalesce(nullif({_mapped(o._strip('''coalesce(task_type, '')'''), REWARD_TASKS)}, ''), 'unknown')"
_TRAIN = "(SELECT id, max(answer) AS answer, max(prompt) AS prompt FROM train_puzzles WHERE id <> '' AND prompt <> '' GROUP BY id)"
_KEYS = """(SELECT vec_id, label, embedding, CASE WHEN (vec_id // 2) % 2 = 0 THEN 'base' ELSE 'other' END AS adapter, vec_id // 4 AS i,
    'model.layers.' || (vec_id // 4) || '.' || ['mlp.experts.3.up_proj', 'self_attn.q_proj', 'mixer.in_proj', 'norm'][(vec_id // 4) % 4 + 1] AS module,
    CASE WHEN vec_id % 2 = 0 THEN 'lora_A' ELSE 'lora_B' END AS side FROM embeddings)"""
_KEY = "module || '.' || side || '.weight'"


def _same(a: str, b: str) -> str:
    x, y = o._float(a), o._float(b)
    return f"""CASE WHEN regexp_full_match({a}, '[01]+') THEN lower({a}) = lower({b})
      WHEN {x} IS NOT NULL AND {y} IS NOT NULL THEN NOT isnan({x}) AND NOT isnan({y}) AND ({x} = {y} OR (isfinite({x}) AND isfinite({y}) AND abs({x} - {y}) <= greatest(0.01 * greatest(abs({x}), abs({y})), 1e-5)))
      ELSE lower({a}) = lower({b}) END"""


_NUM = r"'-?[0-9]+(\.[0-9]+)?'"


def _rewards() -> str:
    """CTEs up to ``scored``: reward and flags of the traces whose answers are numbers or bits."""
    ws, text = WS, o._strip("coalesce(completion, '')")
    box = r"regexp_matches(coalesce(completion, ''), '\\boxed\{[^{}]*\{')"

    def line(w: str) -> str:
        return o._squash(f"regexp_extract({text}, '(?im){w}{ws}*[:=]{ws}*([^\\n]+)$', 1)")

    given = f"CASE WHEN len(boxes) > 0 THEN {o._squash('boxes[-1]')} ELSE coalesce(nullif({line('final answer')}, ''), {line('answer')}, '') END"
    numeric = "task IN ('gravity_physics', 'unit_conversion', 'symbolic_equation')"
    return rf"""d AS (SELECT *, {o._strip("coalesce(gold, '')")} AS a, {o._FINAL} AS final, {o._BOXES} AS boxes, {_TASK} AS task FROM {o._GOLD} WHERE NOT {box}),
      g AS (SELECT *, {o._squash("a")} AS w, {given} AS given, CASE WHEN final = a THEN 'positive' ELSE 'negative' END AS origin FROM d),
      k AS (SELECT *, regexp_full_match(w, '[01]+') AS is_bits FROM g WHERE regexp_full_match(w, '[01]+') OR (regexp_full_match(w, {_NUM}) AND regexp_full_match(given, {_NUM}))),
      e AS (SELECT *, coalesce(given <> '' AND {_same("w", "given")}, false) AS exact, CASE WHEN NOT is_bits THEN abs(w::double - given::double) / greatest(abs(w::double), 1.0) END AS off,
        task = 'bit_manipulation' AND given <> '' AND given <> w AND list_contains(regexp_extract_all(coalesce(prompt, ''), '->\s*([01]{{8}})', 1), given) AS copied FROM k),
      s AS (SELECT *, CASE WHEN is_bits THEN CASE WHEN regexp_full_match(given, '[01]+') THEN
          coalesce(list_sum(list_transform(range(1, least(length(w), length(given)) + 1), lambda i: (w[i:i] = given[i:i])::int)), 0) / greatest(length(w), length(given))::double ELSE 0.0 END
          ELSE greatest(0.0, 1.0 - least(off / 0.25, 1.0)) END AS credit,
        CASE WHEN task = 'bit_manipulation' THEN regexp_full_match(given, '[01]{{8}}') WHEN task = 'text_cipher' THEN regexp_full_match(given, '(?i)[a-z ]+') WHEN task = 'numeral_system' THEN regexp_full_match(given, '(?i)[ivxlcdm]+')
          WHEN {numeric} THEN regexp_full_match(given, {_NUM}) ELSE given <> '' END AS formed FROM e),
      scored AS (SELECT trace_id AS row, id, source, completion, origin, given AS extracted_answer,
        round(greatest(0.0, least(1.0, 0.58 * exact::int + 0.24 * credit + 0.08 * formed::int + 0.06 * (given <> '')::int + 0.04 * (len(boxes) > 0)::int + CASE WHEN copied THEN -0.3 ELSE 0.0 END)), 6)::double AS reward,
        array_to_string(list_sort(list_distinct(list_filter([CASE WHEN exact THEN 'answer_exact' ELSE 'wrong_final' END, CASE WHEN len(boxes) > 1 THEN 'multiple_boxed' END, CASE WHEN given = '' THEN 'missing_extracted_answer' END,
          CASE WHEN is_bits AND given = '' THEN 'missing_final' END, CASE WHEN is_bits AND given <> '' AND NOT regexp_full_match(given, '[01]+') THEN 'malformed_binary' END,
          CASE WHEN is_bits AND regexp_full_match(given, '[01]+') AND length(w) <> length(given) THEN 'wrong_binary_length' END, CASE WHEN off > 0.01 THEN 'numeric_outside_metric_tolerance' END], lambda x: x IS NOT NULL))), ';') AS flags FROM s)"""


def _pairs() -> str:
    rank = "CASE source " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PRIORITY.items()) + " ELSE 99 END"
    exact = "list_contains(string_split(flags, ';'), 'answer_exact')"
    return f"""WITH {_rewards()}, best AS (SELECT id, row AS chosen, reward AS up FROM scored WHERE origin = 'positive' AND {exact}
        QUALIFY row_number() OVER (PARTITION BY id ORDER BY {rank}, length(coalesce(completion, '')), row) = 1)
      SELECT n.id, chosen, n.row AS rejected, round(up - reward, 6) AS margin, CASE WHEN chosen IS NULL THEN 'no_positive_overlap' WHEN {exact} THEN 'rejected_exact_skip' WHEN round(up - reward, 6) < 0.2 THEN 'low_margin_skip' ELSE 'pair' END AS status
      FROM scored n LEFT JOIN best USING (id) WHERE n.origin = 'negative'"""


def _on_train(name: str) -> str:
    return o.oracle_sql()[name].replace("traces", "train_puzzles").replace("trace_id", "id")


def oracle_sql() -> dict[str, str]:
    turn = lambda role, x: f"'{TURN}{role}' || chr(10) || {x} || '{END}' || chr(10)"
    suffix = "'" + PROMPT_SUFFIX.replace("\n", "' || chr(10) || '") + "'"
    user = turn("user", f"coalesce(prompt, '') || {suffix}")
    head = f"{user} || '{TURN}assistant' || chr(10)"
    body = "coalesce(nullif(completion, ''), coalesce(method, '') || chr(10) || chr(10) || '\\boxed{' || coalesce(answer, '') || '}')"
    size = lambda x: f"octet_length(encode({x}))"
    return {
        "csv_rows": "SELECT nullif(id, '') AS id, nullif(answer, '') AS answer, sha256(nullif(prompt, '')) AS prompt_digest, NULL::varchar AS absent FROM train_puzzles",
        "jsonl_traces": f"""SELECT id, coalesce(nullif(source, ''), 'base') AS source, coalesce(task_type, '') AS task_type, answer, coalesce(method, '') AS method,
          array_to_string({_ordered_distinct(_flags())}, ';') AS quality_flags, sha256(completion) AS completion_digest FROM traces""",
        "csv_traces": f"""SELECT id, 'base' AS source, coalesce(task_type, '') AS task_type, coalesce(nullif(answer, ''), ({o._BOXES})[-1], '') AS answer, length(coalesce(prompt, '')) AS n_prompt,
          length(coalesce(completion, '')) AS n_completion FROM traces WHERE id <> ''""",
        "text_traces": f"""SELECT f.id, 'texts' AS source, 'txt' AS method, coalesce(t.answer, '') AS answer, CASE WHEN coalesce(t.answer, '') = '' THEN 'answer_missing' ELSE '' END AS quality_flags, sha256(f.prompt) AS completion_digest
          FROM {_TRAIN} f JOIN (SELECT id, max((prompt, answer)) AS m, (max((prompt, answer)))[2] AS answer FROM train_puzzles GROUP BY id) t USING (id)""",
        "token_lines": """WITH r AS (SELECT *, row_number() OVER (ORDER BY rec_id) AS line FROM tokenized_records WHERE input_ids IS NOT NULL AND loss_mask IS NOT NULL)
          SELECT coalesce(id, 'row_' || lpad(line::varchar, 6, '0')) AS id, 'lines' AS source, CASE WHEN rec_id % 3 > 0 THEN rec_id::varchar ELSE '' END AS answer,
            CASE WHEN rec_id % 3 > 0 THEN 'pretokenized' ELSE 'pretokenized;empty_answer' END AS quality_flags, len(input_ids)::int AS n_ids, coalesce(list_sum(loss_mask), 0)::bigint AS n_scored
          FROM r WHERE len(input_ids) = len(loss_mask)""",
        "id_filter": "SELECT trace_id, id FROM traces WHERE id IN (SELECT trim(id) FROM train_puzzles WHERE regexp_matches(answer, '^[0-9]') AND trim(id) <> '' AND NOT starts_with(trim(id), '#'))",
        "loaded_sources": """SELECT * FROM (VALUES ('base', 'oracle_jsonl', 5::bigint, true, (SELECT count(*) FROM traces)), ('plain', 'generic_csv', 0, true, (SELECT count(*) FROM traces WHERE id <> '')),
          ('texts', 'txt_dir', 7, true, (SELECT count(DISTINCT id) FROM train_puzzles WHERE id <> '')), ('gone', 'generic_csv', 1, false, 0)) v(name, kind, target, there, n)""",
        "source_kinds": "SELECT * FROM (VALUES ('a/nemo_x.jsonl', 'nemo_jsonl'), ('b/X.JSONL', 'oracle_jsonl'), ('c/formatted_train_dataset_2.csv', 'formatted_csv'), ('d/any.csv', 'generic_csv')) v(path, kind)",
        "json_reports": "SELECT (SELECT count(*) FROM documents) AS rows, lang, count(*) AS n FROM documents WHERE regexp_full_match(lang, '[a-z]{2}') GROUP BY lang",
        "markdown_lines": """WITH b AS (SELECT '| ' || source || ' | ' || kind || ' | ' || target || ' | ' || trust_rank || ' |' AS content, row_number() OVER (ORDER BY trust_rank, source) + 1 AS line FROM source_catalog)
          SELECT 0::int AS line, '| source | kind | target | trust_rank |' AS content UNION ALL SELECT 1::int, '|---|---|---|---|' UNION ALL SELECT line::int, content FROM b""",
        "zip_members": "SELECT 'in/' || source || '.txt' AS name, octet_length(encode(source || '|' || kind || '|' || target))::bigint AS bytes FROM source_catalog",
        "tensor_file": """SELECT label::varchar AS key, max(len(embedding))::int AS width, round(sum(list_sum(embedding::double[])) / count(*), 3) AS total, true AS bare FROM embeddings WHERE label IS NOT NULL GROUP BY label""",
        "notebook_index": """WITH p AS (SELECT 'own__note-' || (doc_id % 40) AS folder, text || chr(10) || 'Merged adapter of ' || source || ': see https://www.Example.org/datasets/' || source || '/' || doc_id || '. Its reward, rewards.' AS page
            FROM documents WHERE text IS NOT NULL AND source IS NOT NULL),
          u AS (SELECT folder, count(DISTINCT x)::int AS n_urls FROM (SELECT folder, unnest(list_transform(regexp_extract_all(page, '(?i)https?://[^\\s\\]\\)\\}"''<>\\\\]+'), lambda v: rtrim(v, '.,;:'))) AS x FROM p) GROUP BY folder)
          SELECT folder, 'own/' || string_split(folder, '__')[2] AS notebook_id, 'A note' AS title, count(*) + 1 AS file_count, count(*) AS py_count, 1::bigint AS json_count, 1::int AS n_datasets, max(n_urls) AS n_urls, 0::int AS parse_error_count,
            sum(len(regexp_extract_all(page, '(?i)\\breward(?:s)?\\b')))::bigint AS n_reward FROM p JOIN u USING (folder) GROUP BY folder""",
        "discovered": """WITH f AS (SELECT kind AS dataset, '/in/' || source || CASE WHEN trust_rank % 3 = 0 THEN '.jsonl' WHEN trust_rank % 3 = 1 THEN '.csv' ELSE '.md' END AS path, target FROM source_catalog),
          k AS (SELECT *, CASE WHEN path LIKE '%.jsonl' THEN 'oracle_jsonl' WHEN path LIKE '%.csv' THEN 'generic_csv' END AS kind FROM f),
          r AS (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY target DESC, path) AS place FROM k WHERE kind IS NOT NULL)
          SELECT dataset, kind, path, dataset || CASE WHEN place > 1 THEN '_' || place ELSE '' END AS label FROM r WHERE place <= 2""",
        "text_folder": """SELECT folder, count(*) AS n FROM (SELECT '/in/' || (doc_id % 7) || CASE WHEN doc_id % 2 = 0 THEN '/deep' ELSE '' END AS folder FROM documents) GROUP BY folder
          ORDER BY n DESC, len(string_split(folder, '/')) DESC, folder DESC LIMIT 1""",
        "replay_order": "SELECT p.id AS problem_id, p.answer, min(t.trace_id) AS pos FROM (SELECT DISTINCT id, answer FROM train_puzzles WHERE id IS NOT NULL) p JOIN traces t ON p.id = t.id GROUP BY p.id, p.answer",
        "audit_counts": f"""SELECT coalesce(task_type, '') AS task_type, count(*) AS n, round(avg(CASE WHEN isfinite(min_logprob) THEN min_logprob END), 10) AS mean FROM {HARD} GROUP BY 1""",
        "dry_run": f"SELECT rec_id, coalesce({_USABLE}, false) AS is_example FROM tokenized_records",
        "verifier_counts": f"""WITH d AS (SELECT *, {o._strip("coalesce(gold, '')")} AS a, {o._FINAL} AS box FROM {o._GOLD})
          SELECT CASE WHEN box = a THEN 'positive' ELSE 'negative' END AS origin, {_TASK} AS task, count(*) AS n FROM d GROUP BY 1, 2""",
        "numeric_rewards": f"WITH {_rewards()} SELECT row, id, origin, extracted_answer, reward, flags FROM scored",
        "numeric_pairs": _pairs(),
        "worked_traces": f"""SELECT id, 'numeral_system' AS family, 'roman_forward' AS method, 'NUMERAL_SYSTEM' || chr(10) || 'Final answer: \\boxed{{' || {o._roman("n")} || '}}' AS completion FROM (
          SELECT id, answer, try_cast(regexp_extract(prompt, '(?i)write the number\\s+(\\d+)\\s+in the Wonderland numeral system', 1) AS bigint) AS n FROM train_puzzles WHERE {o._FAMILY} = 'numeral_system')
          WHERE lower(trim(answer)) = lower({o._roman("n")})""",
        "exact_accuracy": f"""WITH x AS (SELECT family, correct FROM ({o.oracle_sql()["solved_rates"]}) UNION ALL SELECT 'numeral_system', correct FROM ({o.oracle_sql()["solved_numerals"]}))
          SELECT coalesce(family, 'all') AS family, count(*) AS total, coalesce(sum(correct::bigint), 0)::bigint AS correct, round(sum(correct::bigint) / count(*), 6) AS accuracy FROM x GROUP BY ROLLUP (family)""",
        "completed_numerals": f"""WITH g AS (SELECT id, (max((prompt, answer)))[1] AS prompt, (max((prompt, answer)))[2] AS answer FROM train_puzzles WHERE id IS NOT NULL AND {o._FAMILY} = 'numeral_system' GROUP BY id),
          r AS (SELECT g.*, origin, done_row FROM g JOIN ({o.oracle_sql()["resumed_work"]}) USING (id)),
          s AS (SELECT id, answer, origin, done_row, try_cast(regexp_extract(prompt, '(?i)write the number\\s+(\\d+)\\s+in the Wonderland numeral system', 1) AS bigint) AS n FROM r)
          SELECT s.id, origin, s.answer AS prediction, t.method FROM s JOIN traces t ON t.trace_id = done_row WHERE origin <> 'todo'
          UNION ALL SELECT id, 'solved', {o._roman("n")}, 'roman_forward' FROM s WHERE origin = 'todo' AND lower(trim(answer)) = lower({o._roman("n")})""",
        "train_profile": f"""SELECT 'total' AS what, name, n FROM (VALUES ('train_rows', (SELECT count(*) FROM train_puzzles)), ('test_rows', (SELECT count(*) FROM traces)),
            ('id_overlap', (SELECT count(DISTINCT id) FROM traces WHERE id IN (SELECT id FROM train_puzzles))),
            ('prompt_overlap', (SELECT count(DISTINCT {o._prompt("prompt")}) FROM traces WHERE {o._prompt("prompt")} IN (SELECT {o._prompt("prompt")} FROM train_puzzles)))) v(name, n)
          UNION ALL SELECT 'by_class', corpus_class, count(*) FROM ({_on_train("prompt_classes")}) GROUP BY 2 UNION ALL SELECT 'by_answer', shape, count(*) FROM ({_on_train("answer_shapes")}) GROUP BY 2""",
        "training_texts": f"""SELECT trace_id, sha256({head} || {body} || '{END}') AS training, sha256({turn("user", "coalesce(prompt, '')")} || {turn("user", "coalesce(answer, '')")} || '{TURN}assistant' || chr(10)) AS talk,
          length(regexp_replace(coalesce(completion, ''), '[\\s\\x0B\\x{{85}}\\x{{A0}}\\x{{1680}}\\x{{2000}}-\\x{{200A}}\\x{{2028}}\\x{{2029}}\\x{{202F}}\\x{{205F}}\\x{{3000}}]+$', '') || chr(10) || '</think>' || chr(10) || '\\boxed{{' || coalesce(answer, '') || '}}{END}') AS n_corpus FROM traces""",
        "byte_examples": f"""WITH x AS (SELECT trace_id, {size(head)}::int AS h, {size(user + " || " + turn("assistant", "coalesce(completion, '')"))}::int AS n FROM traces)
          SELECT trace_id, least(n, 4096)::int AS n_ids, least(h, 4096)::int AS prompt_len, (least(n, 4096) - least(h, 4096))::int AS completion_len, n > 4096 AS truncated, false AS prefix_mismatch FROM x""",
        "audited_records": f"""WITH v AS (SELECT rec_id, list_transform(input_ids, lambda i: -(coalesce(i, 0) % 97)::double / 8.0) AS l, list_filter(range(1, len(input_ids) + 1), lambda i: loss_mask[i] > 0) AS k FROM tokenized_records WHERE {_USABLE}),
          w AS (SELECT rec_id, k, list_transform(k, lambda i: l[i]) AS s FROM v)
          SELECT rec_id, len(s)::int AS scored, round(list_sum(s) / len(s), 6) AS mean, list_min(s) AS least, k[list_position(s, list_min(s))]::int AS place FROM w""",
        "weighted_losses": f"SELECT coalesce(source, '') AS source, round(sum(-score * (row_index % 5)) / nullif(sum(row_index % 5), 0), 6) AS loss FROM {o._SCORED} GROUP BY 1",
        "small_forms": f"""SELECT trace_id, coalesce(nullif(answer, ''), nullif(method, ''), 'none') AS first, {_mapped("coalesce(task_type, '')", MANIFEST_TASKS)} AS task, coalesce(source, '') AS source,
          contains(lower(concat_ws(' ', source, method)), 'moss') OR contains(lower(concat_ws(' ', source, method)), 'oak') AS named,
          array_to_string({_ordered_distinct("list_filter([trim(source), trim(method), trim(source)], lambda x: x <> '')")}, '|') AS unique_texts FROM traces""",
        "dispositions": """WITH d AS (SELECT doc_id, ['reports', 'public_radar', 'external', 'corpora'][doc_id % 4 + 1] AS g, lower(['Public_Audit', 'trace-x', 'plain', 'a', 'b'][doc_id % 5 + 1] || ['.csv', '.md', '.zip'][doc_id % 3 + 1]) AS p FROM documents)
          SELECT doc_id, CASE WHEN g = 'reports' THEN CASE WHEN regexp_matches(p, 'public_audit|leaderboard|\\.zip|\\.ipynb') THEN 'source-index-only' WHEN regexp_matches(p, '(\\.jsonl|\\.csv)$|prompt|trace|holdout') THEN 'sanitized-derived-only' ELSE 'reviewed-derived-candidate' END
              WHEN g = 'external' THEN 'license-review-only' ELSE 'source-index-only' END AS class,
            CASE WHEN g = 'reports' THEN CASE WHEN regexp_matches(p, 'public_audit|leaderboard|\\.zip|\\.ipynb') THEN 'copied public or third-party artifact' WHEN regexp_matches(p, '(\\.jsonl|\\.csv)$|prompt|trace|holdout') THEN 'row-level fields' ELSE 'first-party report' END
              WHEN g = 'public_radar' THEN 'downloaded third-party snapshot' WHEN g = 'external' THEN 'third-party corpus' ELSE 'reconstructed or downloaded corpus' END AS reason FROM d""",
        "record_digests": "SELECT trace_id, sha256(to_json({'trace_id': trace_id, 'source': source, 'method': method})::varchar) AS digest FROM traces",
        "redacted_texts": r"SELECT trace_id, 'at <redacted-path> Answer: <redacted-content>' || chr(10) || 'end ' || coalesce(source, '') AS clean FROM traces",
        "json_harvest": "SELECT trace_id, (source IS NOT NULL)::int + (method IS NOT NULL)::int AS n_found, concat_ws('|', source, method) AS found FROM traces",
        "whole_counts": """SELECT event_id, len(list_filter(v, lambda x: try_cast(x AS bigint) IS NOT NULL AND regexp_full_match(trim(x), '[+-]?[0-9]+')))::int AS n,
          coalesce(list_sum(list_transform(list_filter(v, lambda x: regexp_full_match(trim(x), '[+-]?[0-9]+')), lambda x: x::bigint)), 0)::bigint AS total
          FROM (SELECT event_id, list_transform(json_keys(props), lambda k: json_extract_string(props, '$.' || k)) AS v FROM events WHERE props IS NOT NULL)""",
        "planted_puzzles": f"""WITH s AS (SELECT DISTINCT s_suppkey::int AS n FROM supplier WHERE s_suppkey IS NOT NULL), t AS (SELECT n, (n * 13 + 211) % 256 AS v, n % 7 + 1 AS k FROM s)
          SELECT n, 'byte' AS kind, 'bit_manipulation' AS family, right('00000000' || bin(((v << k) | (v >> (8 - k))) & 255), 8) AS prediction, true AS correct FROM t
          UNION ALL SELECT n, 'word', 'text_cipher', {_WORDS}[n % 12 + 1] || ' ' || {_WORDS}[n % 5 + 1], true FROM s
          UNION ALL SELECT n, 'product', 'symbolic_equation', ((n % 90 + 10) * ((n + 41) % 90 + 10))::varchar, true FROM s""",
        "number_forms": f"""WITH o AS (SELECT o_orderkey, right('0' || (o_orderkey * 7 % 100), 2) AS p, right('0' || (o_custkey % 100), 2) AS q, {list(solvers.CRYPT_MODES)}[o_orderkey % 6 + 1] AS mode, {list(solvers.OPERATIONS)}[(o_orderkey // 6) % 25 + 1] AS op FROM orders),
          m AS (SELECT *, CASE mode[1:2] WHEN 'AB' THEN p WHEN 'BA' THEN reverse(p) WHEN 'CD' THEN q ELSE reverse(q) END AS a, CASE mode[4:5] WHEN 'AB' THEN p WHEN 'BA' THEN reverse(p) WHEN 'CD' THEN q ELSE reverse(q) END AS b FROM o),
          n AS (SELECT *, a::int AS x, b::int AS y FROM m),
          v AS (SELECT o_orderkey, CASE op WHEN 'concat' THEN a || b WHEN 'rconcat' THEN b || a ELSE (CASE op WHEN 'add' THEN x + y WHEN 'add1' THEN x + y + 1 WHEN 'addm1' THEN x + y - 1 WHEN 'mul' THEN x * y WHEN 'mul1' THEN x * y + 1 WHEN 'mulm1' THEN x * y - 1
            WHEN 'sub' THEN x - y WHEN 'sub1' THEN x - y + 1 WHEN 'subm1' THEN x - y - 1 WHEN 'rsub' THEN y - x WHEN 'rsub1' THEN y - x + 1 WHEN 'rsubm1' THEN y - x - 1 WHEN 'absdiff' THEN abs(x - y) WHEN 'absdiff1' THEN abs(x - y) + 1
            WHEN 'absdiffm1' THEN abs(x - y) - 1 WHEN 'negabsdiff' THEN -abs(x - y) WHEN 'first' THEN x WHEN 'second' THEN y WHEN 'dsum' THEN x // 10 + x % 10 + y // 10 + y % 10
            WHEN 'floordiv' THEN x // nullif(y, 0) WHEN 'rfloordiv' THEN y // nullif(x, 0) WHEN 'mod' THEN x % nullif(y, 0) WHEN 'rmod' THEN y % nullif(x, 0) END)::varchar END AS value FROM n)
          SELECT o_orderkey, value, CASE WHEN starts_with(value, '-') THEN '-' || reverse(value[2:]) ELSE reverse(value) END AS reversed FROM v""",
        "bit_forms": """SELECT o_orderkey, (((a << 3) | (a >> 5)) & 255)::int AS rot3, (a >> 2)::int AS shl2, ((a << 5) & 255)::int AS shr5, (a & b)::int AS gate_and, (a & (255 - b))::int AS gate_andn, (a | b)::int AS gate_or,
          (a | (255 - b))::int AS gate_orn, xor(a, b)::int AS gate_xor, xor(a, 255 - b)::int AS gate_xorn FROM (SELECT o_orderkey, (o_orderkey * 11 % 256)::int AS a, (o_custkey % 256)::int AS b FROM orders)""",
        "adapter_archives": """WITH w AS (SELECT max(len(embedding))::varchar AS w FROM embeddings)
          SELECT 'm.lora_A.weight' AS key, '8x' || w AS shape, 8::int AS rank, 'run' AS name, 0.25::double AS weight FROM w UNION ALL SELECT 'm.lora_B.weight', w || 'x8', 8, 'run', 0.25 FROM w""",
        "manifest_counts": f"""{o._CANDIDATES} SELECT 'rows' AS what, '' AS name, count(*) AS n FROM cand UNION ALL SELECT 'by_source', coalesce(source, ''), count(*) FROM cand GROUP BY 2
          UNION ALL SELECT 'quality_flags', f, count(*) FROM (SELECT unnest(flags) AS f FROM cand) GROUP BY 2 UNION ALL SELECT 'enabled', source, sum(enabled::bigint)::bigint FROM cand WHERE source <> '' GROUP BY 2""",
        "tensor_names": f"""SELECT vec_id, CASE WHEN i % 4 = 0 THEN 'experts.up_proj.' || side WHEN i % 4 = 1 THEN 'q_proj.' || side WHEN i % 4 = 2 THEN 'in_proj.' || side ELSE 'other' END AS category,
          CASE WHEN side = 'lora_A' THEN module ELSE {_KEY} END AS module, module || '.lora_B.weight' AS partner, 'base.' || module || '.' || side AS renamed, i % 4 = 0 AS restored, 2::int AS variants FROM {_KEYS}""",
        "merge_plan": f"""WITH s AS (SELECT i, any_value(module) AS module, count(*) FILTER (adapter = 'base') AS b, count(*) FILTER (adapter = 'other') AS o FROM {_KEYS} GROUP BY i),
          m AS (SELECT module, (o < 2 OR i % 5 = 0)::int AS bad FROM s WHERE b = 2 AND NOT suffix(module, 'norm'))
          SELECT module, module || '.lora_A.weight' AS a_key, module || '.lora_B.weight' AS b_key, CASE WHEN bad = 0 THEN 'compatible' ELSE 'incompatible' END AS status, CASE WHEN bad = 0 THEN 'svd' ELSE 'anchor_copy' END AS action, bad AS n_offenders FROM m""",
        "module_scales": f"""SELECT DISTINCT m AS module, round(CASE WHEN suffix(m, 'up_proj') THEN 16.0 WHEN suffix(m, 'proj') THEN 8.0 ELSE 2.0 END / 4, 6) AS scale
          FROM (SELECT CASE WHEN side = 'lora_A' THEN module ELSE {_KEY} END AS m FROM {_KEYS} WHERE adapter = 'base')""",
        "load_map": f"""SELECT {_KEY} AS key, CASE WHEN vec_id % 8 < 2 THEN {_KEY} WHEN vec_id % 8 >= 4 THEN replace({_KEY}, 'model.', 'base.') END AS target, false AS shared FROM {_KEYS} WHERE adapter = 'base'""",
        "tied_experts": """SELECT label AS "group", max(len(embedding))::int AS width, round(sum(list_sum(embedding::double[])) / count(*), 4) AS total, round(sum(embedding[1]::double) / count(*), 5) AS first FROM embeddings WHERE label IS NOT NULL GROUP BY label""",
        "low_rank_product": """WITH e AS (SELECT vec_id // 2 AS m, embedding::double[] AS v FROM embeddings WHERE len(embedding) = 64),
          t AS (SELECT m, list_sum(list_transform(range(0, 4), lambda k: list_sum(list_transform(range(0, 8), lambda i: v[33 + i * 4 + k])) * list_sum(list_transform(range(0, 8), lambda j: v[1 + k * 8 + j])))) AS s FROM e)
          SELECT m::varchar AS module, round(0.5 * sum(s), 2) AS total FROM t GROUP BY m""",
    }
