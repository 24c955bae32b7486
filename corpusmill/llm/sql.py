"""The training-data queries that SQL can express, in DuckDB's."""

from __future__ import annotations

_WS = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{AD}\x{1680}\x{180E}\x{2000}-\x{200F}\x{2028}\x{2029}\x{202F}\x{205F}\x{2060}\x{3000}\x{FEFF}]"
_SPACE = r"[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_INK = _WS.replace("[", "[^", 1)


def _trim(x: str, ws: str = _WS) -> str:
    return f"regexp_replace({x}, '^{ws}+|{ws}+$', '', 'g')"


def _key(x: str) -> str:
    return rf"regexp_replace(lower({_trim(x)}), '\s*\.txt$', '')"


def _flat(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_SPACE}+', ' ', 'g'))"


_GROUPS = f"""
p AS (SELECT {_key("id")} AS k, min(id) AS puzzle_id FROM train_puzzles WHERE id IS NOT NULL GROUP BY 1),
q AS (SELECT {_flat("prompt")} AS k, min(id) AS puzzle_id FROM train_puzzles WHERE id IS NOT NULL AND regexp_matches(prompt, '{_INK}') GROUP BY 1),
t AS (SELECT *, {_key("coalesce(id, '')")} AS ik, CASE WHEN regexp_matches(prompt, '{_INK}') THEN {_flat("prompt")} END AS pk FROM traces WHERE trace_id IS NOT NULL),
g AS (SELECT t.*, CASE WHEN ik <> '' AND NOT starts_with(ik, 'row_') THEN p.puzzle_id ELSE q.puzzle_id END AS puzzle_id FROM t LEFT JOIN p ON t.ik = p.k LEFT JOIN q ON t.pk = q.k),
c AS (SELECT lower({_trim("source")}) AS s, min(trust_rank) AS r FROM source_catalog GROUP BY 1),
n AS (SELECT g.*, coalesce(c.r, 2147483647) AS r, count(*) OVER (PARTITION BY g.puzzle_id) AS size FROM g LEFT JOIN c ON lower({_trim("g.source")}) = c.s WHERE g.puzzle_id IS NOT NULL)
"""


def oracle_sql() -> dict[str, str]:
    boxed = rf"regexp_matches(v, '\\boxed\{{[^{{}}]*{_INK.replace('[^', '[^{}', 1)}[^{{}}]*\}}')"
    return {
        "p1_valid": """WITH r AS (SELECT rec_id, len(input_ids) AS n FROM tokenized_records WHERE len(input_ids) > 0 AND len(input_ids) = len(loss_mask))
          SELECT setting_id, sum((n - 1) // capacity + 1)::bigint AS n_parts, sum(n)::bigint AS n_ids, count(*) AS n_records, 0::bigint AS n_overfull, 0::bigint AS n_overlaps
          FROM r, pack_settings GROUP BY setting_id""",
        "p3_found": f"""WITH {_GROUPS},
          l AS (SELECT puzzle_id, 'answer' AS field_name, answer AS v, trace_id, r, updated_at FROM n WHERE size >= 2
            UNION ALL SELECT puzzle_id, 'completion', completion, trace_id, r, updated_at FROM n WHERE size >= 2
            UNION ALL SELECT puzzle_id, 'method', method, trace_id, r, updated_at FROM n WHERE size >= 2)
          SELECT puzzle_id, field_name, trace_id FROM l WHERE regexp_matches(v, '{_INK}')
          QUALIFY row_number() OVER (PARTITION BY puzzle_id, field_name ORDER BY CASE WHEN field_name = 'completion' AND {boxed} THEN 0 ELSE 1 END, r, updated_at DESC NULLS LAST, trace_id) = 1""",
        "p3_votes": f"""WITH {_GROUPS},
          v AS (SELECT n.*, coalesce(1.0::double / nullif(r, 2147483647), 0.01) * coalesce(pow(2.0, datediff('day', DATE '2025-01-01', updated_at::date) / 90.0), 1e-6) AS w FROM n),
          l AS (SELECT puzzle_id, 'answer' AS f, answer AS v, trace_id, updated_at, w FROM v UNION ALL SELECT puzzle_id, 'completion', completion, trace_id, updated_at, w FROM v
            UNION ALL SELECT puzzle_id, 'method', method, trace_id, updated_at, w FROM v),
          s AS (SELECT puzzle_id, f, {_flat("v")} AS d, sum(w) AS w, first(trace_id ORDER BY updated_at DESC NULLS LAST, trace_id) AS t, max(updated_at) AS u FROM l WHERE regexp_matches(v, '{_INK}') GROUP BY ALL),
          o AS (SELECT *, max(w) OVER p / sum(w) OVER p AS share FROM s WINDOW p AS (PARTITION BY puzzle_id, f) QUALIFY row_number() OVER (PARTITION BY puzzle_id, f ORDER BY round(w, 9) DESC, u DESC NULLS LAST, t) = 1),
          full_rows AS (SELECT o.*, l.v FROM o JOIN l ON o.t = l.trace_id AND o.f = l.f AND o.puzzle_id = l.puzzle_id)
          SELECT puzzle_id, {", ".join(f"max(CASE WHEN f = '{f}' THEN v END) AS {f}, max(CASE WHEN f = '{f}' THEN t END) AS {f}_trace_id, max(CASE WHEN f = '{f}' THEN round(share, 6) END) AS {f}_share" for f in ("answer", "completion", "method"))}
          FROM full_rows GROUP BY puzzle_id""",
        "p6_decoded": "SELECT doc_id, octet_length(encode(coalesce(text, '')))::bigint AS n_bytes, sha256(coalesce(text, '')) AS sha256 FROM documents",
        "p7_valid": "SELECT plan_id, 0::bigint AS n_over, 0::bigint AS n_foreign, 0::bigint AS n_wrong_uses, 0::bigint AS n_outside, 'met' AS plan_state FROM mix_targets GROUP BY plan_id",
        "p4_found": r"""WITH d AS (SELECT DISTINCT CASE WHEN g = '' THEN 'unknown' ELSE g END AS task_type, row_index, hard_tail_score AS s,
            CASE WHEN min_logprob IS NULL OR isnan(min_logprob) THEN '-inf'::double ELSE min_logprob END AS m
          FROM (SELECT *, lower(regexp_replace(coalesce(task_type, ''), '^[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+|[\s\x0B\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{200B}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]+$', '', 'g')) AS g FROM hard_tail_v5_64_diagnostic)
          WHERE isfinite(hard_tail_score) AND row_index IS NOT NULL)
          SELECT task_type, row_index FROM d QUALIFY row_number() OVER (PARTITION BY task_type ORDER BY s DESC, m DESC, row_index) <= 3""",
    }
