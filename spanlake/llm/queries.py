"""The corpus operators' queries, and SQL for those that SQL can express."""

from __future__ import annotations

from spanlake.llm import op1_html, op2_lm, op3_fingerprints, op4_sharding, op5_quality, op6_neardup, op7_language, op8_mixing, op9_decontamination, op10_licenses

QUERIES = {
    "op1_html_line_blocks": op1_html.query,
    "op2_log_bilinear_lm": op2_lm.query,
    "op3_iblt_fingerprints": op3_fingerprints.query,
    "op4_sampled_splitters": op4_sharding.query,
    "op5_ftrl_quality": op5_quality.query,
    "op6_setsketch_neardup": op6_neardup.query,
    "op7_ecoc_language": op7_language.query,
    "op8_mix_sources": op8_mixing.query,
    "op9_template_decontamination": op9_decontamination.query,
    "op10_license_scan": op10_licenses.query,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TEMPLATES = ", ".join(f"('{t}', '{label}', '{kind}')" for kind, pairs in (("base", op10_licenses.BASE.items()), ("text", [(t, k) for k, t in op10_licenses.TEXTS.items()])) for t, label in pairs)

#: The others are models, sketches or hashed draws; their tests compare them with brute force.
SQL: dict[str, str] = {
    "op6_setsketch_neardup": rf"""WITH RECURSIVE s AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
 sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(1, len(w) - 4))) AS i FROM s WHERE len(w) > 0)),
 n AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS k FROM sh GROUP BY doc_id), c AS (SELECT k, min(doc_id) AS rep FROM n GROUP BY k),
 pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS x FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT a, b FROM pr JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * x >= 75 * (p.n + q.n - x)), l AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
 r(id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id), m AS (SELECT id, min(root) AS root FROM r GROUP BY id)
 SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, root AS component_id, d.doc_id = root AS kept, rep AS class_id FROM documents d JOIN m ON m.id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.k = n.k""",
    "op10_license_scan": rf"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
 g AS (SELECT r, i - 1 AS p, w[i] || ' ' || w[i + 1] AS g FROM (SELECT r, w, unnest(generate_series(1, len(w) - 1)) AS i FROM d WHERE len(w) > 1)),
 t AS (SELECT label, kind, len(x) - 1 AS total, i - 1 AS pos, x[i] || ' ' || x[i + 1] AS g FROM (SELECT label, kind, x, unnest(generate_series(1, len(x) - 1)) AS i FROM (SELECT label, kind, string_split(text, ' ') AS x FROM (VALUES {_TEMPLATES}) AS v(text, label, kind)))),
 v AS (SELECT r, label, kind, total, p - pos AS diagonal, min(p) AS first, max(p) AS last, list(DISTINCT pos) AS covered FROM g JOIN t USING (g) GROUP BY ALL),
 a AS (SELECT *, CASE WHEN kind = 'base' OR coalesce(diagonal - lag(diagonal) OVER o > 3, true) THEN 1 ELSE 0 END AS apart FROM v WINDOW o AS (PARTITION BY r, label, kind ORDER BY diagonal)),
 b AS (SELECT *, sum(apart) OVER (PARTITION BY r, label, kind ORDER BY diagonal) AS span FROM a),
 s AS (SELECT r, label, kind, total, min(first) AS first, max(last) AS last, len(list_distinct(flatten(list(covered)))) AS votes FROM b GROUP BY r, label, kind, total, span),
 f AS (SELECT * FROM s WHERE CASE WHEN kind = 'base' THEN votes = total ELSE votes >= greatest(3, ceil(total * 0.8::DOUBLE)) AND last - first < 2 * total END),
 x AS (SELECT r, count(*) FILTER (kind = 'base') AS n_base, min(first) FILTER (kind = 'base') AS first_word, max(first) FILTER (kind = 'base') AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base') AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(votes / total::DOUBLE) AS score FROM f GROUP BY r)
 SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0::DOUBLE) AS score FROM d LEFT JOIN x USING (r)""",
}
