"""The subpackage's queries, by the names under which they are registered."""

from __future__ import annotations

from millrace.llm import align, bestfit, chat, forest, html, licenses, lm, mixing, packing, quality, vectors, whitening
from millrace.session import spread, table

QUERIES = {
    "op1_lm_score": lambda spark, d: lm.op1_lm_score(table(spark, d, "documents"), table(spark, d, "labels")),
    "op2_mixing": lambda spark, d: mixing.op2_mixing(spread(table(spark, d, "documents"))),
    "op3_html": lambda spark, d: html.op3_html(spread(table(spark, d, "pages"))),
    "op4_licenses": lambda spark, d: licenses.op4_licenses(spread(table(spark, d, "documents"))),
    "op5_near_dedup": lambda spark, d: vectors.op5_near_dedup(table(spark, d, "embeddings")),
    "op6_neighbours": lambda spark, d: vectors.op6_neighbours(table(spark, d, "embeddings")),
    "op7_packing": lambda spark, d: packing.op7_packing(spread(table(spark, d, "documents"))),
    "op8_jaccard": lambda spark, d: forest.op8_jaccard(spread(table(spark, d, "documents"))),
    "op9_quality": lambda spark, d: quality.op9_quality(spread(table(spark, d, "documents")), table(spark, d, "labels")),
    "op10_chat": lambda spark, d: chat.op10_chat(table(spark, d, "conversations")),
    "op11_whitening": lambda spark, d: whitening.op11_whitening(table(spark, d, "embeddings")),
    "op12_best_fit": lambda spark, d: bestfit.op12_best_fit(spread(table(spark, d, "documents"))),
    "op13_alignment": lambda spark, d: align.op13_alignment(spread(table(spark, d, "documents"))),
}

_COMPONENTS = """
reach AS (
  SELECT a AS id, b AS other FROM link UNION SELECT b, a FROM link
  UNION SELECT r.id, l.other FROM reach r JOIN (SELECT a AS x, b AS other FROM link UNION SELECT b, a FROM link) l ON r.other = l.x
)
"""

ORACLES: dict[str, str] = {
    "op4_licenses": licenses.op4_sql(),
    "op5_near_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
u AS (SELECT vec_id, v, sqrt(list_inner_product(v, v)) AS n FROM v WHERE v IS NOT NULL AND list_inner_product(v, v) > 0),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.vec_id < y.vec_id AND list_inner_product(x.v, y.v) / (x.n * y.n) >= 0.9),
""" + _COMPONENTS + """
SELECT e.vec_id, count(DISTINCT CASE WHEN l.a = e.vec_id THEN l.b ELSE l.a END) AS n_links, least(e.vec_id, coalesce(min(r.other), e.vec_id)) AS component_id,
       e.vec_id = least(e.vec_id, coalesce(min(r.other), e.vec_id)) AS kept
FROM embeddings e LEFT JOIN link l ON e.vec_id IN (l.a, l.b) LEFT JOIN reach r ON r.id = e.vec_id GROUP BY e.vec_id
""",
    "op8_jaccard": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(text, '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(0, greatest(1, len(w) - 4)), lambda i: array_to_string(w[i + 1 : i + 5], ' '))) AS shingle FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.shingle = y.shingle AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM pair JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE k * 1.8 >= 0.8 * (x.n + y.n) - 1e-9),
""" + _COMPONENTS + """
SELECT d.doc_id, least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS class_id, count(DISTINCT CASE WHEN l.a = d.doc_id THEN l.b ELSE l.a END) AS n_links,
       d.doc_id = least(d.doc_id, coalesce(min(r.other), d.doc_id)) AS kept
FROM documents d LEFT JOIN link l ON d.doc_id IN (l.a, l.b) LEFT JOIN reach r ON r.id = d.doc_id GROUP BY d.doc_id
""",
    "op10_chat": r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
),
e AS (
  SELECT *, len(text) + len(regexp_extract_all(text, '\\|<s>|</s>|\[INST\]|\[/INST\]')) AS text_chars,
    len(role) + len(regexp_extract_all(role, '\\|\n|<s>|</s>|\[INST\]|\[/INST\]')) AS role_chars FROM c
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN len(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN 7 + text_chars ELSE 14 + text_chars + role_chars END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
""",
}
