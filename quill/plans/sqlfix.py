"""DuckDB mirror of the fixture relations (common table expressions).

Use as ``f"WITH {FX}, q AS (...) SELECT ..."``; DuckDB inlines only the
CTEs a statement references.
"""

from __future__ import annotations

from quill.plans.fixtures import NEGATIVE, NEUTRAL, POSITIVE
from quill.plans.sqlbits import in_list

def lex_probs_sql(words: str, neutral: float = NEUTRAL) -> str:
    """SELECT list of p_neg, p_neu, p_pos from a list of words; give it to ``probs_of``."""
    hits = lambda lexicon: f"len(list_filter({words}, lambda w: w IN {in_list(lexicon)}))"
    return f"{hits(NEGATIVE)} + 1.0::DOUBLE AS a, {hits(POSITIVE)} + 1.0::DOUBLE AS c, {neutral}::DOUBLE AS k"


PROBS_SQL = "a / (a + least(a, c) * k + c) AS p_neg, least(a, c) * k / (a + least(a, c) * k + c) AS p_neu, c / (a + least(a, c) * k + c) AS p_pos"
LABEL_SQL = """CASE WHEN p_neg >= p_neu AND p_neg >= p_pos THEN 'negative' WHEN p_neu >= p_pos THEN 'neutral' ELSE 'positive' END AS label,
    greatest(p_neg, p_neu, p_pos) AS score"""
TEXT_WORDS = "string_split_regex(lower(coalesce(text, '')), '[^a-z]+')"

FX = rf"""
fx_hits AS (SELECT doc_id AS vec_id, {lex_probs_sql(TEXT_WORDS)} FROM documents),
fx_probs AS (SELECT vec_id, {PROBS_SQL} FROM fx_hits),
fx_sentiment AS (SELECT vec_id, p_neg, p_neu, p_pos,
    {LABEL_SQL} FROM fx_probs),
fx_docs AS (
  SELECT CAST(d.doc_id AS VARCHAR) AS document_id, d.doc_id, d.text, d.lang, d.source, d.n_chars,
         s.label AS sent_label, s.score AS sent_score,
         CASE WHEN l.doc_id IS NULL THEN NULL WHEN l.quality = 1 THEN 'high' ELSE 'low' END AS cls_label,
         CASE WHEN l.doc_id IS NOT NULL THEN CAST(1.0 AS DOUBLE) END AS cls_score,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(d.doc_id % 30 AS INTEGER)) + to_hours(CAST(d.doc_id % 24 AS INTEGER)) AS processed_at,
         d.n_chars / 10000.0 AS processing_time,
         CASE WHEN d.text IS NULL THEN 'not_a_string' WHEN regexp_full_match(d.text, '\s*') THEN 'empty' END AS error,
         CAST(len(regexp_extract_all(d.text, '[A-Z][a-z]+')) AS BIGINT) AS n_entities
  FROM documents d LEFT JOIN fx_sentiment s ON s.vec_id = d.doc_id LEFT JOIN labels l ON l.doc_id = d.doc_id),
fx_m AS (SELECT doc_id, regexp_extract_all(text, '[A-Z][a-z]+') AS ms, string_split_regex(text, '[A-Z][a-z]+') AS gs FROM documents),
fx_mu AS (SELECT doc_id, unnest(ms) AS etext, generate_subscripts(ms, 1) AS i FROM fx_m),
fx_gu AS (SELECT doc_id, unnest(gs) AS g, generate_subscripts(gs, 1) AS i FROM fx_m),
fx_gc AS (SELECT doc_id, i, sum(length(g)) OVER (PARTITION BY doc_id ORDER BY i) AS gsum FROM fx_gu),
fx_mc AS (SELECT doc_id, i, etext, sum(length(etext)) OVER (PARTITION BY doc_id ORDER BY i) - length(etext) AS msum FROM fx_mu),
fx_ents AS (
  SELECT mc.doc_id, CAST(mc.doc_id AS VARCHAR) AS document_id, CAST(mc.i - 1 AS BIGINT) AS pos, mc.etext AS text,
         CAST(gc.gsum + mc.msum AS INTEGER) AS start_pos, CAST(gc.gsum + mc.msum + length(mc.etext) AS INTEGER) AS end_pos,
         CASE length(mc.etext) % 3 WHEN 0 THEN 'PERSON' WHEN 1 THEN 'ORG' ELSE 'GPE' END AS label,
         CASE length(mc.etext) % 3 WHEN 0 THEN 'Person' WHEN 1 THEN 'Organization' ELSE 'Location' END AS type,
         (1 + (7 * length(mc.etext) + 3 * (mc.i - 1)) % 10) / 10.0 AS score,
         TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(mc.doc_id % 30 AS INTEGER)) + to_hours(CAST(mc.doc_id % 24 AS INTEGER)) AS processed_at
  FROM fx_mc mc JOIN fx_gc gc ON gc.doc_id = mc.doc_id AND gc.i = mc.i)
"""

FX_PRED2 = r"""
fx_pred AS (
  SELECT l.doc_id AS row_id, CAST(l.quality AS INTEGER) AS y_true,
         p.p_neg / (p.p_neg + p.p_neu) AS p0, p.p_neu / (p.p_neg + p.p_neu) AS p1
  FROM labels l JOIN fx_probs p ON p.vec_id = l.doc_id),
fx_pred2 AS (SELECT row_id, y_true, CASE WHEN p0 >= p1 THEN 0 ELSE 1 END AS y_pred, p0, p1 FROM fx_pred)
"""

FX_PRED3 = r"""
fx_pred3 AS (
  SELECT l.doc_id AS row_id, CAST(l.quality + l.toxic AS INTEGER) AS y_true,
         CASE WHEN p.p_neg >= p.p_neu AND p.p_neg >= p.p_pos THEN 0 WHEN p.p_neu >= p.p_pos THEN 1 ELSE 2 END AS y_pred,
         p.p_neg AS p0, p.p_neu AS p1, p.p_pos AS p2
  FROM labels l JOIN fx_probs p ON p.vec_id = l.doc_id)
"""
