"""Queries for reports, chart tables (G*) and export tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quill.functions import text as tx
from quill.operators import aggregate as ag
from quill.operators import report as rp
from quill.operators import sentiment as se
from quill.plans.catalog import query
from quill.plans.q_results import LEX_SQL, R, lexicon_df, round_doubles
from quill.plans.sqlbits import d_word_count, lit
from quill.plans.sqlfix import FX
from quill.session import scratch_path, staged
from quill.sources import sinks as sk
from quill.sources.cache import PredictionCache


@query("report_summary", f"""
WITH {FX}, e AS (SELECT avg(score) AS a, count(*) FILTER (WHERE score > 0.8) / count(score) AS h,
                        count(DISTINCT text) AS u FROM fx_ents)
SELECT CAST(count(*) AS BIGINT) AS total_documents,
       CAST(count(*) FILTER (WHERE coalesce(error, '') = '') AS BIGINT) AS successful,
       CAST(count(*) FILTER (WHERE coalesce(error, '') <> '') AS BIGINT) AS failed,
       round(count(*) FILTER (WHERE sent_label = 'negative') * 100.0 / count(sent_label), 6) AS pct_negative,
       round(count(*) FILTER (WHERE sent_label = 'neutral') * 100.0 / count(sent_label), 6) AS pct_neutral,
       round(count(*) FILTER (WHERE sent_label = 'positive') * 100.0 / count(sent_label), 6) AS pct_positive,
       CAST(sum(n_entities) AS BIGINT) AS total_entities, round(sum(n_entities) / count(*), 6) AS entities_per_document,
       round(avg(length(text)), 6) AS avg_length, round(avg({d_word_count('text')}), 6) AS avg_words,
       CAST(sum(length(text)) AS BIGINT) AS total_characters, CAST(sum({d_word_count('text')}) AS BIGINT) AS total_words,
       round(count(*) FILTER (WHERE coalesce(error, '') = '') / count(*), 6) AS success_rate,
       (SELECT CAST(u AS BIGINT) FROM e) AS unique_entities,
       round(coalesce(avg(sent_score), 0), 6) AS avg_sentiment_confidence,
       round(coalesce(count(*) FILTER (WHERE sent_score > 0.8) / count(sent_score), 0), 6) AS high_confidence_sentiments,
       (SELECT round(a, 6) FROM e) AS avg_entity_confidence, (SELECT round(h, 6) FROM e) AS high_confidence_entities
FROM fx_docs
""")
def q_report_summary(spark, d):
    return round_doubles(rp.report_summary(R(spark, d)))


@query("dominant_sentiment", f"""
WITH {FX} SELECT sent_label AS sentiment, CAST(count(*) AS BIGINT) AS count FROM fx_docs WHERE sent_label IS NOT NULL
GROUP BY 1 ORDER BY count DESC, sentiment LIMIT 1
""")
def q_dominant_sentiment(spark, d):
    return rp.dominant_sentiment(R(spark, d))


@query("quality_metrics", f"""
WITH {FX}, e AS (SELECT coalesce(avg(score), 0) AS a, coalesce(count(*) FILTER (WHERE score > 0.8) / count(score), 0) AS h FROM fx_ents)
SELECT round(coalesce(avg(sent_score), 0), 6) AS avg_sentiment_confidence,
       round(coalesce(count(*) FILTER (WHERE sent_score > 0.8) / count(sent_score), 0), 6) AS high_confidence_sentiments,
       (SELECT round(a, 6) FROM e) AS avg_entity_confidence, (SELECT round(h, 6) FROM e) AS high_confidence_entities
FROM fx_docs
""")
def q_quality_metrics(spark, d):
    return round_doubles(rp.quality_metrics(R(spark, d)))


@query("report_sentiment", f"""
WITH {FX} SELECT sent_label AS sentiment, CAST(count(*) AS BIGINT) AS count, round(avg(sent_score), 6) AS avg_confidence
FROM fx_docs WHERE sent_label IS NOT NULL GROUP BY 1
""")
def q_report_sentiment(spark, d):
    return round_doubles(rp.report_sentiment(R(spark, d)))


@query("report_sentiment_detail", f"""
WITH {FX} SELECT document_id, sent_label AS sentiment, round(sent_score, 6) AS confidence,
                 substr(text, 1, 100) || '...' AS text_preview FROM fx_docs WHERE sent_label IS NOT NULL
""")
def q_report_sentiment_detail(spark, d):
    return round_doubles(rp.report_sentiment_detail(R(spark, d)))


@query("insights_sentiment", f"""
WITH {FX}, c AS (SELECT sent_label AS s, count(*) AS n, avg(sent_score) AS a FROM fx_docs WHERE sent_label IS NOT NULL GROUP BY 1),
dom AS (SELECT s, n FROM c ORDER BY n DESC, s LIMIT 1)
SELECT CAST(1 AS BIGINT) AS seq, 'Dominant sentiment is ''' || s || ''' (' || n || ' documents)' AS insight FROM dom
UNION ALL
SELECT 2, 'Positive to negative ratio: ' || printf('%.2f', round(p.n / (q.n + 1), 2)) FROM c p, c q WHERE p.s = 'positive' AND q.s = 'negative'
UNION ALL
SELECT 3, 'High confidence sentiments: ' || string_agg(s, ', ' ORDER BY s) FROM c WHERE a > 0.8 HAVING count(*) > 0
""")
def q_insights_sentiment(spark, d):
    return rp.insights_sentiment(R(spark, d))


@query("report_entities", f"""
WITH {FX}, c AS (SELECT label, text, count(*) AS n FROM fx_ents GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, text) AS rk FROM c),
t AS (SELECT label, sum(n) AS top_sum, arg_min(text, rk) AS top_entity, arg_min(n, rk) AS top_count FROM r WHERE rk <= 20 GROUP BY 1),
o AS (SELECT label, count(*) AS occurrences, count(DISTINCT text) AS uniq FROM fx_ents GROUP BY 1)
SELECT o.label, CAST(o.occurrences AS BIGINT) AS occurrences, CAST(o.uniq AS BIGINT) AS "unique",
       CAST(t.top_sum AS BIGINT) AS top_sum, t.top_entity, CAST(t.top_count AS BIGINT) AS top_count
FROM o JOIN t USING (label)
""")
def q_report_entities(spark, d):
    return rp.report_entities(R(spark, d))


@query("top_entities_typed", f"""
WITH {FX}, c AS (SELECT text, label, count(*) AS n FROM fx_ents GROUP BY 1, 2),
b AS (SELECT text, label AS type FROM (SELECT *, row_number() OVER (PARTITION BY text ORDER BY n DESC, label) AS rk FROM c) WHERE rk = 1),
f AS (SELECT text, sum(n) AS frequency FROM c GROUP BY 1)
SELECT f.text, b.type, CAST(f.frequency AS BIGINT) AS frequency FROM f JOIN b USING (text)
ORDER BY frequency DESC, text LIMIT 50
""")
def q_top_entities_typed(spark, d):
    return rp.top_entities_typed(R(spark, d))


@query("entity_coverage", f"""
WITH {FX} SELECT round(avg(CASE WHEN n_entities > 0 THEN 1.0 ELSE 0.0 END), 6) AS entity_coverage FROM fx_docs
""")
def q_entity_coverage(spark, d):
    return round_doubles(rp.entity_coverage(R(spark, d)))


@query("insights_entities", f"""
WITH {FX}, c AS (SELECT label, text, count(*) AS n FROM fx_ents GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, text) AS rk FROM c),
t AS (SELECT label, sum(n) AS top_sum, arg_min(text, rk) AS top_entity, arg_min(n, rk) AS top_count FROM r WHERE rk <= 20 GROUP BY 1)
SELECT * FROM (SELECT CAST(0 AS BIGINT) AS seq, '' AS label, 'Most prevalent entity type: ' || label AS insight
               FROM t ORDER BY top_sum DESC, label LIMIT 1)
UNION ALL
SELECT 1, label, 'Top ' || label || ': ''' || top_entity || ''' (' || top_count || ' occurrences)' FROM t
""")
def q_insights_entities(spark, d):
    return rp.insights_entities(R(spark, d))


@query("document_report", f"""
WITH {FX}
SELECT document_id, processed_at, CAST(length(text) AS BIGINT) AS text_length, {d_word_count('text')} AS word_count,
       sent_label AS sentiment_label, round(sent_score, 6) AS sentiment_confidence, n_entities AS total_found,
       round(n_entities / greatest({d_word_count('text')}, 1), 6) AS entity_density, cls_label AS classification
FROM fx_docs
""")
def q_document_report(spark, d):
    out = rp.document_report(R(spark, d)).withColumn("processed_at", F.col("processed_at").cast("timestamp_ntz"))
    return round_doubles(out)


@query("document_entities", f"""
WITH {FX}
SELECT document_id, label, string_agg(text, '; ' ORDER BY pos) AS texts, CAST(count(*) AS BIGINT) AS n
FROM fx_ents GROUP BY 1, 2
""")
def q_document_entities(spark, d):
    return rp.document_entities_by_label(R(spark, d))


@query("sentiment_segments", f"""
WITH s AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, CAST(i AS BIGINT) AS seg_no, substr(text, i * 100 + 1, 100) AS seg
           FROM documents, range(0, CAST(ceil(length(text) / 100.0) AS BIGINT)) r(i)),
t AS (SELECT document_id, seg_no, unnest(list_transform(regexp_extract_all(seg, {lit(tx.WORD_TOKEN)}), lambda x: lower(x))) AS word FROM s),
h AS (SELECT document_id, seg_no, sum(weight) AS sc, count(*) AS n FROM t JOIN {LEX_SQL} USING (word) GROUP BY 1, 2)
SELECT s.document_id, s.seg_no, round(coalesce(h.sc, 0.0), 6) AS lex_score, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hits,
       CASE WHEN coalesce(h.sc, 0) > 0 THEN 'positive' WHEN coalesce(h.sc, 0) < 0 THEN 'negative' ELSE 'neutral' END AS label
FROM s LEFT JOIN h USING (document_id, seg_no)
""")
def q_sentiment_segments(spark, d):
    lex = lexicon_df(spark)

    def scorer(segs):
        toks = segs.select("document_id", F.col("seg_no").cast("bigint").alias("seg_no"),
                           F.transform(tx.word_tokens(F.col("segment")), F.lower).alias("toks"))
        return se.score_lexicon(toks, "toks", lex, key=["document_id", "seg_no"])
    return round_doubles(rp.sentiment_segments(R(spark, d), scorer))


@query("chart_sentiment", f"""
WITH {FX} SELECT sent_label AS sentiment, CAST(count(*) AS BIGINT) AS count,
                 CAST((SELECT count(*) FROM fx_docs WHERE sent_label IS NOT NULL) AS BIGINT) AS total
FROM fx_docs WHERE sent_label IS NOT NULL GROUP BY 1
""")
def q_chart_sentiment(spark, d):
    return rp.chart_sentiment(R(spark, d))


@query("chart_confidence_box", f"""
WITH {FX}
SELECT sent_label AS sentiment, CAST(count(*) AS BIGINT) AS n, round(quantile_cont(sent_score, 0.25), 6) AS q1,
       round(quantile_cont(sent_score, 0.5), 6) AS median, round(quantile_cont(sent_score, 0.75), 6) AS q3,
       round(min(sent_score), 6) AS min, round(max(sent_score), 6) AS max, round(avg(sent_score), 6) AS mean,
       round(coalesce(stddev_samp(sent_score), 0), 6) AS sd
FROM fx_docs WHERE sent_label IS NOT NULL GROUP BY 1
""")
def q_chart_confidence_box(spark, d):
    return round_doubles(rp.chart_confidence_box(R(spark, d)))


@query("chart_entity_freq", f"""
WITH {FX} SELECT text, CAST(count(*) AS BIGINT) AS count FROM fx_ents WHERE label = 'ORG'
GROUP BY text ORDER BY count DESC, text LIMIT 20
""")
def q_chart_entity_freq(spark, d):
    return ag.top_entities(R(spark, d), 20, label="ORG")


@query("chart_entity_types", f"WITH {FX} SELECT label, CAST(count(*) AS BIGINT) AS count FROM fx_ents GROUP BY 1")
def q_chart_entity_types(spark, d):
    return rp.chart_entity_types(R(spark, d))


@query("chart_timeline", f"""
WITH {FX} SELECT processed_at AS ts, sent_label AS sentiment, CAST(count(*) AS BIGINT) AS count
FROM fx_docs WHERE sent_label IS NOT NULL GROUP BY 1, 2
""")
def q_chart_timeline(spark, d):
    return rp.chart_timeline(R(spark, d))


_PAIRS5 = f"""
WITH {FX}, de AS (SELECT DISTINCT document_id, text FROM fx_ents),
p AS (SELECT a.text AS entity1, b.text AS entity2, count(*) AS c
      FROM de a JOIN de b ON a.document_id = b.document_id AND a.text < b.text GROUP BY 1, 2 HAVING count(*) >= 5)
"""


@query("network_edges", _PAIRS5 + """
SELECT entity1, entity2, CAST(c AS BIGINT) AS co_occurrence_count, round(least(c / 2.0, 10.0), 6) AS width FROM p
""")
def q_network_edges(spark, d):
    return round_doubles(rp.network_edges(R(spark, d), 5))


@query("network_nodes", _PAIRS5 + """
, n AS (SELECT entity1 AS node FROM p UNION SELECT entity2 FROM p),
r AS (SELECT node, row_number() OVER (ORDER BY node) - 1 AS idx, count(*) OVER () AS cnt FROM n)
SELECT node, CAST(idx AS BIGINT) AS idx, round(cos(2 * pi() * idx / cnt), 6) AS x, round(sin(2 * pi() * idx / cnt), 6) AS y FROM r
""")
def q_network_nodes(spark, d):
    return round_doubles(rp.network_tables(R(spark, d), 5)[1])


@query("dashboard_tables", f"""
WITH {FX},
p1 AS (SELECT 'sentiment' AS panel, sent_label AS key, CAST(count(*) AS DOUBLE) AS value FROM fx_docs WHERE sent_label IS NOT NULL GROUP BY 2),
p2 AS (SELECT 'entity_types' AS panel, label AS key, CAST(count(*) AS DOUBLE) AS value FROM fx_ents GROUP BY 2 ORDER BY value DESC, key LIMIT 10),
p3 AS (SELECT 'top_entities' AS panel, text AS key, CAST(count(*) AS DOUBLE) AS value FROM fx_ents GROUP BY 2 ORDER BY value DESC, key LIMIT 10),
p4 AS (SELECT 'confidence_median' AS panel, sent_label AS key, quantile_cont(sent_score, 0.5) AS value FROM fx_docs WHERE sent_label IS NOT NULL GROUP BY 2)
SELECT panel, key, round(value, 6) AS value FROM (SELECT * FROM p1 UNION ALL SELECT * FROM p2 UNION ALL SELECT * FROM p3 UNION ALL SELECT * FROM p4)
""")
def q_dashboard_tables(spark, d):
    return round_doubles(rp.dashboard_tables(R(spark, d)))


# --- export tables (S16-S24) ----------------------------------------------------
@query("export_flat", f"""
WITH {FX}, en AS (SELECT document_id, string_agg(text, '; ' ORDER BY pos) AS ents,
                         string_agg(DISTINCT label, '; ' ORDER BY label) AS types FROM fx_ents GROUP BY 1)
SELECT d.document_id, substr(d.text, 1, 500) AS text, CAST(length(d.text) AS BIGINT) AS text_length,
       {d_word_count('d.text')} AS word_count, d.sent_label AS sentiment_label, round(d.sent_score, 6) AS sentiment_score,
       d.cls_label AS classification_label, d.cls_score AS classification_score, d.n_entities AS entity_count,
       coalesce(en.ents, '') AS entities, coalesce(en.types, '') AS entity_types, d.processed_at,
       round(d.processing_time, 6) AS processing_time, coalesce(d.error, '') AS error
FROM fx_docs d LEFT JOIN en USING (document_id)
""")
def q_export_flat(spark, d):
    return round_doubles(sk.flat_results_table(R(spark, d)))


@query("export_entities", f"""
WITH {FX} SELECT document_id, text AS entity_text, label AS entity_type, round(score, 6) AS confidence,
                 start_pos AS start_position, end_pos AS end_position FROM fx_ents
""")
def q_export_entities(spark, d):
    return round_doubles(sk.entity_rows_table(R(spark, d)))


@query("report_rows", f"""
WITH {FX}, top AS (SELECT * FROM fx_docs ORDER BY document_id LIMIT 100),
tg AS (SELECT e.document_id, string_agg(e.text || ' (' || e.label || ')', '' ORDER BY e.pos) AS tags
       FROM fx_ents e JOIN top USING (document_id) WHERE e.pos < 5 GROUP BY 1)
SELECT t.document_id, substr(t.text, 1, 100) || '...' AS text_preview, coalesce(t.sent_label, 'N/A') AS sentiment_label,
       printf('%.3f', round(coalesce(t.sent_score, 0.0), 3)) AS sentiment_score, coalesce(tg.tags, '') AS entity_tags,
       CAST(greatest(t.n_entities - 5, 0) AS BIGINT) AS more_entities
FROM top t LEFT JOIN tg USING (document_id)
""")
def q_report_rows(spark, d):
    return sk.report_rows_table(R(spark, d))


@query("workbook_results", f"""
WITH {FX} SELECT document_id AS "Document ID", substr(text, 1, 100) || '...' AS "Text Preview",
                 coalesce(sent_label, '') AS "Sentiment", round(coalesce(sent_score, 0.0), 6) AS "Sentiment Score",
                 n_entities AS "Entity Count", {d_word_count('text')} AS "Word Count" FROM fx_docs
""")
def q_workbook_results(spark, d):
    return round_doubles(sk.workbook_results_table(R(spark, d)))


@query("workbook_entities", f"""
WITH {FX} SELECT document_id AS "Document ID", text AS "Entity", label AS "Type", round(score, 6) AS "Confidence" FROM fx_ents
""")
def q_workbook_entities(spark, d):
    return round_doubles(sk.workbook_entities_table(R(spark, d)))


@query("workbook_summary", f"""
WITH {FX} SELECT 'Total Documents' AS "Metric", CAST(count(*) AS VARCHAR) AS "Value" FROM fx_docs
""")
def q_workbook_summary(spark, d):
    return sk.workbook_summary_table(R(spark, d))


@query("summary_lines", f"""
WITH {FX},
s AS (SELECT count(*) AS total_documents, count(*) FILTER (WHERE coalesce(error, '') = '') / count(*) AS success_rate,
             count(*) FILTER (WHERE sent_label = 'negative') AS n_negative, count(*) FILTER (WHERE sent_label = 'neutral') AS n_neutral,
             count(*) FILTER (WHERE sent_label = 'positive') AS n_positive, coalesce(avg(sent_score), 0) AS avg_confidence,
             coalesce(stddev_samp(sent_score), 0) AS std_confidence, sum(n_entities) AS total_entities,
             avg(n_entities) AS avg_entities_per_doc, avg(length(text)) AS avg_length, avg({d_word_count('text')}) AS avg_words,
             (SELECT count(DISTINCT text) FROM fx_ents) AS unique_entities FROM fx_docs)
SELECT CAST(seq AS BIGINT) AS seq, section, line FROM (
  SELECT 0 AS seq, 'Overview' AS section, printf('- **Total Documents**: %d', total_documents) AS line FROM s
  UNION ALL SELECT 1, 'Overview', printf('- **Success Rate**: %.1f%%', round(success_rate * 100, 1)) FROM s
  UNION ALL SELECT 2, 'Sentiment Analysis', printf('- **negative**: %d', n_negative) FROM s
  UNION ALL SELECT 3, 'Sentiment Analysis', printf('- **neutral**: %d', n_neutral) FROM s
  UNION ALL SELECT 4, 'Sentiment Analysis', printf('- **positive**: %d', n_positive) FROM s
  UNION ALL SELECT 5, 'Sentiment Analysis', printf('- **Average Confidence**: %.3f', round(avg_confidence, 3)) FROM s
  UNION ALL SELECT 6, 'Sentiment Analysis', printf('- **Confidence Std Dev**: %.3f', round(std_confidence, 3)) FROM s
  UNION ALL SELECT 7, 'Entity Analysis', printf('- **Total Entities**: %d', total_entities) FROM s
  UNION ALL SELECT 8, 'Entity Analysis', printf('- **Unique Entities**: %d', unique_entities) FROM s
  UNION ALL SELECT 9, 'Entity Analysis', printf('- **Average per Document**: %.2f', round(avg_entities_per_doc, 2)) FROM s
  UNION ALL SELECT 10, 'Text Statistics', printf('- **Average Length**: %d characters', CAST(round(avg_length, 0) AS BIGINT)) FROM s
  UNION ALL SELECT 11, 'Text Statistics', printf('- **Average Words**: %d words', CAST(round(avg_words, 0) AS BIGINT)) FROM s)
""")
def q_summary_lines(spark, d):
    return sk.summary_lines_table(ag.summary_stats(R(spark, d)))


_CACHE = f"""
WITH {FX}, c AS (SELECT md5(text) AS text_hash, 'sentiment' AS model_type, sent_label AS prediction_data,
                        sent_score AS confidence, processed_at AS created_at FROM fx_docs WHERE sent_label IS NOT NULL),
u AS (SELECT text_hash, model_type, arg_max(prediction_data, (created_at, prediction_data, confidence)) AS prediction_data,
             arg_max(confidence, (created_at, prediction_data, confidence)) AS confidence, max(created_at) AS created_at
      FROM c GROUP BY 1, 2)
"""


def _cache(spark, d):
    """A bucketed cache: the older results first, then the newer ones over them."""
    rows = staged(sk.prediction_cache_rows(R(spark, d)), "predictions")
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    cache = PredictionCache(spark, scratch_path(spark, f"cache/{uuid.uuid4().hex}"), buckets=8)
    cache.upsert(rows.filter(F.col("created_at") < cut))
    cache.upsert(rows.filter(F.col("created_at") >= cut))
    return cache


@query("prediction_upsert", _CACHE + """
SELECT text_hash, model_type, prediction_data, round(confidence, 6) AS confidence, created_at FROM u
""")
def q_prediction_upsert(spark, d):
    return round_doubles(_cache(spark, d).rows())


@query("prediction_lookup", _CACHE + """
SELECT d.doc_id, u.prediction_data, round(u.confidence, 6) AS confidence
FROM documents d LEFT JOIN u ON u.text_hash = md5(d.text) AND u.model_type = 'sentiment'
     AND u.created_at > (SELECT max(created_at) FROM u) - INTERVAL 24 hour
""")
def q_prediction_lookup(spark, d):
    from quill.sources.tables import table
    cache = _cache(spark, d)
    as_of = cache.rows().select(F.max("created_at")).scalar()
    req = table(spark, d, "documents").select("doc_id", F.md5("text").alias("text_hash"),
                                              F.lit("sentiment").alias("model_type"))
    return round_doubles(cache.lookup(req, as_of).select("doc_id", "prediction_data", "confidence"))
