"""Queries over analysed results: scoring (M*), entities (N*), aggregations (A*)."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.functions import text as tx
from quill.functions import vectors as vx
from quill.operators import aggregate as ag
from quill.operators import bayes as nb
from quill.operators import entities as en
from quill.operators import incremental as inc
from quill.operators import phrases as ph
from quill.operators import sentiment as se
from quill.plans import fixtures as fx
from quill.plans.analyze import analyze, trained_scorer
from quill.plans.catalog import query
from quill.plans.sqlbits import d_clean, d_word_count, d_words, lit
from quill.plans.sqlfix import FX, LABEL_SQL, PROBS_SQL, TEXT_WORDS, lex_probs_sql
from quill.session import scratch_path
from quill.sources.tables import table


def round_doubles(df: DataFrame, n: int = 6) -> DataFrame:
    """Presentation: doubles rounded so independent engines compare equal."""
    return df.select(*[F.round(F.col(f.name), n).alias(f.name) if f.dataType.typeName() == "double"
                       else F.col(f.name) for f in df.schema.fields])


def R(spark, d):
    return fx.results(spark, d)


# Parameters: a sentiment lexicon of words that occur in the test text.
LEXICON = [("the", 1.0), ("of", 1.0), ("and", -1.0), ("to", -1.0), ("in", 0.5), ("is", -0.5)]


def lexicon_df(spark):
    return spark.createDataFrame(LEXICON, "word string, weight double")


LEX_SQL = "(VALUES " + ", ".join(f"({lit(w)}, CAST({v} AS DOUBLE))" for w, v in LEXICON) + ") AS lx(word, weight)"


def d_spans(src: str, id_col: str, text_col: str, pattern: str, label: str) -> str:
    """DuckDB: every match of ``pattern`` with offsets from the gaps between matches."""
    p = lit(pattern)
    return f"""
SELECT mc.id, mc.etext AS text, CAST(gc.gsum + mc.msum AS INTEGER) AS start_pos,
       CAST(gc.gsum + mc.msum + length(mc.etext) AS INTEGER) AS end_pos, {lit(label)} AS label
FROM (SELECT id, i, etext, sum(length(etext)) OVER (PARTITION BY id ORDER BY i) - length(etext) AS msum
      FROM (SELECT id, unnest(ms) AS etext, generate_subscripts(ms, 1) AS i
            FROM (SELECT {id_col} AS id, regexp_extract_all({text_col}, {p}) AS ms FROM {src}))) mc
JOIN (SELECT id, i, sum(length(g)) OVER (PARTITION BY id ORDER BY i) AS gsum
      FROM (SELECT id, unnest(gs) AS g, generate_subscripts(gs, 1) AS i
            FROM (SELECT {id_col} AS id, string_split_regex({text_col}, {p}) AS gs FROM {src}))) gc
  ON gc.id = mc.id AND gc.i = mc.i"""


RULE_SPANS_SQL = " UNION ALL ".join(
    "(" + d_spans("documents", "doc_id", "text", pat, lab) + ")" for lab, pat in en.PATTERN_RULES)
RULE_TYPE_SQL = ("CASE label " + " ".join(f"WHEN {lit(k)} THEN {lit(v)}" for k, v in en.ENTITY_TYPES.items())
                 + " ELSE label END")


def rule_entities(spark, d):
    docs = table(spark, d, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", "text",
                       en.extract_entities(F.col("text")).alias("entities"))


# --- A1 flagship --------------------------------------------------------------
# Entity rules for cleaned (lower-case, ASCII) text.
CLEAN_RULES = [("CARDINAL", r"[0-9]+"), ("ORG", r"[a-z]{12,}")]


def sentiment_model(spark, d) -> nb.Model:
    """M1: trained on the labelled documents' cleaned texts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    return nb.train(nb.labelled(docs, table(spark, d, "labels"), tx.clean_text(F.col("text"))))


def flagship(spark, d, docs: DataFrame) -> DataFrame:
    """Documents through the analysis with the trained scorer, flattened."""
    res = analyze(docs, trained_scorer(sentiment_model(spark, d), spark), lambda text: en.extract_entities(text, CLEAN_RULES),
                  counter=lambda text: en.count_entities(text, CLEAN_RULES))
    return res.select("document_id", "clean", F.col("sentiment.label").alias("sentiment_label"),
                      F.col("sentiment.score").alias("sentiment_score"), "n_entities", "error")


NB_SQL = f"""
lw AS (SELECT CASE WHEN toxic = 1 THEN 0 WHEN quality = 0 THEN 1 WHEN quality = 1 THEN 2 END AS y, {d_words('clean')} AS ws
       FROM c JOIN labels USING (doc_id)),
ly AS (SELECT * FROM lw WHERE y IS NOT NULL),
cw AS (SELECT y, w, count(*) AS n FROM (SELECT y, unnest(ws) AS w FROM ly) GROUP BY ALL),
vo AS (SELECT w FROM cw GROUP BY w ORDER BY sum(n) DESC, w LIMIT {nb.WORDS}),
ct AS (SELECT k AS y, ln(coalesce(sum(n), 0) + {nb.SMOOTHING} * ((SELECT count(*) FROM vo) + 1)) AS total
       FROM range(3) r(k) LEFT JOIN (SELECT * FROM cw SEMI JOIN vo USING (w)) x ON x.y = r.k GROUP BY k),
cp AS (SELECT k AS y, ln(((SELECT count(*) FROM ly WHERE y = k) + {nb.SMOOTHING}) / ((SELECT count(*) FROM ly) + 3 * {nb.SMOOTHING})) AS prior
       FROM range(3) r(k)),
dw AS (SELECT doc_id, w, count(*) AS c FROM (SELECT doc_id, unnest({d_words('clean')}) AS w FROM c) GROUP BY ALL),
dn AS (SELECT doc_id, sum(c) AS n FROM dw GROUP BY doc_id),
kn AS (SELECT cw.* FROM cw SEMI JOIN vo USING (w)),
ds AS (SELECT dw.doc_id, ct.y, sum(dw.c * (ln(coalesce(kn.n, 0) + {nb.SMOOTHING}) - ct.total)) AS s
       FROM dw CROSS JOIN ct LEFT JOIN kn ON kn.w = dw.w AND kn.y = ct.y GROUP BY dw.doc_id, ct.y),
dp AS (SELECT c.doc_id, cp.y, cp.prior + coalesce(ds.s, 0) / sqrt(greatest(coalesce(dn.n, 0), 1)) AS x
       FROM c CROSS JOIN cp LEFT JOIN ds ON ds.doc_id = c.doc_id AND ds.y = cp.y LEFT JOIN dn ON dn.doc_id = c.doc_id),
dx AS (SELECT doc_id, max(x) AS m FROM dp GROUP BY doc_id),
de AS (SELECT dp.doc_id, max(exp(x - m)) FILTER (y = 0) AS e0, max(exp(x - m)) FILTER (y = 1) AS e1, max(exp(x - m)) FILTER (y = 2) AS e2
       FROM dp JOIN dx USING (doc_id) GROUP BY dp.doc_id),
pr AS (SELECT doc_id, e0 / (e0 + e1 + e2) AS p_neg, e1 / (e0 + e1 + e2) AS p_neu, e2 / (e0 + e1 + e2) AS p_pos FROM de)
"""
FLAGSHIP_SQL = f"""
WITH c AS (SELECT CAST(doc_id AS VARCHAR) AS document_id, doc_id, text, {d_clean('text')} AS clean FROM documents), {NB_SQL},
s AS (SELECT c.*, {LABEL_SQL} FROM c JOIN pr USING (doc_id))
SELECT document_id, clean, label AS sentiment_label, round(score, 6) AS sentiment_score,
       CAST(len(regexp_extract_all(clean, '[0-9]+')) + len(regexp_extract_all(clean, '[a-z]{{12,}}')) AS BIGINT) AS n_entities,
       CASE WHEN text IS NULL THEN 'not_a_string' WHEN regexp_full_match(text, '\\s*') THEN 'empty' END AS error
FROM s
"""


@query("batch_analyze", FLAGSHIP_SQL)
def q_batch_analyze(spark, d):
    return round_doubles(flagship(spark, d, table(spark, d, "documents")))


# --- M1..M7 -----------------------------------------------------------------
def _head(k: int) -> str:
    return "[" + ", ".join(f"5 * list_sum([CAST(embedding[i] AS DOUBLE) FOR i IN range(1, 65) IF (i - 1) % {k} = {c}])" for c in range(k)) + "]"


@query("sentiment_collapse", f"""
WITH l AS (SELECT vec_id, {_head(5)} AS x5, {_head(2)} AS x2 FROM embeddings),
e AS (SELECT vec_id, list_transform(x5, lambda v: exp(v - list_max(x5))) AS e5,
             list_transform(x2, lambda v: exp(v - list_max(x2))) AS e2 FROM l),
p AS (SELECT vec_id, list_transform(e5, lambda v: v / list_sum(e5)) AS p5,
             list_transform(e2, lambda v: v / list_sum(e2)) AS p2 FROM e)
SELECT vec_id, round(p5[1] + p5[2], 6) AS neg5, round(p5[3], 6) AS neu5, round(p5[4] + p5[5], 6) AS pos5,
       round(p2[1], 6) AS neg2, CAST(0.0 AS DOUBLE) AS neu2, round(p2[2], 6) AS pos2
FROM p
""")
def q_sentiment_collapse(spark, d):
    """M2 on five and two classes from a vector head over all components."""
    emb = table(spark, d, "embeddings")
    p5 = vx.collapse_to_three(se.probs_from_vector(F.col("embedding"), 5, 5.0))
    p2 = vx.collapse_to_three(se.probs_from_vector(F.col("embedding"), 2, 5.0))
    p = emb.select("vec_id", p5.alias("p5"), p2.alias("p2"))
    return round_doubles(p.select("vec_id", *[F.get(F.col(f"p{k}"), i).alias(f"{n}{k}") for k in (5, 2)
                                              for i, n in enumerate(["neg", "neu", "pos"])]))


@query("sentiment_label", f"WITH {FX} SELECT vec_id, label, round(score, 6) AS score FROM fx_sentiment")
def q_sentiment_label(spark, d):
    s = fx.sentiment_scores(spark, d)
    return round_doubles(s.select(F.col("doc_id").alias("vec_id"), "sentiment.label", "sentiment.score"))


@query("sentiment_distribution", f"""
WITH {FX}
SELECT CAST(count(*) AS BIGINT) AS total_texts,
       CAST(count(*) FILTER (WHERE label = 'negative') AS BIGINT) AS n_negative,
       round(count(*) FILTER (WHERE label = 'negative') * 100.0 / count(*), 6) AS pct_negative,
       CAST(count(*) FILTER (WHERE label = 'neutral') AS BIGINT) AS n_neutral,
       round(count(*) FILTER (WHERE label = 'neutral') * 100.0 / count(*), 6) AS pct_neutral,
       CAST(count(*) FILTER (WHERE label = 'positive') AS BIGINT) AS n_positive,
       round(count(*) FILTER (WHERE label = 'positive') * 100.0 / count(*), 6) AS pct_positive,
       round(avg(score), 6) AS avg_confidence, round(stddev_pop(score), 6) AS std_confidence
FROM fx_sentiment
""")
def q_sentiment_distribution(spark, d):
    return round_doubles(se.sentiment_distribution(fx.sentiment_scores(spark, d)))


AB_NEUTRAL = {"lexicon-1": fx.NEUTRAL, "lexicon-2": 0.75}


@query("ab_compare", f"""
WITH h AS (SELECT doc_id, CASE WHEN CAST(('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 8)) AS BIGINT) % 100 < 50 THEN 'A' ELSE 'B' END AS arm,
                  {lex_probs_sql(TEXT_WORDS)} FROM documents),
v AS (SELECT doc_id, arm, CASE arm WHEN 'A' THEN 'lexicon-1' ELSE 'lexicon-2' END AS model_version, a, c,
             CASE arm WHEN 'A' THEN CAST(1.5 AS DOUBLE) ELSE CAST(0.75 AS DOUBLE) END AS k FROM h),
p AS (SELECT doc_id, arm, model_version, {PROBS_SQL} FROM v), s AS (SELECT doc_id, arm, model_version, {LABEL_SQL} FROM p),
j AS (SELECT s.*, l.quality AS y, CASE WHEN label <> 'negative' THEN 1 ELSE 0 END AS yp FROM s LEFT JOIN labels l ON l.doc_id = s.doc_id)
SELECT arm, model_version, CAST(count(*) AS BIGINT) AS n_docs,
       CAST(count(*) FILTER (WHERE label = 'negative') AS BIGINT) AS n_negative,
       CAST(count(*) FILTER (WHERE label = 'neutral') AS BIGINT) AS n_neutral,
       CAST(count(*) FILTER (WHERE label = 'positive') AS BIGINT) AS n_positive,
       round(avg(score), 6) AS avg_confidence, CAST(count(y) AS BIGINT) AS n_labelled,
       round(count(*) FILTER (WHERE y = yp) / count(y), 6) AS accuracy,
       round(2 * count(*) FILTER (WHERE y = 1 AND yp = 1) / (2 * count(*) FILTER (WHERE y = 1 AND yp = 1) + count(*) FILTER (WHERE y <> yp)), 6) AS f1
FROM j GROUP BY arm, model_version
""")
def q_ab_compare(spark, d):
    """M7: two versions of the lexicon model, documents split by id, figures per arm against the labels."""
    docs = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("document_id"), "doc_id", *[
        fx.fixture_probs(F.col("text"), k).alias(v) for v, k in AB_NEUTRAL.items()])
    j = docs.join(table(spark, d, "labels").select("doc_id", "quality"), "doc_id", "left")
    return round_doubles(se.ab_compare(j, "document_id", {v: v for v in AB_NEUTRAL}, "quality"))


@query("score_lexicon", f"""
WITH t AS (SELECT doc_id, unnest(list_transform(regexp_extract_all(text, {lit(tx.WORD_TOKEN)}), lambda x: lower(x))) AS word FROM documents),
h AS (SELECT doc_id, sum(weight) AS s, count(*) AS n FROM t JOIN {LEX_SQL} USING (word) GROUP BY doc_id)
SELECT d.doc_id, round(coalesce(h.s, 0.0), 6) AS lex_score, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hits,
       CASE WHEN coalesce(h.s, 0) > 0 THEN 'positive' WHEN coalesce(h.s, 0) < 0 THEN 'negative' ELSE 'neutral' END AS label
FROM documents d LEFT JOIN h ON h.doc_id = d.doc_id
""")
def q_score_lexicon(spark, d):
    docs = table(spark, d, "documents").select(
        "doc_id", F.transform(tx.word_tokens(F.col("text")), F.lower).alias("toks"))
    return round_doubles(se.score_lexicon(docs, "toks", lexicon_df(spark)))


@query("score_distinct", f"""
WITH u AS (SELECT md5(text) AS h, min(text) AS text FROM documents GROUP BY 1),
t AS (SELECT h, unnest(list_transform(regexp_extract_all(text, {lit(tx.WORD_TOKEN)}), lambda x: lower(x))) AS word FROM u),
s AS (SELECT h, sum(weight) AS s FROM t JOIN {LEX_SQL} USING (word) GROUP BY h)
SELECT d.doc_id, round(coalesce(s.s, 0.0), 6) AS lex_score FROM documents d LEFT JOIN s ON s.h = md5(d.text)
""")
def q_score_distinct(spark, d):
    """score each distinct text once (md5 key), then join back."""
    docs = table(spark, d, "documents").select("doc_id", "text", F.md5("text").alias("h"))
    uniq = docs.groupBy("h").agg(F.min("text").alias("text"))
    toks = uniq.select(F.col("h").alias("doc_id"), F.transform(tx.word_tokens(F.col("text")), F.lower).alias("toks"))
    scored = se.score_lexicon(toks, "toks", lexicon_df(spark)).select(
        F.col("doc_id").alias("h"), "lex_score")
    return round_doubles(docs.join(scored, "h", "left").select("doc_id", "lex_score"))


# --- N1..N9 -----------------------------------------------------------------
@query("extract_entities", f"""
SELECT id AS doc_id, CAST(row_number() OVER (PARTITION BY id ORDER BY start_pos, end_pos, label) - 1 AS BIGINT) AS pos,
       text, label, {RULE_TYPE_SQL} AS type, start_pos, end_pos
FROM ({RULE_SPANS_SQL}) s
""")
def q_extract_entities(spark, d):
    r = rule_entities(spark, d)
    return tx.unnest(r, "entities", "e", "doc_id", pos="pos").select(
        "doc_id", F.col("pos").cast("bigint").alias("pos"), "e.text", "e.label", "e.type",
        F.col("e.start").alias("start_pos"), F.col("e.end").alias("end_pos"))


@query("entity_types", f"""
WITH {FX}, s AS (SELECT label FROM fx_ents UNION ALL SELECT label FROM ({RULE_SPANS_SQL}) r)
SELECT label, {RULE_TYPE_SQL} AS type, CAST(count(*) AS BIGINT) AS n FROM s GROUP BY label
""")
def q_entity_types(spark, d):
    a = en.entities_long(R(spark, d), keep=()).select("label")
    b = en.entities_long(rule_entities(spark, d), keep=()).select("label")
    return a.unionByName(b).groupBy("label").agg(
        en.entity_type(F.col("label")).alias("type"), F.count("*").cast("bigint").alias("n"))


@query("entity_counts", f"""
WITH {FX}
SELECT d.document_id, e.type, CAST(coalesce(e.n, 0) AS BIGINT) AS n, d.n_entities AS total_entities
FROM fx_docs d LEFT JOIN (SELECT document_id, type, count(*) AS n FROM fx_ents GROUP BY 1, 2) e
  ON e.document_id = d.document_id
""")
def q_entity_counts(spark, d):
    r = R(spark, d)
    return (r.select("document_id", F.explode_outer(en.entity_counts(F.col("entities"))).alias("type", "n"),
                     ag.n_entities().alias("total_entities"))
            .withColumn("n", F.coalesce("n", F.lit(0)).cast("bigint")))


@query("entities_by_type", f"""
WITH {FX} SELECT DISTINCT type, text FROM fx_ents WHERE type IN ('Person', 'Organization')
""")
def q_entities_by_type(spark, d):
    return en.entities_by_type(R(spark, d), types=["Person", "Organization"])


@query("entity_context", f"""
WITH {FX}, c AS (SELECT e.document_id, e.pos, e.text, e.start_pos, e.end_pos, greatest(e.start_pos - 50, 0) AS s,
                        least(e.end_pos + 50, length(d.text)) AS t, d.text AS doc
                 FROM fx_ents e JOIN documents d ON d.doc_id = e.doc_id)
SELECT document_id, pos, text, substr(doc, s + 1, t - s) AS context,
       CAST(start_pos - s AS INTEGER) AS rel_start, CAST(end_pos - s AS INTEGER) AS rel_end FROM c
""")
def q_entity_context(spark, d):
    r = R(spark, d)
    return (tx.unnest(r, en.entity_context(F.col("text"), F.col("entities")), "c", "document_id", pos="pos")
            .select("document_id", F.col("pos").cast("bigint").alias("pos"), "c.text", "c.context",
                    "c.rel_start", "c.rel_end"))


@query("entity_filter", f"""
WITH {FX}
SELECT d.document_id, CAST(count(e.text) AS BIGINT) AS n_kept
FROM fx_docs d LEFT JOIN fx_ents e ON e.document_id = d.document_id AND e.type IN ('Person', 'Location') AND e.score >= 0.5
GROUP BY d.document_id
""")
def q_entity_filter(spark, d):
    r = R(spark, d)
    kept = en.filter_entities(F.col("entities"), types=["Person", "Location"], min_score=0.5)
    return r.select("document_id", F.size(kept).cast("bigint").alias("n_kept"))


@query("merge_entities", f"""
WITH s AS (SELECT id, start_pos, end_pos, label FROM ({RULE_SPANS_SQL}) r),
f AS (SELECT *, max(end_pos) OVER (PARTITION BY id ORDER BY start_pos, end_pos, label
                                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev_end FROM s),
g AS (SELECT *, sum(CASE WHEN prev_end IS NULL OR start_pos >= prev_end THEN 1 ELSE 0 END)
                OVER (PARTITION BY id ORDER BY start_pos, end_pos, label ROWS UNBOUNDED PRECEDING) AS island FROM f)
SELECT CAST(id AS VARCHAR) AS document_id, CAST(island - 1 AS BIGINT) AS island, CAST(min(start_pos) AS INTEGER) AS start_pos,
       CAST(max(end_pos) AS INTEGER) AS end_pos, CAST(count(*) AS BIGINT) AS n_spans,
       arg_min(label, (-(end_pos - start_pos), start_pos, label)) AS label
FROM g GROUP BY id, island
""")
def q_merge_entities(spark, d):
    r = rule_entities(spark, d)
    return (tx.unnest(r, en.merge_entities(F.col("entities")), "m", "document_id", pos="island")
            .select("document_id", F.col("island").cast("bigint").alias("island"),
                    F.col("m.start").alias("start_pos"), F.col("m.end").alias("end_pos"), "m.n_spans", "m.label"))


# --- A2..A15 ----------------------------------------------------------------
@query("summary_stats", f"""
WITH {FX}
SELECT CAST(count(*) AS BIGINT) AS total_documents,
       round(count(*) FILTER (WHERE coalesce(error, '') = '') / count(*), 6) AS success_rate,
       CAST(count(*) FILTER (WHERE coalesce(error, '') <> '') AS BIGINT) AS failed_documents,
       CAST(count(*) FILTER (WHERE sent_label = 'negative') AS BIGINT) AS n_negative,
       CAST(count(*) FILTER (WHERE sent_label = 'neutral') AS BIGINT) AS n_neutral,
       CAST(count(*) FILTER (WHERE sent_label = 'positive') AS BIGINT) AS n_positive,
       round(coalesce(avg(sent_score), 0), 6) AS avg_confidence,
       round(coalesce(stddev_samp(sent_score), 0), 6) AS std_confidence,
       (SELECT string_agg(type || '=' || n, ', ' ORDER BY type) FROM (SELECT type, count(*) AS n FROM fx_ents GROUP BY type)) AS entity_types,
       CAST(sum(n_entities) AS BIGINT) AS total_entities,
       round(avg(n_entities), 6) AS avg_entities_per_doc,
       round(avg(length(text)), 6) AS avg_length,
       round(avg({d_word_count('text')}), 6) AS avg_words,
       round(avg(processing_time), 6) AS avg_processing_time,
       (SELECT CAST(count(DISTINCT text) AS BIGINT) FROM fx_ents) AS unique_entities
FROM fx_docs
""")
def q_summary_stats(spark, d):
    return round_doubles(ag.summary_stats(R(spark, d)))


BATCHES = 3


def batches_appended(spark, d) -> str:
    """The results in three batches (by a hash of the id), one of them written twice."""
    path = scratch_path(spark, f"batches/{uuid.uuid4().hex}")
    r = R(spark, d).withColumn("batch", F.pmod(F.xxhash64("document_id"), F.lit(BATCHES)))
    for k in (0, 1, 1, *range(2, BATCHES)):
        inc.append_batch(r.filter(F.col("batch") == k).drop("batch"), path, k)
    return path


# Sketch columns are compared with the exact figure: within 3 % (a fortieth of the rank for the median).
@query("incremental_summary", f"""
WITH {FX}
SELECT CAST(count(*) AS BIGINT) AS total_documents,
       round(count(*) FILTER (WHERE coalesce(error, '') = '') / count(*), 6) AS success_rate,
       CAST(count(*) FILTER (WHERE sent_label = 'negative') AS BIGINT) AS n_negative,
       CAST(count(*) FILTER (WHERE sent_label = 'neutral') AS BIGINT) AS n_neutral,
       CAST(count(*) FILTER (WHERE sent_label = 'positive') AS BIGINT) AS n_positive,
       round(coalesce(avg(sent_score), 0), 6) AS avg_confidence, round(coalesce(stddev_samp(sent_score), 0), 6) AS std_confidence,
       (SELECT string_agg(type || '=' || n, ', ' ORDER BY type) FROM (SELECT type, count(*) AS n FROM fx_ents GROUP BY type)) AS entity_types,
       CAST(sum(n_entities) AS BIGINT) AS total_entities, round(avg(length(text)), 6) AS avg_length,
       round(avg({d_word_count('text')}), 6) AS avg_words, round(avg(processing_time), 6) AS avg_processing_time,
       true AS unique_entities_fit, true AS median_fits
FROM fx_docs
""")
def q_incremental_summary(spark, d):
    """A2 from the states of three batches; distinct texts and the median come from sketches."""
    path = batches_appended(spark, d)
    s = inc.refresh_summary(spark, path)
    done = inc.all_results(spark, path)
    exact = done.select(F.explode("entities.text").alias("t")).agg(F.countDistinct("t")).scalar()
    med = s.select("median_confidence").scalar()
    below = done.agg(F.avg((F.col("sentiment.score") < med).cast("double"))).scalar()
    upto = done.agg(F.avg((F.col("sentiment.score") <= med).cast("double"))).scalar()
    fit = F.abs(F.col("unique_entities") - exact) <= 0.03 * exact
    return round_doubles(s.select(
        "total_documents", "success_rate", "n_negative", "n_neutral", "n_positive", "avg_confidence", "std_confidence", "entity_types",
        "total_entities", "avg_length", "avg_words", "avg_processing_time", fit.alias("unique_entities_fit"),
        ((below <= 0.525) & (upto >= 0.475)).alias("median_fits")))


@query("incremental_labels", f"""
WITH {FX}
SELECT coalesce(label, 'UNKNOWN') AS label, CAST(count(*) AS BIGINT) AS total_occurrences, true AS unique_entities_fit,
       round(avg(coalesce(score, 0.0)), 6) AS avg_confidence,
       round(count(DISTINCT document_id) / (SELECT count(*) FROM fx_docs), 6) AS document_coverage
FROM fx_ents GROUP BY 1
""")
def q_incremental_labels(spark, d):
    """A4 from the states of three batches."""
    path = batches_appended(spark, d)
    exact = ag.agg_by_entity_type(inc.all_results(spark, path)).select("label", F.col("unique_entities").alias("exact"))
    fit = F.abs(F.col("unique_entities") - F.col("exact")) <= 0.03 * F.col("exact")
    return round_doubles(inc.refresh_labels(spark, path).join(exact, "label").select(
        "label", "total_occurrences", fit.alias("unique_entities_fit"), "avg_confidence", "document_coverage"))


@query("agg_by_sentiment", f"""
WITH {FX}
SELECT sent_label AS sentiment, CAST(count(*) AS BIGINT) AS count,
       round(count(*) * 100.0 / (SELECT count(*) FROM fx_docs), 6) AS percentage,
       round(avg(sent_score), 6) AS avg_confidence, round(avg(length(text)), 6) AS avg_length,
       round(avg({d_word_count('text')}), 6) AS avg_words, CAST(sum(length(text)) AS BIGINT) AS total_chars,
       CAST(sum({d_word_count('text')}) AS BIGINT) AS total_words
FROM fx_docs WHERE sent_label IS NOT NULL GROUP BY sent_label
""")
def q_agg_by_sentiment(spark, d):
    return round_doubles(ag.agg_by_sentiment(R(spark, d)))


def _top_sql(group_expr: str, name: str, n: int, where: str) -> str:
    return f"""
WITH {FX}, c AS (SELECT {group_expr} AS {name}, e.text AS entity, count(*) AS cnt
                 FROM fx_ents e JOIN fx_docs d ON d.document_id = e.document_id WHERE {where} GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY {name} ORDER BY cnt DESC, entity) AS rk FROM c)
SELECT {name}, entity, CAST(cnt AS BIGINT) AS count, CAST(rk AS BIGINT) AS rank FROM r WHERE rk <= {n}
"""


@query("agg_by_sentiment_entities", _top_sql("d.sent_label", "sentiment", 10, "d.sent_label IS NOT NULL"))
def q_agg_by_sentiment_entities(spark, d):
    return ag.top_entities_by(R(spark, d), ag.sent_label(), "sentiment", 10)


@query("agg_by_entity_type", f"""
WITH {FX}
SELECT coalesce(label, 'UNKNOWN') AS label, CAST(count(*) AS BIGINT) AS total_occurrences,
       CAST(count(DISTINCT text) AS BIGINT) AS unique_entities, round(avg(coalesce(score, 0.0)), 6) AS avg_confidence,
       round(count(DISTINCT document_id) / (SELECT count(*) FROM fx_docs), 6) AS document_coverage
FROM fx_ents GROUP BY 1
""")
def q_agg_by_entity_type(spark, d):
    return round_doubles(ag.agg_by_entity_type(R(spark, d)))


@query("agg_by_entity_type_top", f"""
WITH {FX}, c AS (SELECT label, text AS entity, count(*) AS cnt FROM fx_ents GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY cnt DESC, entity) AS rk FROM c)
SELECT label, entity, CAST(cnt AS BIGINT) AS count, CAST(rk AS BIGINT) AS rank FROM r WHERE rk <= 20
""")
def q_agg_by_entity_type_top(spark, d):
    return ag.top_entities_per_label(R(spark, d), 20)


@query("agg_by_window", f"""
WITH {FX},
w AS (SELECT date_trunc('day', processed_at) AS window_start, CAST(count(*) AS BIGINT) AS document_count,
             CAST(count(*) FILTER (WHERE sent_label = 'negative') AS BIGINT) AS n_negative,
             CAST(count(*) FILTER (WHERE sent_label = 'neutral') AS BIGINT) AS n_neutral,
             CAST(count(*) FILTER (WHERE sent_label = 'positive') AS BIGINT) AS n_positive,
             CAST(sum(n_entities) AS BIGINT) AS entity_count, round(coalesce(avg(sent_score), 0), 6) AS avg_confidence
      FROM fx_docs GROUP BY 1),
u AS (SELECT date_trunc('day', processed_at) AS window_start, count(DISTINCT text) AS n FROM fx_ents GROUP BY 1)
SELECT w.window_start, w.window_start + INTERVAL 1 day AS window_end, document_count, n_negative, n_neutral, n_positive,
       entity_count, CAST(coalesce(u.n, 0) AS BIGINT) AS unique_entities, avg_confidence
FROM w LEFT JOIN u USING (window_start)
""")
def q_agg_by_window(spark, d):
    return round_doubles(ag.agg_by_window(R(spark, d), "1 day"))


@query("agg_by_classification", f"""
WITH {FX}
SELECT cls_label AS classification, CAST(count(*) AS BIGINT) AS count,
       round(count(*) * 100.0 / (SELECT count(*) FROM fx_docs), 6) AS percentage,
       CAST(count(*) FILTER (WHERE sent_label = 'negative') AS BIGINT) AS n_negative,
       CAST(count(*) FILTER (WHERE sent_label = 'neutral') AS BIGINT) AS n_neutral,
       CAST(count(*) FILTER (WHERE sent_label = 'positive') AS BIGINT) AS n_positive,
       round(avg(coalesce(cls_score, 0.0)), 6) AS avg_classification_confidence
FROM fx_docs WHERE cls_label IS NOT NULL GROUP BY 1
""")
def q_agg_by_classification(spark, d):
    return round_doubles(ag.agg_by_classification(R(spark, d)))


@query("agg_by_classification_entities", _top_sql("d.cls_label", "classification", 10, "d.cls_label IS NOT NULL"))
def q_agg_by_classification_entities(spark, d):
    return ag.top_entities_by(R(spark, d), F.col("classification.label"), "classification", 10)


@query("entity_cooccurrence", f"""
WITH {FX}, de AS (SELECT DISTINCT document_id, text FROM fx_ents),
p AS (SELECT a.text AS entity1, b.text AS entity2, count(*) AS c
      FROM de a JOIN de b ON a.document_id = b.document_id AND a.text < b.text GROUP BY 1, 2)
SELECT entity1, entity2, CAST(c AS BIGINT) AS co_occurrence_count,
       round(c / (SELECT count(*) FROM fx_docs), 6) AS strength FROM p WHERE c >= 3
""")
def q_entity_cooccurrence(spark, d):
    return round_doubles(ag.entity_cooccurrence(R(spark, d), 3))


def _outlier_sql(metric: str, value_expr: str, where: str = "TRUE") -> str:
    return f"""
WITH {FX}, v AS (SELECT document_id, CAST({value_expr} AS DOUBLE) AS value FROM fx_docs WHERE {where}),
s AS (SELECT avg(value) AS m, coalesce(stddev_samp(value), 0) AS sd FROM v),
z AS (SELECT document_id, value, CASE WHEN sd > 0 THEN abs(value - m) / sd ELSE 0 END AS z_score, m, sd FROM v, s)
SELECT document_id, '{metric}' AS metric, round(value, 6) AS value, round(z_score, 6) AS z_score,
       round(m, 6) AS mean, round(sd, 6) AS std_dev FROM z WHERE z_score > 2.0
"""


@query("outliers_confidence", _outlier_sql("sentiment_confidence", "sent_score", "sent_score IS NOT NULL"))
def q_outliers_confidence(spark, d):
    return round_doubles(ag.find_outliers(R(spark, d), "sentiment_confidence", 2.0))


@query("outliers_entity_count", _outlier_sql("entity_count", "n_entities"))
def q_outliers_entity_count(spark, d):
    return round_doubles(ag.find_outliers(R(spark, d), "entity_count", 2.0))


@query("outliers_text_length", _outlier_sql("text_length", "length(text)"))
def q_outliers_text_length(spark, d):
    return round_doubles(ag.find_outliers(R(spark, d), "text_length", 2.0))


@query("trend_sentiment", f"""
WITH {FX}, daily AS (SELECT CAST(processed_at AS DATE) AS day, count(*) AS docs FROM fx_docs GROUP BY 1),
per AS (SELECT CAST(processed_at AS DATE) AS day, sent_label, count(*) AS n FROM fx_docs WHERE sent_label IS NOT NULL GROUP BY 1, 2),
sh AS (SELECT per.day, sent_label, n / docs AS share FROM per JOIN daily USING (day)),
o AS (SELECT sent_label AS sentiment, arg_min(share, day) AS start_value, arg_max(share, day) AS end_value FROM sh GROUP BY 1)
SELECT sentiment, round(start_value, 6) AS start_value, round(end_value, 6) AS end_value,
       CASE WHEN end_value > start_value THEN 'increasing' ELSE 'decreasing' END AS direction,
       round(end_value - start_value, 6) AS change
FROM o WHERE (SELECT count(*) FROM daily) >= 2
""")
def q_trend_sentiment(spark, d):
    return round_doubles(ag.trend_sentiment(R(spark, d)))


@query("trend_entity_density", f"""
WITH {FX}, daily AS (SELECT CAST(processed_at AS DATE) AS day, count(*) AS docs, sum(n_entities) AS ents FROM fx_docs GROUP BY 1),
a AS (SELECT min(day) AS ps, max(day) AS pe, count(*) AS n_days, arg_min(ents / docs, day) AS st,
             arg_max(ents / docs, day) AS en, avg(ents / docs) AS dae FROM daily)
SELECT CASE WHEN n_days >= 2 THEN CAST(ps AS VARCHAR) END AS period_start,
       CASE WHEN n_days >= 2 THEN CAST(pe AS VARCHAR) END AS period_end, CAST(n_days AS BIGINT) AS n_days,
       CASE WHEN n_days >= 2 THEN round(st, 6) END AS start, CASE WHEN n_days >= 2 THEN round(en, 6) END AS "end",
       CASE WHEN n_days >= 2 THEN round(en - st, 6) END AS change,
       CASE WHEN n_days >= 2 THEN round((SELECT count(*) FROM fx_docs) / n_days, 6) END AS daily_avg_documents,
       CASE WHEN n_days >= 2 THEN round(dae, 6) END AS daily_avg_entities,
       CASE WHEN n_days < 2 THEN 'Insufficient data for trend analysis' END AS error
FROM a
""")
def q_trend_entity_density(spark, d):
    return round_doubles(ag.trend_entity_density(R(spark, d)))


@query("top_entities", f"""
WITH {FX} SELECT text, CAST(count(*) AS BIGINT) AS count FROM fx_ents GROUP BY text ORDER BY count DESC, text LIMIT 10
""")
def q_top_entities(spark, d):
    return ag.top_entities(R(spark, d), 10)


@query("unique_entities", f"WITH {FX} SELECT CAST(count(DISTINCT text) AS BIGINT) AS unique_entities FROM fx_ents")
def q_unique_entities(spark, d):
    return ag.unique_entities(R(spark, d))


@query("union_results", f"""
WITH {FX}, u AS (SELECT 'documents' AS src, n_entities, length(text) AS n FROM fx_docs
                 UNION ALL SELECT 'benchmark', CAST(len(regexp_extract_all(text, '[A-Z][a-z]+')) AS BIGINT), length(text) FROM benchmark)
SELECT src, CAST(count(*) AS BIGINT) AS n_results, CAST(sum(n_entities) AS BIGINT) AS total_entities,
       round(avg(n), 6) AS avg_length FROM u GROUP BY src
""")
def q_union_results(spark, d):
    """Append a second result set and refresh the metrics."""
    r1 = R(spark, d).select("text", "entities").withColumn("src", F.lit("documents"))
    bench = table(spark, d, "benchmark")
    r2 = bench.select("text", fx.fixture_entities(F.col("text")).alias("entities")).withColumn("src", F.lit("benchmark"))
    u = r1.unionByName(r2)
    return round_doubles(u.groupBy("src").agg(F.count("*").cast("bigint").alias("n_results"),
                                              F.sum(ag.n_entities()).cast("bigint").alias("total_entities"),
                                              F.avg(F.length("text")).alias("avg_length")))


@query("run_stats", f"""
WITH {FX}
SELECT CAST(count(*) AS BIGINT) AS processed, round(coalesce(avg(processing_time), 0), 6) AS avg_time,
       round(coalesce(count(*) / sum(processing_time), 0), 6) AS throughput FROM fx_docs
""")
def q_run_stats(spark, d):
    return round_doubles(ag.run_stats(R(spark, d)))


@query("frequent_texts", f"""
WITH {FX}
SELECT md5(text) AS text_hash, CAST(count(*) AS BIGINT) AS count FROM fx_docs
WHERE processed_at > (SELECT max(processed_at) FROM fx_docs) - INTERVAL 7 day
GROUP BY 1 ORDER BY count DESC, text_hash LIMIT 1000
""")
def q_frequent_texts(spark, d):
    return ag.frequent_texts(R(spark, d))


@query("dedup_documents", """
SELECT doc_id, text, lang, source, n_chars FROM (
  SELECT *, row_number() OVER (PARTITION BY md5(text) ORDER BY doc_id) AS rn FROM documents
  WHERE text IS NOT NULL AND length(regexp_replace(text, '\\s+', '', 'g')) > 0) t WHERE rn = 1
""")
def q_dedup_documents(spark, d):
    return ag.dedup_documents(table(spark, d, "documents"))


def _relations_sql() -> str:
    from quill.plans.q_features import _pos_sql
    return f"""
WITH sl AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents),
s AS (SELECT doc_id, unnest(l) AS sentence, generate_subscripts(l, 1) - 1 AS sent_no FROM sl),
tk AS (SELECT doc_id, sent_no, regexp_extract_all(sentence, {lit(tx.WORD_TOKEN)}) AS toks FROM s),
t AS (SELECT doc_id, sent_no, unnest(toks) AS token, generate_subscripts(toks, 1) - 1 AS pos FROM tk),
tg AS (SELECT *, {_pos_sql()} AS tag FROM t),
e AS (SELECT doc_id, sent_no, pos, token FROM tg WHERE regexp_full_match(token, '[A-Z][a-z]+')),
v AS (SELECT doc_id, sent_no, pos, token FROM tg WHERE tag = 'VERB'),
p AS (SELECT a.doc_id, a.sent_no, a.pos AS p1, b.pos AS p2, a.token AS entity1, b.token AS entity2
      FROM e a JOIN e b ON a.doc_id = b.doc_id AND a.sent_no = b.sent_no AND a.pos < b.pos)
SELECT p.doc_id, CAST(p.sent_no AS BIGINT) AS sent_no, CAST(p.p1 AS BIGINT) AS p1, CAST(p.p2 AS BIGINT) AS p2,
       p.entity1, p.entity2, string_agg(v.token, ' ' ORDER BY v.pos) AS relation
FROM p JOIN v ON v.doc_id = p.doc_id AND v.sent_no = p.sent_no AND v.pos > p.p1 AND v.pos < p.p2
GROUP BY p.doc_id, p.sent_no, p.p1, p.p2, p.entity1, p.entity2
"""


@query("entity_relations", _relations_sql())
def q_entity_relations(spark, d):
    return en.entity_relations(table(spark, d, "documents"), "doc_id", "text")


@query("agg_by_window_entities", f"""
WITH {FX}, c AS (SELECT date_trunc('day', processed_at) AS window_start, text AS entity, count(*) AS n FROM fx_ents GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY window_start ORDER BY n DESC, entity) AS rk FROM c)
SELECT window_start, entity, CAST(n AS BIGINT) AS count, CAST(rk AS BIGINT) AS rank FROM r WHERE rk <= 10
""")
def q_agg_by_window_entities(spark, d):
    """A5: the entities of each day window (top 10 by count, then text)."""
    r = R(spark, d)
    w = F.window("processed_at", "1 day")
    return (ag.top_entities_by(r.withColumn("w", w.start.cast("timestamp_ntz")), F.col("w"), "window_start", 10))


# Dictionary: the 30 most frequent capitalised words of the documents, and from every benchmark
# text a phrase of each length from 2 to 10 words (so the work grows with both tables).
PHRASE_SIZES = range(2, 11)
PHRASE_LABELS = ["EVENT", "GPE", "PRODUCT"]


def gazetteer(spark, d):
    docs = table(spark, d, "documents")
    toks = docs.select(F.explode(F.regexp_extract_all("text", F.lit(ph.TOKEN_PATTERN), 0)).alias("w"))
    words = toks.filter(F.col("w").rlike("^[A-Z][a-z]+$")).select(F.lower("w").alias("phrase"))
    top = (words.groupBy("phrase").agg(F.count("*").alias("n"))
           .orderBy(F.desc("n"), F.asc("phrase")).limit(30).select("phrase", F.lit("ORG").alias("label")))
    item = table(spark, d, "benchmark").select(
        "item_id", F.transform(F.regexp_extract_all("text", F.lit(ph.TOKEN_PATTERN), 0), F.lower).alias("ws"),
        F.explode(F.array(*[F.lit(n) for n in PHRASE_SIZES])).alias("n")).filter("size(ws) >= n")
    at = ((F.col("item_id") * 7 + F.col("n") * 3) % (F.size("ws") - F.col("n") + 1)).cast("int") + 1
    label = F.get(F.array(*[F.lit(x) for x in PHRASE_LABELS]), F.col("n") % len(PHRASE_LABELS))
    phrases = item.select(F.array_join(F.slice("ws", at, F.col("n")), " ").alias("phrase"), label.alias("label"))
    return top.unionByName(phrases)


_TOK_SPANS = d_spans("documents", "doc_id", "text", ph.TOKEN_PATTERN, "T")
GAZ_SQL = f"""
t AS (SELECT id AS doc_id, lower(text) AS w, start_pos, end_pos,
             row_number() OVER (PARTITION BY id ORDER BY start_pos) AS i FROM ({_TOK_SPANS}) x),
l AS (SELECT doc_id, list(w ORDER BY i) AS ws FROM t GROUP BY doc_id),
g AS (SELECT t.doc_id, t.i, n, t.start_pos, array_to_string(list_slice(l.ws, t.i, t.i + n - 1), ' ') AS phrase
      FROM t JOIN l USING (doc_id), range(1, {max(PHRASE_SIZES) + 1}) r(n) WHERE t.i + n - 1 <= len(l.ws)),
cw AS (SELECT lower(w) AS phrase FROM (SELECT unnest(regexp_extract_all(text, {lit(ph.TOKEN_PATTERN)})) AS w FROM documents)
       WHERE regexp_full_match(w, '[A-Z][a-z]+')),
tw AS (SELECT phrase, 'ORG' AS label FROM (SELECT phrase, count(*) AS n FROM cw GROUP BY 1 ORDER BY n DESC, phrase LIMIT 30)),
bw AS (SELECT item_id, list_transform(regexp_extract_all(text, {lit(ph.TOKEN_PATTERN)}), lambda x: lower(x)) AS ws FROM benchmark),
bp AS (SELECT ws, n, (item_id * 7 + n * 3) % (len(ws) - n + 1) + 1 AS a FROM bw, range({min(PHRASE_SIZES)}, {max(PHRASE_SIZES) + 1}) r(n)
       WHERE len(ws) >= n),
gz AS (SELECT phrase, label FROM tw UNION SELECT array_to_string(list_slice(ws, a, a + n - 1), ' '), {PHRASE_LABELS}[n % {len(PHRASE_LABELS)} + 1] FROM bp),
m AS (SELECT doc_id, i, max(n) AS n FROM g SEMI JOIN gz USING (phrase) GROUP BY doc_id, i),
c AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k FROM m),
s AS (SELECT doc_id, k, i, n, i + n AS free, true AS stays FROM c WHERE k = 1
      UNION ALL SELECT c.doc_id, c.k, c.i, c.n, CASE WHEN c.i >= s.free THEN c.i + c.n ELSE s.free END, c.i >= s.free
      FROM s JOIN c ON c.doc_id = s.doc_id AND c.k = s.k + 1)
"""


@query("extract_gazetteer", f"""
WITH RECURSIVE {GAZ_SQL}
SELECT g.doc_id, g.phrase AS text, gz.label,
       CASE gz.label WHEN 'ORG' THEN 'Organization' WHEN 'EVENT' THEN 'Event' WHEN 'GPE' THEN 'Location' ELSE 'Product' END AS type,
       CAST(g.start_pos AS INTEGER) AS start, CAST(e.end_pos AS INTEGER) AS "end"
FROM s JOIN g ON g.doc_id = s.doc_id AND g.i = s.i AND g.n = s.n JOIN t e ON e.doc_id = s.doc_id AND e.i = s.i + s.n - 1
JOIN gz ON gz.phrase = g.phrase WHERE s.stays
""")
def q_extract_gazetteer(spark, d):
    """N1 (b): leftmost-longest dictionary phrases of one to ten words with character offsets."""
    return en.extract_gazetteer(table(spark, d, "documents"), "doc_id", "text", gazetteer(spark, d))


@query("score_model", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) AS word FROM documents),
h AS (SELECT doc_id, sum(weight) AS sc FROM t JOIN {LEX_SQL} USING (word) GROUP BY doc_id),
z AS (SELECT d.doc_id, exp(-coalesce(h.sc, 0) / 100.0) AS a, exp(coalesce(h.sc, 0) / 100.0) AS c
      FROM documents d LEFT JOIN h USING (doc_id)),
p AS (SELECT doc_id, a / (a + 1 + c) AS pn, 1 / (a + 1 + c) AS pu, c / (a + 1 + c) AS pp FROM z)
SELECT doc_id, CASE WHEN pn >= pu AND pn >= pp THEN 'negative' WHEN pu >= pp THEN 'neutral' ELSE 'positive' END AS label,
       round(greatest(pn, pu, pp), 6) AS score FROM p
""")
def q_score_model(spark, d):
    """M1 (c): a user model in Arrow batches (factory run once per Python worker)."""
    from quill.operators.models import lexicon_model
    scored = se.attach_sentiment(se.score_with_model(table(spark, d, "documents").select("doc_id", "text"), "text",
                                                     lexicon_model(LEXICON)))
    return round_doubles(scored.select("doc_id", F.col("sentiment.label").alias("label"),
                                       F.col("sentiment.score").alias("score")))


@query("extract_model", "SELECT id AS doc_id, text, label, start_pos AS start, end_pos AS \"end\" FROM ("
       + d_spans("documents", "doc_id", "text", r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+\.[a-z]+", "EMAIL") + ") s")
def q_extract_model(spark, d):
    """N1 (c): a user entity model in Arrow batches, results in the canonical entity struct."""
    from quill.operators.models import email_model
    out = en.extract_with_model(table(spark, d, "documents").select("doc_id", "text"), "text", email_model)
    return tx.unnest(out, "entities", "e", "doc_id").select("doc_id", "e.text", "e.label", "e.start", "e.end")
