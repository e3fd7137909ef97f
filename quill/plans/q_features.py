"""Queries for features, embeddings, token ids and tagging (F*, T5-T9, N4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from quill.functions import text as tx
from quill.functions import vectors as vx
from quill.operators import features as fe
from quill.operators import language as la
from quill.operators import search as se
from quill.plans.catalog import query
from quill.plans.q_results import round_doubles
from quill.plans.sqlbits import lit
from quill.sources.tables import table

DIM = 64
TERMS = f"list_transform(regexp_extract_all(coalesce(text, ''), {lit(fe.TERM_PATTERN)}), lambda x: lower(x))"


def docs(spark, d):
    return table(spark, d, "documents")


def wv(spark, d):
    return fe.word_vectors_from_counts(docs(spark, d), "text", table(spark, d, "embeddings"))


WV_SQL = f"""
wc AS (SELECT word, count(*) AS c FROM (SELECT unnest({TERMS}) AS word FROM documents) GROUP BY word),
wr AS (SELECT word, row_number() OVER (ORDER BY c DESC, word) - 1 AS vec_id FROM wc),
wv AS (SELECT wr.word, e.embedding AS vec FROM wr JOIN embeddings e ON e.vec_id = wr.vec_id),
grid AS (SELECT doc_id, d AS dim FROM documents, range(0, {DIM}) r(d))
"""


@query("count_vector", f"""
WITH t AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
v AS (SELECT term FROM t GROUP BY term ORDER BY count(*) DESC, term LIMIT 10000)
SELECT doc_id, term, CAST(count(*) AS BIGINT) AS count FROM t JOIN v USING (term) GROUP BY 1, 2
""")
def q_count_vector(spark, d):
    return fe.count_vector(docs(spark, d), "doc_id", "text")


TFIDF_FIT = f"""
t AS (SELECT doc_id, unnest({TERMS}) AS term FROM documents),
s AS (SELECT term, count(*) AS cnt, count(DISTINCT doc_id) AS df FROM t GROUP BY term),
v AS (SELECT term, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM s ORDER BY cnt DESC, term LIMIT 10000)
"""


@query("tfidf", f"""
WITH {TFIDF_FIT},
tf AS (SELECT doc_id, term, count(*) AS tf FROM t JOIN v USING (term) GROUP BY 1, 2),
w AS (SELECT doc_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN v USING (term))
SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w
""")
def q_tfidf(spark, d):
    return round_doubles(fe.tfidf(docs(spark, d), "doc_id", "text"))


@query("tfidf_transform", f"""
WITH {TFIDF_FIT},
b AS (SELECT item_id, unnest({TERMS}) AS term FROM benchmark),
tf AS (SELECT item_id, term, count(*) AS tf FROM b JOIN v USING (term) GROUP BY 1, 2),
w AS (SELECT item_id, term, (1 + ln(tf)) * idf AS w FROM tf JOIN v USING (term))
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM w
""")
def q_tfidf_transform(spark, d):
    """vocabulary and idf fitted on documents, applied to the benchmark texts."""
    model = fe.tfidf_fit(docs(spark, d), "doc_id", "text")
    return round_doubles(fe.tfidf_transform(table(spark, d, "benchmark"), "item_id", "text", model))


NGRAM_FIT = f"""
t AS (SELECT doc_id, {TERMS} AS tk FROM documents),
g AS (SELECT doc_id, unnest(list_concat(tk, [tk[i] || ' ' || tk[i + 1] FOR i IN range(1, len(tk))])) AS term FROM t),
tf AS (SELECT doc_id, term, count(*) AS tf FROM g GROUP BY 1, 2),
s AS (SELECT term, sum(tf) AS cnt, count(*) AS df FROM tf GROUP BY term),
v AS (SELECT term FROM s WHERE df >= 5 AND df <= 0.5 * (SELECT count(*) FROM documents) ORDER BY cnt DESC, term LIMIT 5000)
"""


@query("tfidf_ngrams", f"""
WITH {NGRAM_FIT}
SELECT doc_id, term, round(tf / sum(tf) OVER (PARTITION BY doc_id), 6) AS weight FROM tf JOIN v USING (term)
""")
def q_tfidf_ngrams(spark, d):
    """F2 with uni- and bigrams, absolute min_df, fractional max_df, no idf, plain tf and the l1 norm."""
    return round_doubles(fe.tfidf(docs(spark, d), "doc_id", "text", max_features=5000, min_df=5, max_df=0.5, sublinear_tf=False,
                                  ngram_range=(1, 2), use_idf=False, norm="l1"))


@query("ngrams", f"""
WITH t AS (SELECT doc_id, {TERMS} AS tk FROM documents),
g AS (SELECT doc_id, list_transform(range(1, len(tk)), lambda i: tk[i] || ' ' || tk[i + 1]) AS gs FROM t WHERE len(tk) >= 2)
SELECT doc_id, CAST(generate_subscripts(gs, 1) - 1 AS BIGINT) AS pos, unnest(gs) AS ngram FROM g
""")
def q_ngrams(spark, d):
    g = tx.ngrams(fe.terms(F.col("text")), 2)
    return tx.unnest(docs(spark, d), g, "ngram", "doc_id", pos="pos").withColumn("pos", F.col("pos").cast("bigint"))


@query("lda_topics", None)
def q_lda_topics(spark, d):
    dist, _ = fe.lda_topics(docs(spark, d), "doc_id", "text")
    return dist


@query("lda_top_words", None)
def q_lda_top_words(spark, d):
    _, words = fe.lda_topics(docs(spark, d), "doc_id", "text")
    return words


def _doc_vec_sql(agg: str) -> str:
    return f"""
WITH {WV_SQL},
hits AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({TERMS}) AS word FROM documents) JOIN wv USING (word) GROUP BY 1, 2),
ex AS (SELECT h.doc_id, h.n, generate_subscripts(wv.vec, 1) - 1 AS dim, CAST(unnest(wv.vec) AS DOUBLE) AS v FROM hits h JOIN wv USING (word)),
vals AS (SELECT doc_id, dim, {agg} AS value FROM ex GROUP BY 1, 2)
SELECT grid.doc_id, CAST(grid.dim AS BIGINT) AS dim, round(coalesce(vals.value, 0.0), 6) AS value
FROM grid LEFT JOIN vals USING (doc_id, dim)
"""


@query("embed_mean", _doc_vec_sql("sum(v * n) / sum(n)"))
def q_embed_mean(spark, d):
    return round_doubles(fe.doc_vectors(docs(spark, d), "doc_id", "text", wv(spark, d), DIM, "mean"))


@query("embed_max", _doc_vec_sql("max(v)"))
def q_embed_max(spark, d):
    return round_doubles(fe.doc_vectors(docs(spark, d), "doc_id", "text", wv(spark, d), DIM, "max"))


@query("embed_sum", _doc_vec_sql("sum(v * n)"))
def q_embed_sum(spark, d):
    return round_doubles(fe.doc_vectors(docs(spark, d), "doc_id", "text", wv(spark, d), DIM, "sum"))


@query("pool_cls", f"""
WITH {WV_SQL},
f AS (SELECT doc_id, ({TERMS})[1] AS word FROM documents WHERE len({TERMS}) > 0),
ex AS (SELECT f.doc_id, generate_subscripts(wv.vec, 1) - 1 AS dim, CAST(unnest(wv.vec) AS DOUBLE) AS v FROM f JOIN wv USING (word))
SELECT grid.doc_id, CAST(grid.dim AS BIGINT) AS dim, round(coalesce(ex.v, 0.0), 6) AS value FROM grid LEFT JOIN ex USING (doc_id, dim)
""")
def q_pool_cls(spark, d):
    return round_doubles(fe.pool_tokens(docs(spark, d), "doc_id", "text", wv(spark, d), DIM, "cls"))


@query("pool_mean", _doc_vec_sql("sum(v * n) / sum(n)"))
def q_pool_mean(spark, d):
    return round_doubles(fe.pool_tokens(docs(spark, d), "doc_id", "text", wv(spark, d), DIM, "mean"))


@query("pool_max", f"""
WITH {WV_SQL},
hits AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest({TERMS}) AS word FROM documents) JOIN wv USING (word) GROUP BY 1, 2),
ex AS (SELECT h.doc_id, generate_subscripts(wv.vec, 1) - 1 AS dim, CAST(unnest(wv.vec) AS DOUBLE) AS v FROM hits h JOIN wv USING (word)),
oov AS (SELECT doc_id FROM (SELECT doc_id, unnest({TERMS}) AS word FROM documents) WHERE word NOT IN (SELECT word FROM wv) GROUP BY 1),
vals AS (SELECT doc_id, dim, max(v) AS value FROM (SELECT * FROM ex UNION ALL SELECT oov.doc_id, g.d, 0.0 FROM oov, range(0, {DIM}) g(d)) GROUP BY 1, 2)
SELECT grid.doc_id, CAST(grid.dim AS BIGINT) AS dim, round(coalesce(vals.value, 0.0), 6) AS value FROM grid LEFT JOIN vals USING (doc_id, dim)
""")
def q_pool_max(spark, d):
    return round_doubles(fe.pool_tokens(docs(spark, d), "doc_id", "text", wv(spark, d), DIM, "max"))


@query("embed_udf", None)
def q_embed_udf(spark, d):
    """model embeddings in Arrow batches (hashing fallback model)."""
    out = fe.embed_with_model(docs(spark, d).select("doc_id", "text"), "text", lambda: fe.hashing_embedder(DIM), DIM)
    return out.select("doc_id", F.size("embedding").cast("bigint").alias("dim"),
                      F.round(vx.norm2(vx.to_double_array(F.col("embedding"))), 4).alias("norm"))


@query("cosine_topk", """
WITH q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT qv FROM q)), 6) AS score
FROM embeddings ORDER BY list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT qv FROM q)) DESC, vec_id LIMIT 10
""")
def q_cosine_topk(spark, d):
    emb = table(spark, d, "embeddings")
    query_vec = emb.filter(F.col("vec_id") == 0).select(F.col("embedding").alias("q"))
    return round_doubles(fe.cosine_topk(emb, "vec_id", "embedding", query_vec, 10))


@query("cosine_topk_many", """
WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
s AS (SELECT q.vec_id AS query, v.vec_id AS key, list_cosine_similarity(q.v, v.v) AS score FROM v q, v WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, key) AS rank FROM s)
SELECT query, key, CAST(rank AS INTEGER) AS rank, round(score, 6) AS score FROM r WHERE rank <= 10
""")
def q_cosine_topk_many(spark, d):
    """the ten nearest of every twentieth vector among all, by cells."""
    emb = table(spark, d, "embeddings")
    return round_doubles(se.cosine_topk_many(emb, emb.filter("vec_id % 20 = 0"), "vec_id", "embedding", 10).rows)


@query("softmax", """
WITH x AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS v FROM embeddings),
e AS (SELECT vec_id, list_transform(v, lambda a: exp(a - list_max(v))) AS ex FROM x),
p AS (SELECT vec_id, list_transform(ex, lambda a: a / list_sum(ex)) AS p FROM e)
SELECT vec_id, CAST(generate_subscripts(p, 1) - 1 AS BIGINT) AS dim, round(unnest(p), 6) AS value FROM p
""")
def q_softmax(spark, d):
    emb = table(spark, d, "embeddings")
    p = vx.softmax(vx.to_double_array(F.col("embedding")))
    return round_doubles(emb.select("vec_id", F.posexplode(p).alias("dim", "value")).withColumn("dim", F.col("dim").cast("bigint")))


@query("sigmoid", """
WITH x AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS dim, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
SELECT vec_id, CAST(dim AS BIGINT) AS dim,
       round(CASE WHEN v >= 0 THEN 1 / (1 + exp(-v)) ELSE exp(v) / (1 + exp(v)) END, 6) AS value FROM x
""")
def q_sigmoid(spark, d):
    emb = table(spark, d, "embeddings")
    ex = emb.select("vec_id", F.posexplode("embedding").alias("dim", "v"))
    return round_doubles(ex.select("vec_id", F.col("dim").cast("bigint").alias("dim"),
                                   vx.sigmoid(F.col("v").cast("double")).alias("value")))


# --- token ids ------------------------------------------------------------------------------
VOCAB_SQL = f"""
tc AS (SELECT token, count(*) AS c FROM (SELECT unnest({TERMS}) AS token FROM documents) GROUP BY token HAVING count(*) >= 2),
vocab AS (SELECT token, CAST(row_number() OVER (ORDER BY c DESC, token) + 3 AS INTEGER) AS id, CAST(c AS BIGINT) AS count
          FROM tc ORDER BY c DESC, token LIMIT 29996)
"""


def vocab(spark, d):
    return fe.build_vocab(docs(spark, d), "text", min_frequency=2)


@query("build_vocab", f"WITH {VOCAB_SQL} SELECT token, id, count FROM vocab")
def q_build_vocab(spark, d):
    return vocab(spark, d)


ENC_SQL = f"""
m AS (SELECT map(list(token), list(id)) AS mp FROM vocab),
enc AS (SELECT doc_id, list_concat([2], list_transform(list_slice({TERMS}, 1, 510),
                                   lambda t: coalesce(m.mp[t], 1)), [3]) AS ids FROM documents, m)
"""


@query("encode_ids", f"""
WITH {VOCAB_SQL}, {ENC_SQL}
SELECT doc_id, array_to_string(list_concat(ids, list_transform(range(0, 512 - len(ids)), lambda x: 0)), ' ') AS ids,
       CAST(len(ids) AS BIGINT) AS n_attended FROM enc
""")
def q_encode_ids(spark, d):
    e = fe.encode_ids(docs(spark, d), "doc_id", "text", vocab(spark, d), 512)
    return e.select("doc_id", F.array_join("input_ids", " ").alias("ids"),
                    F.aggregate("attention_mask", F.lit(0).cast("bigint"), lambda a, x: a + x).alias("n_attended"))


@query("decode_ids", f"""
WITH {VOCAB_SQL}, {ENC_SQL},
r AS (SELECT map(list(id), list(token)) AS rm FROM vocab)
SELECT doc_id, array_to_string(list_transform(list_filter(ids, lambda i: i >= 4), lambda i: r.rm[i]), ' ') AS text
FROM enc, r
""")
def q_decode_ids(spark, d):
    v = vocab(spark, d)
    return fe.decode_ids(fe.encode_ids(docs(spark, d), "doc_id", "text", v, 512), "doc_id", v)


HELD = "substr(md5(CAST(doc_id AS VARCHAR)), 1, 1) IN ('0', '1', '2')"
LANGUAGE_SQL = rf"""
w AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '\p{{L}}+')) AS w FROM documents),
g AS (SELECT doc_id, lang, substr(' ' || w || ' ', unnest(range(1, length(w) + 1)), 3) AS g FROM w),
tc AS (SELECT lang, g, count(*) AS n FROM g WHERE NOT {HELD} AND lang IS NOT NULL GROUP BY ALL),
top AS (SELECT g FROM tc GROUP BY g ORDER BY sum(n) DESC, g LIMIT {la.TRIGRAMS}),
tt AS (SELECT lang, sum(n)::DOUBLE AS t FROM tc SEMI JOIN top USING (g) GROUP BY lang),
pr AS (SELECT lang, count(*) AS c FROM documents WHERE NOT {HELD} AND lang IS NOT NULL AND text IS NOT NULL GROUP BY lang),
m AS (SELECT lang, ln(c::DOUBLE / sum(c) OVER ()) AS prior, ln(coalesce(t, 0) + {la.SMOOTHING} * ((SELECT count(*) FROM top) + 1)) AS total
      FROM pr LEFT JOIN tt USING (lang)),
dc AS (SELECT doc_id, g, count(*) AS c FROM g GROUP BY ALL),
sc AS (SELECT dc.doc_id, m.lang, m.prior + sum(dc.c * (ln(coalesce(tc.n, 0) + {la.SMOOTHING}) - m.total)) AS score
       FROM dc CROSS JOIN m LEFT JOIN (SELECT * FROM tc SEMI JOIN top USING (g)) tc ON tc.g = dc.g AND tc.lang = m.lang GROUP BY dc.doc_id, m.lang, m.prior),
be AS (SELECT doc_id, lang AS detected FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, lang) AS rk FROM sc) WHERE rk = 1)
"""


@query("detect_language", f"WITH {LANGUAGE_SQL} SELECT d.doc_id, be.detected FROM documents d LEFT JOIN be USING (doc_id)")
def q_detect_language(spark, d):
    """A model trained on thirteen sixteenths of the documents (by hash), applied to all."""
    rows = docs(spark, d)
    return la.detect(rows, "doc_id", "text", la.train(rows.filter(~la.held_out(F.col("doc_id"))), "text", "lang"))


@query("language_accuracy", f"""
WITH {LANGUAGE_SQL}
SELECT d.lang, count(*) AS documents, count(*) FILTER (be.detected = d.lang) AS right
FROM documents d LEFT JOIN be USING (doc_id) WHERE {HELD.replace('doc_id', 'd.doc_id')} GROUP BY d.lang
""")
def q_language_accuracy(spark, d):
    """How many of the documents left out of training are told right."""
    rows = docs(spark, d)
    held = la.held_out(F.col("doc_id"))
    found = la.detect(rows.filter(held), "doc_id", "text", la.train(rows.filter(~held), "text", "lang"))
    return rows.select("doc_id", "lang").join(found, "doc_id").groupBy("lang").agg(
        F.count("*").alias("documents"), F.count_if(F.col("detected") == F.col("lang")).alias("right"))


def _pos_sql() -> str:
    lexm = "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in sorted(fe.POS_LEXICON.items())) + "}"
    rule = ("CASE WHEN regexp_matches(token, '^\\p{N}+$') THEN 'NUM' WHEN regexp_matches(token, '^[^\\p{L}\\p{N}]+$') THEN 'PUNCT' "
            "WHEN lower(token) LIKE '%ing' OR lower(token) LIKE '%ed' THEN 'VERB' WHEN lower(token) LIKE '%ly' THEN 'ADV' "
            "WHEN regexp_matches(token, '^\\p{Lu}') THEN 'PROPN' ELSE 'NOUN' END")
    return f"coalesce({lexm}[lower(token)], {rule})"


@query("pos_lookup", f"""
WITH t AS (SELECT doc_id, regexp_extract_all(text, {lit(tx.WORD_TOKEN)}) AS toks FROM documents),
u AS (SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos, unnest(toks) AS token FROM t)
SELECT doc_id, pos, token, {_pos_sql()} AS tag FROM u
""")
def q_pos_lookup(spark, d):
    tags = fe.pos_tags(tx.word_tokens(F.col("text")))
    return (tx.unnest(docs(spark, d), tags, "t", "doc_id", pos="pos")
            .select("doc_id", F.col("pos").cast("bigint").alias("pos"), "t.token", F.col("t.pos").alias("tag")))
