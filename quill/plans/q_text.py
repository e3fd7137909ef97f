"""Queries over whole documents: cleaning (C*) and tokens."""

from __future__ import annotations

from pyspark.sql import functions as F

from quill.functions import text as tx
from quill.operators import sentences as sn
from quill.plans.catalog import query
from quill.plans.sqlbits import d_clean, d_contractions, d_word_count, d_words, in_list, lit
from quill.sources.tables import table

# Parameters of the stop-word queries (words that occur in the test text).
STOP_SMALL = ("the", "and", "of", "le", "la", "de", "der", "die", "und", "el", "en", "is")


def docs(spark, d):
    return table(spark, d, "documents")


# --- step 0: documents by language -----------------------------------------
@query("docs_by_lang", f"""
SELECT lang, CAST(count(*) AS BIGINT) AS n_docs,
       round(avg(length(c)), 6) AS avg_clean_chars,
       round(avg({d_word_count('c')}), 6) AS avg_words
FROM (SELECT lang, {d_clean('text')} AS c FROM documents) t
GROUP BY lang
""")
def q_docs_by_lang(spark, d):
    c = tx.clean_text(F.col("text"))
    return (docs(spark, d).select("lang", c.alias("c"))
            .groupBy("lang")
            .agg(F.count("*").alias("n_docs"),
                 F.round(F.avg(F.length("c")), 6).alias("avg_clean_chars"),
                 F.round(F.avg(tx.word_count(F.col("c"))), 6).alias("avg_words")))


# --- C1..C13 ----------------------------------------------------------------
@query("clean_unicode", "SELECT doc_id, strip_accents(text) AS out FROM documents")
def q_clean_unicode(spark, d):
    return docs(spark, d).select("doc_id", tx.fold_unicode(F.col("text")).alias("out"))


@query("clean_urls", f"SELECT doc_id, regexp_replace(text, {lit(tx.URL_PATTERN)}, ' ', 'g') AS out FROM documents")
def q_clean_urls(spark, d):
    return docs(spark, d).select("doc_id", tx.remove_urls(F.col("text")).alias("out"))


@query("clean_emails", "SELECT doc_id, regexp_replace(text, '\\S+@\\S+', ' ', 'g') AS out FROM documents")
def q_clean_emails(spark, d):
    return docs(spark, d).select("doc_id", tx.remove_emails(F.col("text")).alias("out"))


@query("clean_lower", "SELECT doc_id, lower(text) AS out FROM documents")
def q_clean_lower(spark, d):
    return docs(spark, d).select("doc_id", F.lower("text").alias("out"))


@query("clean_numbers", "SELECT doc_id, regexp_replace(text, '\\d+', ' ', 'g') AS out FROM documents")
def q_clean_numbers(spark, d):
    return docs(spark, d).select("doc_id", tx.remove_numbers(F.col("text")).alias("out"))


@query("clean_punct", f"SELECT doc_id, translate(text, {lit(tx.PUNCTUATION)}, '') AS out FROM documents")
def q_clean_punct(spark, d):
    return docs(spark, d).select("doc_id", tx.remove_punctuation(F.col("text")).alias("out"))


@query("clean_special", "SELECT doc_id, regexp_replace(text, '[^a-zA-Z0-9\\s]', ' ', 'g') AS out FROM documents")
def q_clean_special(spark, d):
    return docs(spark, d).select("doc_id", tx.remove_special_chars(F.col("text")).alias("out"))


@query("clean_ws", "SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS out FROM documents")
def q_clean_ws(spark, d):
    return docs(spark, d).select("doc_id", tx.collapse_whitespace(F.col("text")).alias("out"))


@query("clean_stopwords", f"""
SELECT doc_id, array_to_string(list_filter({d_words('c')}, lambda w: w NOT IN {in_list(STOP_SMALL)}), ' ') AS out
FROM (SELECT doc_id, {d_clean('text')} AS c FROM documents) t
""")
def q_clean_stopwords(spark, d):
    return docs(spark, d).select("doc_id", tx.clean_text(F.col("text"), custom_stopwords=STOP_SMALL).alias("out"))


@query("remove_stopwords_ci", f"""
SELECT doc_id, array_to_string(list_filter({d_words('text')}, lambda w: lower(w) NOT IN {in_list(STOP_SMALL)}), ' ') AS out
FROM documents
""")
def q_remove_stopwords_ci(spark, d):
    return docs(spark, d).select(
        "doc_id", tx.remove_stopwords(F.col("text"), STOP_SMALL, case_insensitive=True).alias("out"))


@query("clean_full", f"SELECT doc_id, {d_clean('text')} AS out FROM documents")
def q_clean_full(spark, d):
    return docs(spark, d).select("doc_id", tx.clean_text(F.col("text")).alias("out"))


@query("clean_full_punct", f"SELECT doc_id, {d_clean('text', numbers=True, punctuation=True)} AS out FROM documents")
def q_clean_full_punct(spark, d):
    return docs(spark, d).select("doc_id", tx.clean_text(
        F.col("text"), remove_numbers_=True, remove_punctuation_=True).alias("out"))


@query("expand_contractions", f"SELECT doc_id, {d_contractions('text')} AS out FROM documents")
def q_expand_contractions(spark, d):
    return docs(spark, d).select("doc_id", tx.expand_contractions(F.col("text")).alias("out"))


@query("clean_multilingual", f"""
SELECT doc_id, {d_clean(f"CASE WHEN lang = 'en' THEN {d_contractions('text')} ELSE text END")} AS out
FROM documents
""")
def q_clean_multilingual(spark, d):
    return docs(spark, d).select("doc_id", tx.clean_multilingual(F.col("text"), F.col("lang")).alias("out"))


@query("validate_text", """
SELECT conv_id, turn,
       CASE WHEN text IS NULL THEN 'not_a_string'
            WHEN length(regexp_replace(text, '\\s+', '', 'g')) = 0 THEN 'empty' END AS reason,
       regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS stripped
FROM conversations
""")
def q_validate_text(spark, d):
    conv = table(spark, d, "conversations")
    return conv.select("conv_id", "turn", tx.invalid_reason(F.col("text")).alias("reason"),
                       tx.strip_text(F.col("text")).alias("stripped"))


@query("text_stats", f"""
SELECT doc_id, CAST(length(text) AS BIGINT) AS n_chars, {d_word_count('text')} AS n_words FROM documents
""")
def q_text_stats(spark, d):
    return docs(spark, d).select("doc_id", tx.char_length(F.col("text")).alias("n_chars"),
                                 tx.word_count(F.col("text")).alias("n_words"))


@query("filter_nonempty", """
SELECT conv_id, turn, role, text, CAST(length(text) AS BIGINT) AS text_length
FROM conversations WHERE text IS NOT NULL AND length(text) > 0
""")
def q_filter_nonempty(spark, d):
    from quill.streaming.stream import filter_nonempty
    return filter_nonempty(table(spark, d, "conversations")).drop("processed_timestamp")


@query("text_preview", "SELECT doc_id, substr(text, 1, 100) || '...' AS preview FROM documents")
def q_text_preview(spark, d):
    return docs(spark, d).select("doc_id", tx.preview(F.col("text")).alias("preview"))


# --- T1..T3 -----------------------------------------------------------------
@query("tokenize_words", f"""
SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos, unnest(toks) AS token
FROM (SELECT doc_id, regexp_extract_all(text, {lit(tx.WORD_TOKEN)}) AS toks FROM documents) t
""")
def q_tokenize_words(spark, d):
    return (tx.unnest(docs(spark, d), tx.word_tokens(F.col("text")), "token", "doc_id", pos="pos")
            .withColumn("pos", F.col("pos").cast("bigint")))


def _english_stop():
    return tx.default_stopwords("english")


@query("tokenize_filtered", f"""
WITH t AS (SELECT doc_id, list_filter(list_filter(list_transform(regexp_extract_all(text, {lit(tx.WORD_TOKEN)}), lambda x: lower(x)),
                   lambda x: x NOT IN {in_list(tx.default_stopwords("english"))}), lambda x: length(x) >= 3 AND length(x) <= 12) AS toks
           FROM documents)
SELECT doc_id, CAST(generate_subscripts(toks, 1) - 1 AS BIGINT) AS pos, unnest(toks) AS token FROM t
""")
def q_tokenize_filtered(spark, d):
    toks = tx.filter_tokens(tx.word_tokens(F.col("text")), stopwords=_english_stop(), min_length=3, max_length=12)
    return (docs(spark, d).select("doc_id", F.posexplode(toks).alias("pos", "token"))
            .withColumn("pos", F.col("pos").cast("bigint")))


# A period must follow a word this often before the word can be an abbreviation.
ABBREVIATION_PERIODS = 5
ABBREVIATION_SQL = rf"""
h AS (SELECT lower(unnest(regexp_extract_all(text, '(?:^|[^\p{{L}}\p{{N}}])(\p{{L}}+(?:\.\p{{L}}+)*\.?)', 1))) AS hit FROM documents),
c AS (SELECT rtrim(hit, '.') AS word, count(*) AS n, count(*) FILTER (ends_with(hit, '.')) AS k FROM h GROUP BY 1),
r AS (SELECT sum(k)::DOUBLE / sum(n) AS p FROM c),
z AS (SELECT word, n, k, length(replace(word, '.', '')) AS letters, length(word) - length(replace(word, '.', '')) + 1 AS inner_periods,
             k * ln(p) + (n - k) * ln(1 - p) - k * ln({sn.ABBREVIATION_RATE}::DOUBLE) - (n - k) * ln({1 - sn.ABBREVIATION_RATE}::DOUBLE) AS d
      FROM c, r WHERE k > 0),
ab AS (SELECT word, n, k AS n_period, -2 * d * exp(-letters::DOUBLE) * inner_periods * pow(letters::DOUBLE, -(n - k)) AS score FROM z)
"""


def abbreviations(spark, d):
    return sn.learn_abbreviations(docs(spark, d), "text", min_count=ABBREVIATION_PERIODS)


@query("learn_abbreviations", f"""
WITH {ABBREVIATION_SQL} SELECT word, n, n_period, round(score, 6) AS score FROM ab
WHERE score >= {sn.THRESHOLD} AND n_period >= {ABBREVIATION_PERIODS}
""")
def q_learn_abbreviations(spark, d):
    """The words whose periods do not end sentences, from counts over all documents."""
    return abbreviations(spark, d).withColumn("score", F.round("score", 6))


@query("split_sentences", rf"""
WITH {ABBREVIATION_SQL},
t AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])(\s+)', '\1' || chr(1) || '\2' || chr(1), 'g'), chr(1)) AS p FROM documents),
u AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS i FROM t),
l AS (SELECT *, lag(x) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM u),
w AS (SELECT doc_id, i, CASE WHEN i % 2 = 1 THEN x
        WHEN ends_with(before, '.') AND rtrim(lower(regexp_extract(before, '(?:^|[^\p{{L}}\p{{N}}])(\p{{L}}+(?:\.\p{{L}}+)*\.?)$', 1)), '.') IN
             (SELECT word FROM ab WHERE score >= {sn.THRESHOLD} AND n_period >= {ABBREVIATION_PERIODS}) THEN x
        ELSE chr(1) END AS x FROM l),
s AS (SELECT doc_id, string_split(string_agg(x, '' ORDER BY i), chr(1)) AS s FROM w GROUP BY doc_id)
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS sent_no, unnest(s) AS sentence FROM s
""")
def q_split_sentences(spark, d):
    """Sentences, with the abbreviations learned from the same documents; the list goes into the plan."""
    known = [r["word"] for r in abbreviations(spark, d).select("word").collect()]
    return (tx.unnest(docs(spark, d), sn.split_sentences(F.col("text"), known), "sentence", "doc_id", pos="sent_no")
            .withColumn("sent_no", F.col("sent_no").cast("bigint")))
