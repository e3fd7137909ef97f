"""Fixture relations derived from the driver tables (Spark side).

``results`` is the canonical analysed-document relation every aggregation,
report and export reads.  Its sentiment comes from lexicon hits among the
words of the text, its classification from ``labels``, its entities from a
capitalised-word rule over the whole text.  The DuckDB mirror lives in :mod:`quill.plans.sqlfix`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quill.functions.text import invalid_reason, let
from quill.functions.vectors import argmax, label_from_probs
from quill.operators import entities as en
from quill.operators import sentiment as se
from quill.sources.tables import events as events_table
from quill.sources.tables import table

# Fixed fixture parameters.
CAPWORD = r"[A-Z][a-z]+"
FX_LABELS = ["PERSON", "ORG", "GPE"]
# Sentiment lexicon: frequent words of the test texts' four languages.
POSITIVE = ["the", "of", "in", "la", "der", "los", "les"]
NEGATIVE = ["and", "to", "is", "de", "die", "que", "un"]
NEUTRAL = 1.5
FX_EPOCH = "2024-01-01 00:00:00"


def fixture_entities(text: Column) -> Column:
    """Capitalised words; label by length mod 3, score by a fixed rule."""
    labels = F.array(*[F.lit(x) for x in FX_LABELS])

    def one(s, i):
        n = F.length(s["text"])
        lab = F.get(labels, F.pmod(n, F.lit(3)))
        return F.struct(s["text"].alias("text"), lab.alias("label"), en.entity_type(lab).alias("type"),
                        s["start"].alias("start"), s["end"].alias("end"),
                        ((F.pmod(n * 7 + i * 3, F.lit(10)) + 1) / 10.0).alias("score"))
    return F.transform(en.match_spans(text, CAPWORD), one)


def fixture_probs(text: Column, neutral: float = NEUTRAL) -> Column:
    """Class probabilities from the lexicon hits among a text's words (runs of ASCII letters, lower-cased)."""
    return se.lexicon_probs(F.split(F.lower(text), "[^a-z]+"), POSITIVE, NEGATIVE, neutral)


def sentiment_scores(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, probs, sentiment) of every document."""
    docs = table(spark, d, "documents")
    return se.attach_sentiment(docs.select("doc_id", fixture_probs(F.col("text")).alias("probs")))


def processed_at(doc_id: Column) -> Column:
    return (F.lit(FX_EPOCH).cast("timestamp_ntz")
            + F.make_dt_interval(F.pmod(doc_id, F.lit(30)).cast("int"), F.pmod(doc_id, F.lit(24)).cast("int")))


def results(spark: SparkSession, d: str) -> DataFrame:
    """The canonical results relation.

    Row-local columns (entities, times, error) are derived on the documents
    side before the joins, so a query that does not read ``text`` never
    carries it through the join's shuffle (Catalyst prunes it).
    """
    docs = table(spark, d, "documents").select(
        F.col("doc_id").cast("string").alias("document_id"), "doc_id", "text", "lang", "source",
        let(fixture_probs(F.col("text")), label_from_probs).alias("sentiment"),
        fixture_entities(F.col("text")).alias("entities"), processed_at(F.col("doc_id")).alias("processed_at"),
        (F.col("n_chars") / 10000.0).alias("processing_time"),
        invalid_reason(F.col("text")).alias("error"))
    lab = table(spark, d, "labels").select(
        "doc_id", F.struct(F.when(F.col("quality") == 1, "high").otherwise("low").alias("label"),
                           F.lit(1.0).alias("score")).alias("classification"))
    out = docs.join(lab, "doc_id", "left")
    return out.select("document_id", "doc_id", "text", "lang", "source", "sentiment", "classification", "entities",
                      "processed_at", "processing_time", "error")


def predictions(spark: SparkSession, d: str, classes: int = 2) -> DataFrame:
    """(row_id, y_true, y_pred, probs) for evaluation operators.

    ``classes`` = 2: y_true = quality; 3: y_true = quality + toxic.  The
    probabilities are the lexicon's; for two classes the first two are
    renormalised.
    """
    lab = table(spark, d, "labels")
    scored = table(spark, d, "documents").select("doc_id", fixture_probs(F.col("text")).alias("p3"))
    j = lab.join(scored, "doc_id")
    if classes == 2:
        p = F.transform(F.slice("p3", 1, 2), lambda x: x / (F.get(F.col("p3"), 0) + F.get(F.col("p3"), 1)))
        y = F.col("quality")
    else:
        p = F.col("p3")
        y = F.col("quality") + F.col("toxic")
    return j.select(F.col("doc_id").alias("row_id"), y.cast("int").alias("y_true"),
                    argmax(p).cast("int").alias("y_pred"), p.alias("probs"))


def metric_points(spark: SparkSession, d: str) -> DataFrame:
    """events as metric points: name = event_type, labels = {k: props.k}."""
    ev = events_table(spark, d)
    k = F.get_json_object("props", "$.k")
    return ev.select("event_id", "ts", F.col("event_type").alias("name"), F.lit("histogram").alias("kind"),
                     F.create_map(F.lit("k"), k).alias("labels"), "value", "user_id")


def health_checks(spark: SparkSession, d: str) -> DataFrame:
    """events as health probes: critical = error/purchase checks, ok = value < 100."""
    ev = events_table(spark, d)
    return ev.select("event_id", "ts", F.col("event_type").alias("name"),
                     F.col("event_type").isin("error", "purchase").alias("critical"),
                     (F.col("value") < 100).alias("ok"))
