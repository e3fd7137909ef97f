"""A1 batch analysis: documents -> clean -> sentiment + entities -> results.

One lazy plan: the text is cleaned once, and sentiment and entities come from
the cleaned text, all as columns of the row; nothing shuffles unless a scorer
brings its own join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions import text as tx
from quill.functions import vectors as vx
from quill.functions.text import let
from quill.operators import bayes
from quill.operators import sentiment as se

Scorer = Callable[[DataFrame], DataFrame]          # adds a ``probs`` column
Extractor = Callable[[Column], Column]             # text -> entities array


def lexicon_scorer(positive, negative, neutral: float = 1.5, clean_col: str = "clean") -> Scorer:
    """Scorer over the words of the cleaned text."""
    # cleaned text has single blanks only
    return lambda df: df.withColumn("probs", se.lexicon_probs(F.split(F.col(clean_col), " "), positive, negative, neutral))


def trained_scorer(model, spark, clean_col: str = "clean") -> Scorer:
    """Scorer of a trained model (:mod:`quill.operators.bayes`) over the cleaned text."""
    scored = bayes.scorer(model, spark)
    return lambda df: df.withColumn("_scored", scored(F.col(clean_col))).withColumns(
        {"probs": F.col("_scored.probs"), clean_col: F.col("_scored.text")})


def analyze(docs: DataFrame, scorer: Scorer, extractor: Extractor, *, id_col: str = "doc_id",
            text_col: str = "text", entities_on: str = "clean", counter: Extractor | None = None) -> DataFrame:
    """Results with ``error`` (not a string, empty) instead of exceptions.

    Sentiment and entities are taken from the cleaned text;
    ``entities_on='raw'`` gives the extractor the text as it came, for rules
    that rely on case and punctuation.  With ``counter`` the number of entities
    is a column of its own, and a query that reads only that builds no spans.
    """
    base = docs.select(
        F.col(id_col).cast("string").alias("document_id"), F.col(id_col), F.col(text_col).alias("text"),
        tx.clean_text(F.col(text_col)).alias("clean"), tx.invalid_reason(F.col(text_col)).alias("error"))
    scored = scorer(base)
    source = F.col("clean") if entities_on == "clean" else F.col("text")
    sentiment = F.when(F.col("probs").isNotNull(), let(vx.collapse_to_three(F.col("probs")), vx.label_from_probs))
    counted = [counter(source).alias("n_entities")] if counter else []
    return scored.select("document_id", id_col, "text", "clean", sentiment.alias("sentiment"),
                         extractor(source).alias("entities"), *counted, "error")
