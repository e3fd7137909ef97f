"""Sentence boundaries that know abbreviations (T3), learned from the corpus.

After Kiss and Strunk, "Unsupervised multilingual sentence boundary detection"
(2006): a word and the period after it are a collocation when the word is an
abbreviation.  For every word type the likelihood of its periods under the
overall rate is set against that under a rate of 0.99; the ratio is weighted
down for long words and for each time the word stands without a period, and up
for periods inside it.  Counts are one grouped aggregation; the split itself
stays on the row.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions.text import SENTENCE_BREAK, let, unnest

# A word may hold periods between letters ("e.g", "U.S"); a period after it is its own group.
WORD = r"(?<![\p{L}\p{N}])\p{L}+(?:\.\p{L}+)*+\.?"
# Fixed values of the published method: the abbreviation's period rate and the score to reach.
ABBREVIATION_RATE, THRESHOLD = 0.99, 0.3
BREAK_MARK = "￿"


def word_periods(docs: DataFrame, text: str) -> DataFrame:
    """(word, n, n_period): occurrences of every lower-cased word type, and those with a period after them."""
    hits = F.transform(F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), 0), F.lower)
    t = unnest(docs, hits, "hit")
    return t.groupBy(F.rtrim("hit", F.lit(".")).alias("word")).agg(
        F.count("*").alias("n"), F.count_if(F.col("hit").endswith(".")).alias("n_period"))


def abbreviation_scores(docs: DataFrame, text: str) -> DataFrame:
    """(word, n, n_period, score) of the words that ever stand before a period."""
    from quill.session import staged
    c = staged(word_periods(docs, text), "word-periods")
    rate = c.select((F.sum("n_period") / F.sum("n"))).scalar()
    n, k = F.col("n").cast("double"), F.col("n_period").cast("double")
    p = F.least(F.greatest(rate, F.lit(1e-9)), F.lit(1 - 1e-9))
    null = k * F.ln(p) + (n - k) * F.ln(1 - p)
    alternative = k * F.ln(F.lit(ABBREVIATION_RATE)) + (n - k) * F.ln(F.lit(1 - ABBREVIATION_RATE))
    letters = F.length(F.replace("word", F.lit("."))).cast("double")
    periods = F.length("word") - letters + 1
    score = -2 * (null - alternative) * F.exp(-letters) * periods * F.pow(letters, -(n - k))
    return c.filter("n_period > 0").select("word", "n", "n_period", score.alias("score"))


def learn_abbreviations(docs: DataFrame, text: str, threshold: float = THRESHOLD, min_count: int = 1) -> DataFrame:
    """(word, n, n_period, score) of the learned abbreviations; ``min_count`` periods at least."""
    return abbreviation_scores(docs, text).filter((F.col("score") >= threshold) & (F.col("n_period") >= min_count))


def split_sentences(text: Column, abbreviations: Iterable[str]) -> Column:
    """Sentences of a text: breaks after ``.``, ``!`` or ``?`` and white space, but not after an abbreviation's period."""
    words = sorted({w.lower().rstrip(".") for w in abbreviations})
    t = F.translate(F.coalesce(text, F.lit("")), BREAK_MARK, "￾")
    if not words:
        return F.split(t, SENTENCE_BREAK)
    # piece, white space, piece, ...: the white space stands between two marks
    parts = F.split(F.regexp_replace(t, rf"(?<=[.!?])(\s+)", f"{BREAK_MARK}$1{BREAK_MARK}"), BREAK_MARK, -1)

    def joined(p):
        last = lambda i: F.rtrim(F.lower(F.regexp_extract(F.get(p, i - 1), rf"({WORD})$", 1)), F.lit("."))
        ends = lambda i: F.get(p, i - 1).endswith(".") & last(i).isin(*words)
        whole = F.transform(p, lambda x, i: F.when(i % 2 == 0, x).when(ends(i), x).otherwise(F.lit(BREAK_MARK)))
        return F.split(F.array_join(whole, ""), BREAK_MARK, -1)
    return let(parts, joined)
