"""Sentiment scoring and distributions (M1-M7).

A scorer is a function ``DataFrame -> DataFrame`` that adds a ``probs``
array<double> column; :func:`attach_sentiment` turns it into the canonical
``sentiment`` struct.  Built-in scorers: a linear head over stored vectors,
and a broadcast lexicon.  A user model plugs in through
:func:`score_with_model` (Arrow batches, model loaded once per worker).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.functions import vectors as vx
from quill.functions.text import let


def probs_from_vector(vec: Column, classes: int = 3, scale: float = 5.0) -> Column:
    """Vector head: the logit of class c is ``scale`` times the sum of the components c, c + classes, ..."""
    def logit(c: int) -> Column:
        own = F.filter(vec, lambda x, i: i % classes == c)
        return F.aggregate(own, F.lit(0.0), lambda a, x: a + x.cast("double")) * F.lit(scale)
    return vx.softmax(F.array(*[logit(c) for c in range(classes)]))


def lexicon_probs(words: Column, positive: Sequence[str], negative: Sequence[str], neutral: float = 1.5) -> Column:
    """M1 (a), row-local: class probabilities (negative, neutral, positive) from lexicon hits among ``words``.

    Masses are hits + 1 for either side and ``neutral`` * (smaller number of
    hits + 1) between them; every text gets a distribution.
    """
    hits = lambda w, lexicon: F.size(F.filter(w, lambda x: x.isin(*lexicon)))

    def with_hits(h):
        neg, pos = F.get(h, 0) + 1.0, F.get(h, 1) + 1.0
        mass = F.array(neg, F.least(neg, pos) * F.lit(neutral), pos)
        return let(mass, lambda m: F.transform(m, lambda x: x / (F.get(m, 0) + F.get(m, 1) + F.get(m, 2))))
    w = F.coalesce(words, F.array().cast("array<string>"))
    return let(w, lambda x: let(F.array(hits(x, negative), hits(x, positive)), with_hits))


def attach_sentiment(df: DataFrame, probs_col: str = "probs", out: str = "sentiment") -> DataFrame:
    """M2 + M3: collapse any 2/3/5-class output and label it."""
    return df.withColumn(out, let(vx.collapse_to_three(F.col(probs_col)), vx.label_from_probs))


def score_lexicon(df: DataFrame, tokens_col: str, lexicon: DataFrame, key="doc_id") -> DataFrame:
    """M1 (a): sum of lexicon weights over a document's tokens.

    One left join with the lexicon (word, weight), which Spark broadcasts when
    it is small enough, and one grouping, combined map-side.
    Result: key, lex_score, n_hits, label (sign of the score).
    """
    keys = [key] if isinstance(key, str) else list(key)
    toks = df.select(*keys, F.explode_outer(tokens_col).alias("word"))
    agg = toks.join(lexicon, "word", "left").groupBy(*keys).agg(
        F.sum("weight").alias("lex_score"), F.count("weight").alias("n_hits"))
    s = F.coalesce(F.col("lex_score"), F.lit(0.0))
    return agg.select(
        *keys, s.alias("lex_score"), F.col("n_hits").cast("bigint").alias("n_hits"),
        F.when(s > 0, "positive").when(s < 0, "negative").otherwise("neutral").alias("label"))


def score_with_model(df: DataFrame, text_col: str, model_factory: Callable[[], Callable],
                     n_classes: int = 3, out: str = "probs") -> DataFrame:
    """M1 (c): user model over Arrow batches; ``model_factory`` runs once per worker.

    The model maps a list of texts to a list of probability rows.
    """
    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def _score(texts: pd.Series) -> pd.Series:
        model = cached_model(model_factory)
        return pd.Series([list(map(float, p)) for p in model(texts.fillna("").tolist())])

    return df.withColumn(out, _score(F.col(text_col)))


_MODELS: dict = {}


def cached_model(factory: Callable[[], Callable]):
    """One model per Python worker process and factory (workers are reused across tasks).

    The factory is unpickled per task, so it is keyed by its definition site,
    or by an explicit ``cache_key`` attribute when one site makes several models.
    """
    code = getattr(factory, "__code__", None)
    key = getattr(factory, "cache_key", None) or (
        getattr(factory, "__module__", ""), getattr(factory, "__qualname__", ""),
        code.co_filename if code else "", code.co_firstlineno if code else 0)
    if key not in _MODELS:
        _MODELS[key] = factory()
    return _MODELS[key]


def sentiment_distribution(df: DataFrame, sentiment_col: str = "sentiment") -> DataFrame:
    """M4: counts of all three classes (zeros kept), shares, mean and population std."""
    lab = F.col(f"{sentiment_col}.label")
    sc = F.col(f"{sentiment_col}.score")
    scored = df.filter(F.col(sentiment_col).isNotNull())
    n = F.count("*")
    aggs = [n.cast("bigint").alias("total_texts")]
    for lbl in vx.SENTIMENT_LABELS:
        aggs.append(F.count_if(lab == lbl).cast("bigint").alias(f"n_{lbl}"))
        aggs.append((F.count_if(lab == lbl) * 100.0 / n).alias(f"pct_{lbl}"))
    aggs += [F.avg(sc).alias("avg_confidence"), F.stddev_pop(sc).alias("std_confidence")]
    return scored.agg(*aggs)


def ab_arm(key: Column, split_pct: int = 50) -> Column:
    """M7: stable A/B arm from the first 32 bits of md5(key) (same in any engine)."""
    bucket = F.pmod(F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("bigint"), F.lit(100))
    return F.when(bucket < split_pct, "A").otherwise("B")


def ab_compare(df: DataFrame, key: str, versions: dict[str, str], truth: str, split_pct: int = 50) -> DataFrame:
    """M7: two model versions side by side, each on its arm, with the quality figures of each arm.

    ``versions`` maps a version name to its ``probs`` column: the first scores
    arm A, the second arm B.  ``truth`` is 0 or 1 where a document is labelled;
    a document counts as predicted 1 unless its label is negative.
    """
    (va, pa), (vb, pb) = versions.items()
    arm = ab_arm(F.col(key), split_pct)
    d = df.withColumn("arm", arm).withColumn("model_version", F.when(F.col("arm") == "A", va).otherwise(vb))
    d = attach_sentiment(d.withColumn("_probs", F.when(F.col("arm") == "A", F.col(pa)).otherwise(F.col(pb))), "_probs", "_s")
    y, p = F.col(truth) == 1, F.col("_s.label") != "negative"
    known = F.col(truth).isNotNull()
    count = lambda c: F.count_if(c).cast("bigint")
    out = d.groupBy("arm", "model_version").agg(
        F.count("*").cast("bigint").alias("n_docs"),
        *[count(F.col("_s.label") == x).alias(f"n_{x}") for x in vx.SENTIMENT_LABELS],
        F.avg("_s.score").alias("avg_confidence"), count(known).alias("n_labelled"),
        count(known & (y == p)).alias("right"), count(known & y & p).alias("tp"),
        count(known & (y != p)).alias("wrong"))
    return out.withColumn("accuracy", F.try_divide("right", "n_labelled")).withColumn(
        "f1", F.coalesce(F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("wrong")), F.lit(0.0))).drop("right", "tp", "wrong")
