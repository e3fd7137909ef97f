"""M1: a sentiment scorer trained from labelled texts (multinomial naive Bayes over words).

Training counts the words of each class, combined in each task and then by
Spark; the ``most`` words by total count are the model, the same size whatever
the corpus.  Scoring is row-local, in Arrow batches cut by letters: the words of
a cut are looked up at once and their log weights added up by text.  The sum is
divided by the root of the number of words, as neighbouring words are not
independent, and becomes probabilities with the class shares.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.functions.batches import short_batches, short_lists

WORDS, SMOOTHING = 20_000, 1.0
# Distinct words a task counts before it hands them on.
FLUSH = 1 << 18


class Model(NamedTuple):
    """Words, log weights (word, class), the weights of a word that is not known, log class shares."""

    words: dict[str, int]
    weights: np.ndarray
    unknown: np.ndarray
    prior: np.ndarray

    def probabilities(self, texts: list[str | None]) -> np.ndarray:
        """A row of class probabilities a text."""
        split = [(t or "").split() for t in texts]
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        get = self.words.get
        at = np.fromiter((get(w, -1) for w in chain.from_iterable(split)), np.int64, int(sizes.sum()))
        of = np.repeat(np.arange(len(texts)), sizes)
        table = np.vstack([self.weights, self.unknown])  # -1 is its last row
        score = np.stack([np.bincount(of, table[at, k], len(texts)) for k in range(len(self.prior))], 1)
        score = self.prior + score / np.sqrt(np.maximum(sizes, 1))[:, None]
        e = np.exp(score - score.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def by_cuts(self, texts: list[str | None]) -> list[np.ndarray]:
        """The rows of :meth:`probabilities`; the words of a whole batch would take many times the memory of its texts."""
        return [p for part in short_lists(texts) for p in self.probabilities(part)]


def class_word_counts(rows: DataFrame) -> DataFrame:
    """(label, word, n) of the words between blanks in (label, text)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, Counter] = {}

        def flat() -> pa.RecordBatch:
            rows = [(y, w, n) for y, c in counts.items() for w, n in c.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(
                zip(*rows, strict=True), (pa.int32(), pa.string(), pa.int64()), strict=True)], names=["label", "word", "n"])

        for b in short_batches(batches, 1):
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts.setdefault(y, Counter()).update((text or "").split())
            if sum(map(len, counts.values())) > FLUSH:
                yield flat()
        if any(counts.values()):
            yield flat()

    found = rows.select(F.col("label").cast("int"), "text").mapInArrow(run, "label int, word string, n long")
    return found.groupBy("label", "word").agg(F.sum("n").alias("n"))


def train(rows: DataFrame, classes: int = 3, most: int = WORDS, smoothing: float = SMOOTHING) -> Model:
    """The model of (label from 0 to ``classes`` - 1, text); rows without a label teach nothing."""
    from quill.session import staged
    rows = rows.filter(F.col("label").between(0, classes - 1))
    counts = staged(class_word_counts(rows), "class-words")
    by_word = counts.groupBy("word").agg(F.sum("n").alias("all"), *[
        F.coalesce(F.sum(F.when(F.col("label") == k, F.col("n"))), F.lit(0)).alias(f"n{k}") for k in range(classes)])
    top = by_word.orderBy(F.desc("all"), F.asc("word")).limit(most).collect()
    share = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    n = np.array([[r[f"n{k}"] for k in range(classes)] for r in top], float).reshape(-1, classes)
    total = np.log(n.sum(axis=0) + smoothing * (len(top) + 1))
    docs = np.array([share.get(k, 0) for k in range(classes)], float)
    prior = np.log((docs + smoothing) / (docs.sum() + smoothing * classes))
    return Model({r["word"]: i for i, r in enumerate(top)}, np.log(n + smoothing) - total, np.log(smoothing) - total, prior)


SCORED = T.StructType([T.StructField("probs", T.ArrayType(T.DoubleType())), T.StructField("text", T.StringType())])


def scorer(model: Model, spark: SparkSession):
    """Column of texts -> column of (class probabilities, the text).

    The text comes back so that what follows reads it from there, and an
    expensive text (a cleaned one) is computed for the scorer alone.
    """
    sent = spark.sparkContext.broadcast(model)

    @F.pandas_udf(SCORED)
    def scored(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"probs": sent.value.by_cuts(texts.tolist()), "text": texts})

    return lambda text: scored(text)


def labelled(docs: DataFrame, labels: DataFrame, text: Column, key: str = "doc_id") -> DataFrame:
    """(label, text): toxic texts are negative (0), other texts of low quality neutral (1), the rest positive (2)."""
    y = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return docs.join(labels.select(key, "quality", "toxic"), key).select(y.alias("label"), text.alias("text"))
