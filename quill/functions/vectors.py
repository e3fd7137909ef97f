"""Array math as higher-order Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The three sentiment classes in index order.
SENTIMENT_LABELS = ["negative", "neutral", "positive"]


def to_double_array(a: Column) -> Column:
    return F.transform(a, lambda x: x.cast("double"))


def array_sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def softmax(a: Column) -> Column:
    """max-shifted softmax of an array<double> (max, exponentials and their sum bound once)."""
    from quill.functions.text import let

    def with_max(arr):
        return let(F.array_max(arr), lambda m: let(F.transform(arr, lambda x: F.exp(x - m)), lambda ex: let(
            array_sum(ex), lambda tot: F.transform(ex, lambda e: e / tot))))
    return let(a, with_max)


def sigmoid(x: Column) -> Column:
    """numerically stable logistic function."""
    return F.when(x >= 0, 1.0 / (1.0 + F.exp(-x))).otherwise(F.exp(x) / (1.0 + F.exp(x)))


def dot(a: Column, b: Column) -> Column:
    return array_sum(F.zip_with(a, b, lambda x, y: x * y))


def norm2(a: Column) -> Column:
    return F.sqrt(array_sum(F.transform(a, lambda x: x * x)))


def cosine(a: Column, b: Column) -> Column:
    """cosine similarity; NULL when either vector is all zeros."""
    from quill.functions.text import let
    return let(a, lambda x: let(norm2(x) * norm2(b), lambda den: F.when(den > 0, dot(x, b) / den)))


def argmax(a: Column) -> Column:
    """0-based index of the first maximum (ties resolve to the first)."""
    return F.array_position(a, F.array_max(a)) - 1


def collapse_to_three(probs: Column) -> Column:
    """M2: 5 stars -> (1+2, 3, 4+5); 2 classes -> (p0, 0, p1); 3 classes as is."""
    p = lambda i: F.get(probs, i)
    return (F.when(F.size(probs) == 5, F.array(p(0) + p(1), p(2), p(3) + p(4)))
            .when(F.size(probs) == 2, F.array(p(0), F.lit(0.0).cast("double"), p(1)))
            .otherwise(probs))


def label_from_probs(probs3: Column) -> Column:
    """M3: struct(label, score, scores) from negative/neutral/positive probabilities."""
    labels = F.array(*[F.lit(x) for x in SENTIMENT_LABELS])
    return F.struct(
        F.get(labels, argmax(probs3)).alias("label"),
        F.array_max(probs3).alias("score"),
        F.map_from_arrays(labels, probs3).alias("scores"))
