"""Exact-value tests of the cleaning and token expressions (stdlib expectations)."""

import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from quill.functions import text as tx


def run(spark, texts, fn):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    return [r[0] for r in df.select(fn(F.col("t"))).collect()]


def py_clean(t):
    if not isinstance(t, str):
        return ""
    t = unicodedata.normalize("NFKD", t)
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = re.sub(tx.URL_PATTERN, " ", t)
    t = re.sub(r"\S+@\S+", " ", t)
    t = t.lower()
    t = re.sub(r"[^a-zA-Z0-9\s]", " ", t)
    return re.sub(r"\s+", " ", t).strip()


SAMPLES = [
    "", "   ", "\n\t ", "Too    much     whitespace   here",
    "Visit https://example.com/a?b=c#frag now!", "Mail me: john.doe@example.com.",
    "Café naïve façade — Straße", "ﬁne ½ ™ 한국어 text", "I can't won't they're we've",
    "Emoji 😀 and 𝐀𝐁 bold", "Tabs\tand\r\nnewlines\x0bvt\x1cfs", "Price $1,234.56 on 2024-01-01",
]


def test_clean_matches_python(spark):
    got = run(spark, SAMPLES, tx.clean_text)
    assert got == [py_clean(t) for t in SAMPLES]


def test_clean_null_is_empty(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert df.select(tx.clean_text(F.col("t"))).first()[0] == ""


def test_exact_reference_expectations(spark):
    assert run(spark, ["", "   ", "\n\t "], tx.clean_text) == ["", "", ""]
    assert run(spark, ["Too    much     whitespace   here"], tx.clean_text) == ["too much whitespace here"]
    assert run(spark, ["this is a test document"],
               lambda c: tx.remove_stopwords(c, {"this", "is", "a"})) == ["test document"]
    assert run(spark, ["this is a test"], lambda c: tx.remove_stopwords(c, {"this", "is"})) == ["a test"]


def test_fold_unicode_matches_unicodedata(spark):
    texts = SAMPLES + ["ǅungla ĳssel ŉ", "Ａｂｃ１２３", "x́y"]
    exp = ["".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c)) for t in texts]
    assert run(spark, texts, tx.fold_unicode) == exp


def test_contractions(spark):
    got = run(spark, ["I won't go, can't stop; don't we're I've you'll he'd I'm"], tx.expand_contractions)
    assert got == ["I will not go, cannot stop; do not we are I have you will he would I am"]


def test_punctuation_and_numbers(spark):
    assert run(spark, ["a,b.c! d?"], tx.remove_punctuation) == ["abc d"]
    assert run(spark, ["a1b22c"], tx.remove_numbers) == ["a b c"]


def test_word_count_matches_split(spark):
    texts = ["a b  c", "", "  lead and trail  ", "x\ny\tz"]
    assert run(spark, texts, tx.word_count) == [len(t.split()) for t in texts]


def test_tokens_and_filters(spark):
    toks = run(spark, ["It's a test, ok!"], tx.word_tokens)[0]
    assert toks == ["It's", "a", "test", ",", "ok", "!"]
    got = run(spark, ["I am a big cat"], lambda c: tx.filter_tokens(tx.word_tokens(c), min_length=3))[0]
    assert got == ["big", "cat"]
    got = run(spark, ["short verylongword medium"], lambda c: tx.filter_tokens(tx.word_tokens(c), max_length=5))[0]
    assert got == ["short"]


def test_sentences_and_ngrams(spark):
    assert run(spark, ["One. Two! Three? Four"], tx.sentences)[0] == ["One.", "Two!", "Three?", "Four"]
    got = run(spark, ["a b c d"], lambda c: tx.ngrams(tx.words(c), 3))[0]
    assert got == ["a b c", "b c d"]
    assert run(spark, ["a"], lambda c: tx.ngrams(tx.words(c), 2))[0] == []


@pytest.mark.parametrize("lang", ["english", "french", "german", "spanish"])
def test_default_stopwords(lang):
    assert len(tx.default_stopwords(lang)) > 50


def test_prefix_sum_matches_cumsum(spark):
    import itertools
    import random
    rng = random.Random(3)
    arrays = [[rng.randint(0, 50) for _ in range(n)] for n in (0, 1, 2, 5, 33, 100, 1000)]
    df = spark.createDataFrame([(a,) for a in arrays], "a array<int>")
    got = [r[0] for r in df.select(tx.prefix_sum(F.col("a"))).collect()]
    assert got == [list(itertools.accumulate(a)) for a in arrays]
