"""Randomised texts (seeded): the Spark cleaner and tokenizer against the stdlib rules."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from quill.functions import text as tx

ALPHABET = (
    list("abcXYZ019 .,;:!?'\"-_@/#%&()[]{}<>") + ["\t", "\n", "\r", "\x0b", "\x0c", "\x1c", "\x1f", "\x85", "\xa0",
                                                " ", " ", "　", "​"]
    + list("éèçñüßøåÆŒĳﬁ½²³ÀÉÎÕÛ") + ["é", "ä", "́"]
    + list("한국어漢字かなｱｲｳＡＢＣ１２３") + ["\U0001d400", "\U0001f600", "Ω", "Å", "①"]
    + ["http://x.org/a?b=1", "https://ex.com/p#f", "john.doe@mail.com", "a@b", "@x", "x@"]
)


def py_clean(t):
    t = unicodedata.normalize("NFKD", t)
    t = "".join(c for c in t if not unicodedata.combining(c))
    t = re.sub(tx.URL_PATTERN, " ", t)
    t = re.sub(r"\S+@\S+", " ", t)
    t = t.lower()
    t = re.sub(r"[^a-zA-Z0-9\s]", " ", t)
    return re.sub(r"\s+", " ", t).strip()


def samples(n=400, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, 40))) for _ in range(n)]


def test_clean_random(spark):
    texts = samples()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", tx.clean_text(F.col("t")).alias("c")).collect()}
    bad = [(texts[i], got[i], py_clean(texts[i])) for i in range(len(texts)) if got[i] != py_clean(texts[i])]
    assert not bad, bad[:3]


def test_fold_and_word_count_random(spark):
    texts = samples(seed=11)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = {r.i: r for r in df.select("i", tx.fold_unicode(F.col("t")).alias("f"), tx.word_count(F.col("t")).alias("w")).collect()}
    for i, t in enumerate(texts):
        assert rows[i].f == "".join(c for c in unicodedata.normalize("NFKD", t) if not unicodedata.combining(c))
        assert rows[i].w == len(t.split())
