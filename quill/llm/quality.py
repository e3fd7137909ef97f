"""Quality rules: one table of thresholds compiled into one projection, built-in functions only.

No shuffle and no user function: every figure is an expression on the row, so
the work follows the text and a hot source or a long document changes nothing.

Defined cases: null or empty text has no words and fails the base rule; rows
are judged alone, so repeated rows get the same verdict; an empty table gives
an empty result.  Extra columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions.text import let
from quill.llm.common import BLANKS, words

SYMBOLS = "#*$%&|<>"
# Common function words of the four languages of the corpus.
STOP_WORDS = [
    "the", "of", "and", "to", "in", "a", "is", "that", "it", "was", "for", "on", "are", "as", "with", "at", "be",
    "this", "have", "from", "or", "by", "der", "die", "das", "und", "ist", "von", "zu", "mit", "den", "ein", "eine",
    "auf", "für", "nicht", "sich", "des", "dem", "le", "la", "les", "de", "et", "en", "un", "une", "du", "est", "que",
    "qui", "dans", "pour", "pas", "sur", "el", "los", "las", "y", "con", "por", "se", "su", "para", "al", "del", "no",
]
NO_LIMIT = (1 << 63) - 1
# (figure, lowest, highest): a document is kept when every figure lies in its closed range.
RULES = [
    ("n_words", 50, NO_LIMIT),
    ("mean_word_chars", 2.0, 15.0),
    ("symbols_per_word", 0.0, 0.1),
    ("stop_word_share", 0.02, 1.0),
    ("dup_line_share", 0.0, 0.5),
    ("ellipsis_line_share", 0.0, 0.3),
    ("bullet_line_share", 0.0, 0.9),
]


def n_repeat_words(w: Column) -> Column:
    """Words that lie in a 3-word window occurring at least twice (windows compared by 64-bit hash).

    Windows are sorted with their position; equal neighbours are repeats.  Only texts in which a
    window repeats at all are sorted.
    """
    def covered(s: Column) -> Column:
        n = F.size(s)
        hit = F.filter(s, lambda x, k: ((k > 0) & (F.get(s, k - 1)["h"] == x["h"]))
                       | ((k < n - 1) & (F.get(s, k + 1)["h"] == x["h"])))
        return F.size(F.array_distinct(F.flatten(
            F.transform(hit, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(h: Column) -> Column:
        pairs = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(
            let(F.sort_array(pairs), covered))

    grams = F.transform(F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                        lambda x, i: F.xxhash64(x, F.get(w, i + 1), F.get(w, i + 2)))
    return let(grams, count)


def figures(text: Column) -> Column:
    """Struct of all counts and ratios of one text."""
    t = F.coalesce(text, F.lit(""))

    def of(w: Column, lines: Column) -> Column:
        nw, nl = F.size(w), F.size(lines)
        chars = F.length(F.translate(t, BLANKS, ""))
        symbols = F.length(t) - F.length(F.translate(t, SYMBOLS, ""))
        dup = nl - F.size(F.array_distinct(lines))
        stop = F.size(F.filter(w, lambda x: F.lower(x).isin(STOP_WORDS)))
        dots = F.size(F.filter(lines, lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…")))
        bullets = F.size(F.filter(lines, lambda x: F.substring(F.ltrim(x), 1, 1).isin("-", "*", "•")))
        per = lambda a, b: F.when(b > 0, a / b).otherwise(F.lit(0.0))
        return F.struct(
            nw.cast("bigint").alias("n_words"), chars.cast("bigint").alias("word_chars"),
            symbols.cast("bigint").alias("n_symbols"), dup.cast("bigint").alias("n_dup_lines"),
            n_repeat_words(w).cast("bigint").alias("n_repeat_words"),
            per(chars, nw).alias("mean_word_chars"), per(symbols, nw).alias("symbols_per_word"),
            per(stop, nw).alias("stop_word_share"), per(dup, nl).alias("dup_line_share"),
            per(dots, nl).alias("ellipsis_line_share"), per(bullets, nl).alias("bullet_line_share"))

    lines = F.filter(F.split(t, "\n"), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    return let(words(t), lambda w: let(lines, lambda ls: of(w, ls)))


def verdict(f: Column, rules=RULES) -> Column:
    """The rule table as one boolean expression over a ``figures`` struct."""
    ok = F.lit(True)
    for name, low, high in rules:
        ok = ok & f[name].between(low, high)
    return ok


def base_failed(f: Column) -> Column:
    return (f["n_words"] < 50) | (100 * f["n_repeat_words"] > 50 * f["n_words"])


def judge(docs: DataFrame, text_col: str = "text", rules=RULES) -> DataFrame:
    """All columns of ``docs`` and the struct ``_q_judged``: figures, ``base_failed`` and ``kept``."""
    return docs.withColumn("_q_judged", let(figures(F.col(text_col)), lambda f: F.struct(
        f["n_words"].alias("n_words"), f["word_chars"].alias("word_chars"), f["n_symbols"].alias("n_symbols"),
        f["n_dup_lines"].alias("n_dup_lines"), f["n_repeat_words"].alias("n_repeat_words"),
        base_failed(f).alias("base_failed"), (~base_failed(f) & verdict(f, rules)).alias("kept"))))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules=RULES) -> DataFrame:
    """Per row: id, the five counts, ``base_failed`` and ``kept``."""
    d = judge(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text", rules)
    return d.select("doc_id", "_q_judged.*")
