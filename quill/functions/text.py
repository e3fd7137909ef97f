"""Text cleaning, statistics and token expressions (Column -> Column).

All of these stay inside the JVM except the Unicode fold of the rare rows
whose characters expand to several characters, which go through one
Arrow-batched pandas UDF.
"""

from __future__ import annotations

import functools
import glob
import os
import unicodedata
import zipfile

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's cleaning rules.
# ---------------------------------------------------------------------------
URL_PATTERN = r"http[s]?://(?:[a-zA-Z]|[0-9]|[$-_@.&+]|[!*\\(\\),]|(?:%[0-9a-fA-F][0-9a-fA-F]))+"
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
# English contractions, applied in this order, case-insensitively.
CONTRACTIONS = [
    ("won't", "will not"),
    ("can't", "cannot"),
    ("n't", " not"),
    ("'re", " are"),
    ("'ve", " have"),
    ("'ll", " will"),
    ("'d", " would"),
    ("'m", " am"),
]

# Java regex spellings of Python's Unicode-aware classes.  Python's ``\s``
# also matches the separators U+001C..U+001F, Java's ``(?U)\s`` does not.
WS_CLASS = r"\s\x{1c}-\x{1f}"
WS_RUN = rf"(?U)[{WS_CLASS}]+"
# Anchored at the start of a non-space run: equivalent to ``\S+@\S+`` (a match
# from inside a run implies one from its start) but linear, without retrying
# every start position of long words.
J_EMAIL = rf"(?U)(?<![^{WS_CLASS}])[^{WS_CLASS}]+@[^{WS_CLASS}]+"
J_NUMBER = r"(?U)\d+"
J_SPECIAL = rf"(?U)[^a-zA-Z0-9{WS_CLASS}]"

# Word tokens: letter/digit runs with an optional 's-like suffix, every other
# non-space character is a token of its own.
WORD_TOKEN = r"[\p{L}\p{N}]+(?:'\p{L}+)?|[^\s\p{L}\p{N}]"
SENTENCE_BREAK = r"(?<=[.!?])\s+"


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and use it in ``fn``.

    Catalyst does not share sub-expressions inside lambda bodies, so an
    array expression referenced inside ``transform``/``aggregate`` would be
    recomputed for every element.  Passing it through a one-element
    ``transform`` evaluates it once per row.
    """
    return F.get(F.transform(F.array(value), fn), 0)


def unnest(df: DataFrame, array, name: str, *keep, pos: str | None = None) -> DataFrame:
    """One row for each element of ``array`` (and its position), as ``explode`` gives.

    The optimizer guards an inner generator with a filter on the array's size,
    which evaluates a computed array twice more; an outer generator has no such
    guard, and the one row it gives for an empty array is dropped by position.
    """
    array = F.col(array) if isinstance(array, str) else array
    at = pos or "_unnest_pos"
    out = df.select(*keep, F.posexplode_outer(array).alias(at, name)).filter(F.col(at).isNotNull())
    return out if pos else out.drop(at)


SCAN_STEPS = 31  # doubling steps up to the longest array there is


def prefix_sum(arr: Column) -> Column:
    """Inclusive prefix sums of an int array in O(n log n) (Hillis-Steele scan).

    ``aggregate`` with a growing array copies it on every step (quadratic);
    here each doubling step is one ``transform`` over a bound array, and the
    steps at or beyond the array's size leave it as it is.
    """
    def step(d):
        return lambda a: F.when(F.size(a) > d, F.transform(
            a, lambda x, i: F.when(i >= d, x + F.get(a, i - d)).otherwise(x))).otherwise(a)
    expr = arr
    for k in range(SCAN_STEPS):
        expr = let(expr, step(1 << k))
    return expr


# ---------------------------------------------------------------------------
# Unicode fold (NFKD, combining marks dropped)
# ---------------------------------------------------------------------------
def _fold_py(s: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))


# A noncharacter marks "this row needs the exact Python fold".
SENTINEL = "\uffff"


@functools.lru_cache(maxsize=None)
def fold_tables() -> tuple[str, str]:
    """(from, to) for ``translate``, derived from ``unicodedata`` by rule.

    The fold is per character (combining marks, the only characters canonical
    reordering moves, are dropped), so a character map is exact for every
    character whose fold is one character (mapped) or empty (deleted).
    Characters folding to several characters map to :data:`SENTINEL`, which
    routes their rows to the UDF.
    """
    src, dst, dele, expand = [], [], [], []
    for cp in range(0x80, 0x110000):
        if 0xD800 <= cp <= 0xDFFF:
            continue
        ch = chr(cp)
        f = _fold_py(ch)
        if f == ch:
            continue
        if len(f) == 1:
            src.append(ch)
            dst.append(f)
        elif not f:
            dele.append(ch)
        else:
            expand.append(ch)
    return "".join(src) + "".join(expand) + "".join(dele), "".join(dst) + SENTINEL * len(expand)


@F.pandas_udf(T.StringType())
def _fold_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda t: None if t is None else _fold_py(t))


def fold_unicode(c: Column, letters: Column | None = None) -> Column:
    """NFKD + drop combining marks.

    ASCII texts stay as they are; one JVM ``translate`` does the whole fold for
    almost every other row.  Only rows holding a character that expands to
    several characters (ligatures, fractions, Hangul syllables, ...) are sent,
    alone, to the pandas UDF.  What is asked of the text before it is folded is asked
    of ``letters``: a column with the same characters beyond ASCII (by default ``c``),
    so that an expensive text is worked out once a row.
    """
    frm, to = fold_tables()
    by = c if letters is None else letters
    plain = F.octet_length(by) == F.length(by)
    t = F.when(plain, c).otherwise(F.translate(c, frm, to))
    odd = F.when(~plain, F.instr(F.translate(by, frm, to), SENTINEL) > 0)
    return F.coalesce(_fold_udf(F.when(odd, c)), t)


# ---------------------------------------------------------------------------
# Cleaning (C2..C13)
# ---------------------------------------------------------------------------
def remove_urls(c: Column) -> Column:
    return F.regexp_replace(c, URL_PATTERN, " ")


def remove_emails(c: Column) -> Column:
    return F.regexp_replace(c, J_EMAIL, " ")


def remove_numbers(c: Column) -> Column:
    return F.regexp_replace(c, J_NUMBER, " ")


def remove_punctuation(c: Column) -> Column:
    return F.translate(c, PUNCTUATION, "")


def remove_special_chars(c: Column) -> Column:
    return F.regexp_replace(c, J_SPECIAL, " ")


def collapse_whitespace(c: Column) -> Column:
    # After the collapse every whitespace run is one blank, so trimming blanks
    # equals Python's ``strip()``.
    return F.trim(F.regexp_replace(c, WS_RUN, " "))


def words(c: Column) -> Column:
    """``text.split()``: non-empty whitespace-separated words."""
    return F.filter(F.split(c, WS_RUN), lambda w: w != "")


def remove_stopwords(c: Column, stopwords, case_insensitive: bool = False) -> Column:
    """Drop words in ``stopwords`` and re-join with one blank.

    ``isin`` over literals becomes a hash set lookup (InSet) in Catalyst.
    """
    stop = sorted(set(stopwords))
    if not stop:
        return c
    if case_insensitive:
        keep = lambda w: ~F.lower(w).isin(*stop)
    else:
        keep = lambda w: ~w.isin(*stop)
    return F.array_join(F.filter(words(c), keep), " ")


def expand_contractions(c: Column) -> Column:
    """The eight English rules in order, case-insensitive."""
    for pat, rep in CONTRACTIONS:
        c = F.regexp_replace(c, "(?i)" + pat, rep)
    return c


def clean_text(c: Column, *, lowercase: bool = True, remove_urls_: bool = True,
               remove_emails_: bool = True, remove_special_chars_: bool = True,
               remove_numbers_: bool = False, remove_punctuation_: bool = False,
               remove_extra_whitespace: bool = True, normalize_unicode: bool = True,
               custom_stopwords=None, letters: Column | None = None) -> Column:
    """C11: the full cleaner; rule order is part of the semantics.

    ``letters``: see :func:`fold_unicode`.
    """
    c = F.coalesce(c.cast("string"), F.lit(""))
    if normalize_unicode:
        c = fold_unicode(c, None if letters is None else F.coalesce(letters.cast("string"), F.lit("")))
    if remove_urls_:
        c = remove_urls(c)
    if remove_emails_:
        c = remove_emails(c)
    if lowercase:
        c = F.lower(c)
    if remove_numbers_:
        c = remove_numbers(c)
    if remove_punctuation_:
        c = remove_punctuation(c)
    special = remove_special_chars_ and not remove_punctuation_
    if special and remove_extra_whitespace:
        # what is neither letter nor digit is special or white space: both steps in one, by the words that
        # stay, which takes half the time of replacing what is between them
        c = F.array_join(F.regexp_extract_all(c, F.lit("[a-zA-Z0-9]+"), F.lit(0)), " ")
    elif special:
        c = remove_special_chars(c)
    elif remove_extra_whitespace:
        c = collapse_whitespace(c)
    if custom_stopwords:
        c = remove_stopwords(c, custom_stopwords)
    return c


def clean_multilingual(c: Column, lang: Column, **kw) -> Column:
    """Contractions for English rows, then the full cleaner.

    The rules all need an apostrophe, and neither take nor give a character beyond ASCII.
    """
    short = (lang == "en") & (F.instr(c, "'") > 0)
    return clean_text(F.when(short, expand_contractions(c)).otherwise(c), letters=c, **kw)


# ---------------------------------------------------------------------------
# Validation and statistics (C14..C17)
# ---------------------------------------------------------------------------
def invalid_reason(c: Column) -> Column:
    """C14: NULL when valid, else why the text is rejected."""
    return (F.when(c.isNull(), F.lit("not_a_string"))
            .when(F.length(F.regexp_replace(c, WS_RUN, "")) == 0, F.lit("empty"))
            .otherwise(F.lit(None).cast("string")))


def strip_text(c: Column) -> Column:
    return F.regexp_replace(c, rf"(?U)^[{WS_CLASS}]+|[{WS_CLASS}]+$", "")


def char_length(c: Column) -> Column:
    return F.length(c).cast("bigint")


def word_count(c: Column) -> Column:
    return F.size(words(c)).cast("bigint")


def preview(c: Column, n: int = 100) -> Column:
    """C17: first ``n`` characters plus ``...`` (always appended)."""
    return F.concat(F.substring(c, 1, n), F.lit("..."))


# ---------------------------------------------------------------------------
# Tokens (T1..T3, F4)
# ---------------------------------------------------------------------------
def word_tokens(c: Column) -> Column:
    """Word and punctuation tokens; empty text -> empty array."""
    return F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(WORD_TOKEN), 0)


def filter_tokens(tokens: Column, *, lowercase: bool = True, stopwords=None,
                  min_length: int = 1, max_length: int | None = None) -> Column:
    """Lowercase -> stopwords -> length bounds (min applies only when > 1)."""
    if lowercase:
        tokens = F.transform(tokens, F.lower)
    if stopwords:
        stop = sorted(set(stopwords))
        tokens = F.filter(tokens, lambda t: ~t.isin(*stop))
    if min_length > 1:
        tokens = F.filter(tokens, lambda t: F.length(t) >= min_length)
    if max_length:
        tokens = F.filter(tokens, lambda t: F.length(t) <= max_length)
    return tokens


def sentences(c: Column) -> Column:
    """Split after ., ! or ? followed by whitespace."""
    return F.split(F.coalesce(c, F.lit("")), SENTENCE_BREAK)


def ngrams(tokens: Column, n: int, max_n: int | None = None) -> Column:
    """contiguous n-grams (``n`` to ``max_n`` words) joined by one blank; empty when too short."""
    def of(tk: Column, k: int) -> Column:
        return F.when(F.size(tk) >= k, F.transform(
            F.sequence(F.lit(1), F.size(tk) - k + 1),
            lambda i: F.array_join(F.slice(tk, i, k), " "))).otherwise(F.array().cast("array<string>"))
    sizes = range(n, (max_n or n) + 1)
    return let(tokens, lambda tk: F.concat(*[of(tk, k) for k in sizes]) if len(sizes) > 1 else of(tk, n))


# ---------------------------------------------------------------------------
# Stop-word lists shipped inside Spark ML (read without a JVM)
# ---------------------------------------------------------------------------
@functools.lru_cache(maxsize=None)
def default_stopwords(language: str = "english") -> tuple[str, ...]:
    import pyspark
    dirs = [os.path.join(os.path.dirname(pyspark.__file__), "jars")]
    if os.environ.get("SPARK_HOME"):
        dirs.append(os.path.join(os.environ["SPARK_HOME"], "jars"))
    jars = [j for d in dirs for j in glob.glob(os.path.join(d, "spark-mllib_*.jar"))]
    if not jars:
        raise FileNotFoundError("spark-mllib jar with the stop-word lists not found")
    with zipfile.ZipFile(jars[0]) as z:
        body = z.read(f"org/apache/spark/ml/feature/stopwords/{language}.txt").decode("utf-8")
    return tuple(w for w in body.split("\n") if w)
