"""DuckDB spellings shared by the oracle statements.

The oracle is written independently of the Spark code: RE2 patterns with
plain ASCII classes (the test text has no exotic spaces or digits) and
DuckDB list lambdas.
"""

from __future__ import annotations

from quill.functions.text import CONTRACTIONS, PUNCTUATION, URL_PATTERN


def lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(words) -> str:
    return "(" + ", ".join(lit(w) for w in sorted(set(words))) + ")"


def d_fold(x: str) -> str:
    return f"strip_accents({x})"


def d_clean(x: str, *, numbers: bool = False, punctuation: bool = False) -> str:
    """Mirror of the default cleaner."""
    e = d_fold(f"coalesce({x}, '')")
    e = f"regexp_replace({e}, {lit(URL_PATTERN)}, ' ', 'g')"
    e = f"regexp_replace({e}, '\\S+@\\S+', ' ', 'g')"
    e = f"lower({e})"
    if numbers:
        e = f"regexp_replace({e}, '\\d+', ' ', 'g')"
    if punctuation:
        e = f"translate({e}, {lit(PUNCTUATION)}, '')"
    else:
        e = f"regexp_replace({e}, '[^a-zA-Z0-9\\s]', ' ', 'g')"
    return f"trim(regexp_replace({e}, '\\s+', ' ', 'g'))"


def d_words(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


def d_word_count(x: str) -> str:
    return f"CAST(len({d_words(x)}) AS BIGINT)"


def d_contractions(x: str) -> str:
    for pat, rep in CONTRACTIONS:
        x = f"regexp_replace({x}, {lit(pat)}, {lit(rep)}, 'gi')"
    return x
