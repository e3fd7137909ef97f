"""Dictionary phrases of any length against a plain search."""

import random

import pytest

from quill.operators import entities as en
from quill.operators import phrases as ph


def plain(texts, entries):
    """(doc, phrase, label, start, end): at each token the longest phrase, from left to right without overlap."""
    import regex
    known = {}
    for phrase, label in entries:
        words = tuple(ph.phrase_words(phrase or ""))
        if words:
            known.setdefault(words, set()).add(label)
    out = []
    for d, t in texts:
        toks = [(m.group().lower(), m.start(), m.end()) for m in regex.finditer(ph.TOKEN_PATTERN, t or "")]
        i = 0
        while i < len(toks):
            for n in range(len(toks) - i, 0, -1):
                words = tuple(w for w, _, _ in toks[i:i + n])
                if words in known:
                    out += [(d, " ".join(words), x, toks[i][1], toks[i + n - 1][2]) for x in known[words]]
                    i += n
                    break
            else:
                i += 1
    return sorted(out)


def found(spark, texts, entries, **how):
    docs = spark.createDataFrame(texts, "id long, body string").repartition(3)
    g = spark.createDataFrame(entries, "phrase string, label string")
    got = en.extract_gazetteer(docs, "id", "body", g, **how).collect()
    return sorted((r.id, r.text, r.label, r.start, r.end) for r in got)


ENTRIES = [("New York", "GPE"), ("new york city", "GPE"), ("City of New-York", "ORG"), ("York", "PERSON"), ("york", "GPE"),
           ("a b c d e f g h i j", "EVENT"), ("c d", "LAW"), ("", "LAW"), ("!!", "LAW"), (None, "LAW"), ("École Normale", "ORG")]


def test_longest_phrase_at_the_leftmost_place(spark):
    texts = [(1, "New York City, new  york; NEW YORK!"), (2, "the city of New York city"), (3, None), (4, ""), (5, "york"),
             (6, "a b c d e f g h i j a b c d e f g h i"), (7, "l'école normale. New"), (8, "x" * 100_000 + " New York")]
    assert found(spark, texts, ENTRIES) == plain(texts, ENTRIES)
    assert (1, "new york city", "GPE", 0, 13) in found(spark, texts, ENTRIES)


@pytest.mark.parametrize("trie_words", [ph.TRIE_WORDS, 20])
def test_random_phrases_of_one_to_ten_words(spark, trie_words):
    rng = random.Random(trie_words)
    vocab = [f"w{i}" for i in range(6)]
    entries = [(" ".join(rng.choice(vocab) for _ in range(rng.randint(1, 10))), rng.choice("XYZ")) for _ in range(80)]
    texts = [(i, " ".join(rng.choice(vocab) for _ in range(rng.randint(0, 120)))) for i in range(40)]
    want = plain(texts, entries)
    assert found(spark, texts, entries, trie_words=trie_words) == want
    assert max(len(r[1].split()) for r in want) >= 4


def test_empty_dictionary_and_table(spark):
    assert found(spark, [(1, "a b")], []) == []
    assert found(spark, [], [("a", "X")]) == []
