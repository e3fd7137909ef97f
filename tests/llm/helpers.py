"""Small tables and brute-force versions for the tests of the training-data operators."""

import hashlib
import re
from collections import Counter, defaultdict

import xxhash

DOCS = ("doc_id long, text string, lang string, source string, n_chars long, size int, row string, id string, "
        "fp long, shard int, taken int, kept string, host string")
PAGES = "page_id long, url string, html string, digest string, n int, host string"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
PHRASE = "the quick brown fox of the old town jumps over a lazy dog and sleeps in the sun"


def doc(doc_id, text, source="s0"):
    return (doc_id, text, "en", source, None if text is None else len(text), 1, "r", "i", 2, 3, 4, "k", "h")


def odd_docs():
    """Nulls, empty and very long texts, ties, repeated rows."""
    long_text = "\n".join(f"{PHRASE} number {i} {i * 7919 % 1000}" for i in range(4000))
    rows = [doc(1, None), doc(2, ""), doc(3, " \t\n"), doc(4, PHRASE), doc(5, PHRASE), doc(6, PHRASE), doc(6, PHRASE),
            doc(None, PHRASE), doc(None, None, None), doc(7, long_text, None), doc(8, "x" * 200_000), doc(9, "one"),
            doc(9, "two words"), doc(-5, f"{PHRASE}\n{PHRASE.upper()}\n  {PHRASE}\t\n\nend é漢😀"),
            doc(10, "a b c " * 300, "s1"), doc(11, "*** ### $$$ " * 100, "s1"),
            doc(12, "mail a.b@mail.example.com or 4111 1111 1111 1111 and 10.0.0.1 +1 (555) 123-4567", "s2")]
    return rows


def good_docs(n=60):
    """Distinct plain texts with some copies, near copies and shared lines."""
    import random
    r = random.Random(3)
    vocab = [f"{a}{b}{c}" for a in ("th", "on", "er", "an") for b in ("re", "ha", "in", "ou") for c in ("st", "nd", "le", "y")]
    stop = ["the", "of", "and", "to", "in", "a"]
    out = []
    for i in range(n):
        lines = [" ".join(r.choice(vocab if r.random() < 0.7 else stop) for _ in range(r.randint(8, 20)))
                 for _ in range(r.randint(8, 14))]
        if i % 5 == 0:
            lines.insert(2, "This line is shared by many of the documents here.")
        text = "\n".join(lines)
        if i % 9 == 4:
            text = out[-1][1]
        if i % 9 == 7:
            w = out[-1][1].split(" ")
            w[len(w) // 2] = "changed"
            text = " ".join(w)
        out.append(doc(i * 3, text, f"s{r.randint(0, 3)}"))
    return out


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_lines(rows, min_docs=3, min_chars=20):
    """rows (doc_id, text) -> kept text, lines, dropped lines of each row."""
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in k)
    holders = defaultdict(set)
    low = -(1 << 63)
    for d, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(low if d is None else d)
    out = []
    for d, t in rows:
        d = low if d is None else d
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(holders.get(key(x), ())) < min_docs or max(holders[key(x)]) == d]
        out.append(("\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def brute_simhash(text, k=4):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i:i + k]) for i in range(max(1, len(words) - k + 1))]
    ones = Counter()
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(grams))


def brute_components(prints, radius=4):
    """Index of the component of each fingerprint."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i, x in enumerate(prints):
        for j in range(i):
            if bin(x ^ prints[j]).count("1") <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def brute_quality(text):
    t = text or ""
    w = WORD.findall(t)
    lines = [x for x in t.split("\n") if WORD.search(x)]
    grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
    inside = {p for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for p in (i, i + 1, i + 2)}
    n = len(w)
    return (n, sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(inside),
            n < 50 or 100 * len(inside) > 50 * n)
