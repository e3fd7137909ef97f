"""Dictionary entities of any length (N1 b): a trie over words as flat arrays, leftmost-longest in one pass.

A phrase is the lower-cased words of its entry.  The trie's edges are sorted
numbers (node x words + word) with their target nodes, so a batch of texts
walks it at once: every token that begins a phrase starts a walk, a step is one
binary search for all walks, and each remembers the last node that ended a
phrase.  Of the matches the leftmost wins, the longest at one place, and none
overlap.

A dictionary of at most ``TRIE_WORDS`` words is one trie, sent to every task.
A larger one is cut, by a hash of the phrase, into tries of about that size;
the texts are read once for each, and each trie's longest match at every place
meets the others' in a group by document, whose key must then be unique.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.functions.batches import short_batches

TOKEN_PATTERN = r"[\p{L}\p{N}]+"
# Words of the phrases of one trie: some tens of megabytes in a task.
TRIE_WORDS = 200_000
FOUND = "start int, end int, text string, labels array<string>"


class Trie:
    """Phrases (word sequences) with their labels."""

    def __init__(self, phrases: Sequence[tuple[Sequence[str], Sequence[str]]]) -> None:
        self.words: dict[str, int] = {}
        nodes: dict[tuple[int, int], int] = {}
        self.ends: list[int] = [-1]
        self.labels: list[Sequence[str]] = []
        for words, labels in phrases:
            node = 0
            for w in words:
                edge = (node, self.words.setdefault(w, len(self.words)))
                if edge not in nodes:
                    nodes[edge] = len(self.ends)
                    self.ends.append(-1)
                node = nodes[edge]
            self.ends[node] = len(self.labels)
            self.labels.append(labels)
        n = max(1, len(self.words))
        edges = sorted((a * n + w, b) for (a, w), b in nodes.items())
        self.keys = np.array([k for k, _ in edges], np.int64)
        self.targets = np.array([b for _, b in edges], np.int64)
        self.phrase = np.array(self.ends, np.int64)

    def step(self, node: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The node after ``word``, -1 where there is none."""
        out = np.full(len(node), -1, np.int64)
        if not len(self.keys) or not len(node):
            return out
        key = node * len(self.words) + word
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        ok = (word >= 0) & (self.keys[at] == key)
        out[ok] = self.targets[at[ok]]
        return out

    def longest(self, words: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first token, tokens, phrase) of the longest match at every token; ``text`` numbers the tokens' texts."""
        at = np.flatnonzero(words >= 0)
        node = self.step(np.zeros(len(at), np.int64), words[at])
        at, node = at[node >= 0], node[node >= 0]
        best, phrase = np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        depth = 1
        while len(at):
            end = self.phrase[node] >= 0
            best[at[end]], phrase[at[end]] = depth, self.phrase[node[end]]
            more = at + depth < len(words)
            at, node = at[more], node[more]
            same = text[at + depth] == text[at]
            at, node = at[same], node[same]
            node = self.step(node, words[at + depth])
            at, node = at[node >= 0], node[node >= 0]
            depth += 1
        first = np.flatnonzero(best)
        return first, best[first], phrase[first]


def leftmost(first: Sequence[int], size: Sequence[int], text: Sequence[int]) -> list[int]:
    """Numbers of the matches that stay: in order of place, each after the end of the one before."""
    out, free, at = [], 0, None
    for i, (f, n, t) in enumerate(zip(first, size, text, strict=True)):
        if t != at:
            at, free = t, f
        if f >= free:
            out.append(i)
            free = f + n
    return out


def _tokens(texts: list[str | None], words: dict[str, int]) -> tuple[np.ndarray, ...]:
    """(text, start, end, word id or -1) of all tokens."""
    import regex
    pattern = regex.compile(TOKEN_PATTERN)
    of, start, end, word = [], [], [], []
    for i, t in enumerate(texts):
        for m in pattern.finditer(t or ""):
            of.append(i)
            start.append(m.start())
            end.append(m.end())
            word.append(words.get(m.group().lower(), -1))
    return tuple(np.array(x, np.int64) for x in (of, start, end, word))


def phrase_words(text: str) -> list[str]:
    import regex
    return [w.lower() for w in regex.findall(TOKEN_PATTERN, text)]


def _matcher(trie: Trie, names: list[str], final: bool):
    """(key, text) batches to (key, start, end, text, labels) of the matches; all longest ones unless ``final``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short_batches(batches, 1):
            text, start, end, word = _tokens(b.column(1).to_pylist(), trie.words)
            first, size, phrase = trie.longest(word, text)
            if final:
                keep = leftmost(first.tolist(), size.tolist(), text[first].tolist())
                first, size, phrase = first[keep], size[keep], phrase[keep]
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(text[first])), pa.array(start[first], pa.int32()),
                pa.array(end[first + size - 1], pa.int32()), pa.array([names[p] for p in phrase], pa.string()),
                pa.array([trie.labels[p] for p in phrase], pa.list_(pa.string()))],
                names=["key", "start", "end", "text", "labels"])
    return run


def _leftmost_spans(pdf: pd.DataFrame) -> pd.DataFrame:
    """All tries' longest matches of one document to those that stay."""
    pdf = pdf.sort_values(["start", "end"], ascending=[True, False])
    return pdf.iloc[leftmost(pdf["start"].tolist(), (pdf["end"] - pdf["start"]).tolist(), [0] * len(pdf))]


def dictionary(gazetteer: DataFrame, trie_words: int) -> tuple[DataFrame, int]:
    """(phrase, words, labels, shard) of the entries that hold a word, one row a phrase, and the number of shards."""
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(s: pd.Series) -> pd.Series:
        return s.map(lambda t: phrase_words(t or ""))

    d = gazetteer.select(split(F.col("phrase")).alias("words"), "label").filter("size(words) > 0")
    d = d.groupBy("words").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    total = d.agg(F.sum(F.size("words"))).first()[0] or 0
    shards = max(1, -(-total // trie_words))
    shard = F.pmod(F.xxhash64("words"), F.lit(shards))
    return d.withColumn("shard", shard), int(shards)


def match(docs: DataFrame, key: str, text: str, gazetteer: DataFrame, trie_words: int = TRIE_WORDS) -> DataFrame:
    """(key, start, end, text, labels) of the leftmost-longest matches of the (phrase, label) entries."""
    entries, shards = dictionary(gazetteer, trie_words)
    if shards > 1:
        from quill.session import staged
        entries = staged(entries, "phrases")
    kind = docs.schema[key].dataType
    schema = f"key {kind.simpleString()}, {FOUND}"
    d = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    parts = []
    for k in range(shards):
        rows = entries.filter(F.col("shard") == k).select("words", "labels").collect()
        if rows or not parts:
            trie = Trie([(r["words"], r["labels"]) for r in rows])
            names = [" ".join(r["words"]) for r in rows]
            parts.append(d.mapInArrow(_matcher(trie, names, shards == 1), schema))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if shards > 1:
        out = out.groupBy("key").applyInPandas(_leftmost_spans, schema)
    return out.withColumnRenamed("key", key)
