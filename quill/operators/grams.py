"""Counts of terms in Arrow batches, without a row for each term.

A text comes as its terms (:func:`quill.operators.features.terms`) with blanks between,
which no term holds.  The terms of a batch are numbered, counted and put into n-grams by
numpy; batches are cut by bytes, so memory does not grow with them.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions.batches import short_batches
from quill.session import cut_lineage

# Words, or kept terms, that are sent to the tasks.
SENT_TERMS = 200_000
# Vectors that are gathered at once (64 components: 16 MB).
GATHERED = 1 << 15


class Cut(NamedTuple):
    """The distinct words of a batch; the number of a word, and the row, of every term in order."""

    words: pa.Array
    ids: np.ndarray
    rows: np.ndarray


def cut(texts: pa.Array) -> Cut:
    lists = pc.split_pattern(texts, " ")
    coded = lists.flatten().dictionary_encode()
    ids = coded.indices.to_numpy().astype(np.int64)
    rows = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    if (none := pc.index(coded.dictionary, "").as_py()) >= 0:  # of a text without terms
        ids, rows = ids[ids != none], rows[ids != none]
    return Cut(coded.dictionary, ids, rows)


def _distinct(codes: np.ndarray) -> np.ndarray:
    """Sorted distinct codes; ``np.unique`` without counts hashes them, which takes ten times as long."""
    codes = np.sort(codes)
    return codes[_sizes(codes)[0]]


def _lists(values: pa.Array, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), values)


def _sizes(sorted_codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places and lengths of the stretches of equal codes."""
    starts = np.flatnonzero(np.concatenate([[True], sorted_codes[1:] != sorted_codes[:-1]])[:len(sorted_codes)])
    return starts, np.diff(np.concatenate([starts, [len(sorted_codes)]]))


# --- counts of the corpus ---------------------------------------------------------------------
def word_counts(docs: DataFrame, terms: Column) -> DataFrame:
    """(word, c): how often each term comes in all texts, added up for a batch of texts before Spark does."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short_batches(batches, 0):
            words, ids, _ = cut(b.column(0))
            n = np.bincount(ids, minlength=len(words))
            came = pa.array(np.flatnonzero(n))
            yield pa.RecordBatch.from_arrays([words.take(came), pa.array(n).take(came)], names=["word", "n"])

    found = docs.select(F.array_join(terms, " ").alias("terms")).mapInArrow(run, "word string, n long")
    return found.groupBy("word").agg(F.sum("n").alias("c"))


# --- pooled vectors -----------------------------------------------------------------------------
def packed_words(docs: DataFrame, key: str, terms: Column, shards: int, first: bool = False) -> DataFrame:
    """(key, shard, words, n): a row for each text and shard that its words fall in.

    ``words`` has the distinct words (the ``first`` alone) with blanks between, ``n`` their
    counts as 32-bit numbers.  The shard is that of :func:`shard_of`.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in short_batches(batches, 1):
            words, ids, rows = cut(b.column(1))
            if not len(ids):
                continue
            if first:
                ids, rows = (x[_sizes(rows)[0]] for x in (ids, rows))
            codes, n = np.unique(rows * len(words) + ids, return_counts=True)
            row, word = np.divmod(codes, len(words))
            shard = np.zeros(len(words), np.int64)
            if shards > 1:
                shard = np.array([zlib.crc32(w.encode()) % shards for w in words.to_pylist()], np.int64)
            group = row * shards + shard[word]
            order = np.argsort(group, kind="stable")
            group, word, n = group[order], word[order], n[order]
            starts, sizes = _sizes(group)
            at = np.concatenate([[0], np.cumsum(sizes * 4)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                b.column(0).take(pa.array(group[starts] // shards)), pa.array(group[starts] % shards, pa.int32()),
                pc.binary_join(_lists(words.take(pa.array(word)), sizes), " "),
                pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(n.astype("<i4"))]),
            ], names=["key", "shard", "words", "n"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, F.array_join(terms, " ").alias("terms")).mapInArrow(run, f"key {kind}, shard int, words string, n binary")


def shard_of(word: str, shards: int) -> Column:
    return (F.crc32(F.encode(word, "UTF-8")) % shards).cast("int")


class _Vectors(NamedTuple):
    """Words, their vectors (several of a word folded into one, and a last row of zeros) and how many they were."""

    words: pa.Array
    table: np.ndarray
    times: np.ndarray

    @classmethod
    def of(cls, words: list[pa.Array], vecs: list[np.ndarray], dim: int, how: str) -> _Vectors:
        coded = pa.concat_arrays([*words, pa.array([], pa.string())]).dictionary_encode()
        at, known = coded.indices.to_numpy(), len(coded.dictionary)
        vecs = np.concatenate([*vecs, np.zeros((0, dim), np.float32)])
        table = np.zeros((known + 1, dim))
        if how == "max":
            table[:known] = -np.inf
            np.maximum.at(table, at, vecs)
        elif len(at) == known:
            table[at] = vecs
        else:
            np.add.at(table, at, vecs)
        times = np.ones(known, np.int64) if how == "max" else np.bincount(at, minlength=known)
        return cls(coded.dictionary, table, np.append(times, 1))


def folded(dim: int, how: str, oov: bool) -> Callable:
    """(cell, key, words, n, vec) sorted by cell, its vectors (``n`` is null) first -> (key, n, part).

    ``part`` is the sum (or maximum) of what the vectors of a cell give to the words of a row,
    ``n`` how many they are.  With ``oov`` a word without a vector counts as zeros.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, words, vecs, known = None, [], [], None
        for b in short_batches(batches, 2):
            cells, first = b.column(0).to_numpy(), b.column(3).is_null().to_numpy(zero_copy_only=False)
            cuts = (np.flatnonzero((cells[1:] != cells[:-1]) | (first[1:] != first[:-1])) + 1).tolist()
            for at, end in zip([0, *cuts], [*cuts, b.num_rows], strict=True):
                part = b.slice(at, end - at)
                if cells[at] != cell:
                    cell, words, vecs, known = cells[at], [], [], None
                if first[at]:
                    words.append(part.column(2))
                    vecs.append(part.column(4).flatten().to_numpy(zero_copy_only=False).reshape(len(part), dim))
                    continue
                if known is None:  # all vectors of the cell are here
                    known, words, vecs = _Vectors.of(words, vecs, dim, how), [], []
                yield from _folded(part, known, dim, how, oov)
    return run


def _folded(part: pa.RecordBatch, known: _Vectors, dim: int, how: str, oov: bool) -> Iterator[pa.RecordBatch]:
    lists = pc.split_pattern(part.column(2), " ")
    coded = lists.flatten().dictionary_encode()
    found = pc.fill_null(pc.index_in(coded.dictionary, value_set=known.words), len(known.words)).to_numpy()
    word = found[coded.indices.to_numpy()]
    n = np.frombuffer(b"".join(part.column(3).to_pylist()), "<i4").astype(np.int64) * known.times[word]
    row = np.repeat(np.arange(len(part)), pc.list_value_length(lists).to_numpy())
    if not oov:
        keep = word < len(known.words)
        word, n, row = word[keep], n[keep], row[keep]
    if not len(row):
        return
    starts, sizes = _sizes(row)
    at = 0
    while at < len(starts):
        end = max(at + 1, int(np.searchsorted(starts + sizes, starts[at] + GATHERED, "right")))
        got = slice(starts[at], starts[end - 1] + sizes[end - 1])
        vec, to = known.table[word[got]], starts[at:end] - starts[at]
        if how != "max":
            vec *= (n[got] / known.times[word[got]])[:, None]
        sums = (np.maximum if how == "max" else np.add).reduceat(vec, to)
        yield pa.RecordBatch.from_arrays([
            part.column(1).take(pa.array(row[starts[at:end]])), pa.array(np.add.reduceat(n[got], to)),
            _lists(pa.array(sums.ravel()), np.full(end - at, dim))], names=["key", "n", "part"])
        at = end


# --- n-grams ------------------------------------------------------------------------------------
def keyed_texts(docs: DataFrame, key: str, text: str, terms: Callable[[Column], Column]) -> DataFrame:
    """(key, terms) with the rows of a key one after another in one task, on a checkpoint: texts are cut and dealt out once."""
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).repartition("key").sortWithinPartitions("key")
    return cut_lineage(rows.select("key", F.array_join(terms(F.col("text")), " ").alias("terms")))


def _groups(keys: pa.Array, before: pa.Array | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """The key's number for each row, the first row of each key, and whether the first key is the one ``before``."""
    codes = keys.dictionary_encode(null_encoding="encode").indices.to_numpy()
    new = np.concatenate([[True], codes[1:] != codes[:-1]])
    return np.cumsum(new) - 1, np.flatnonzero(new), before is not None and before.to_pylist() == keys[:1].to_pylist()


def grams(c: Cut, lo: int, hi: int, ok: np.ndarray | None = None) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """For each n from ``lo`` to ``hi``: the distinct n-grams, the number of each that comes, and its row.

    ``ok`` tells for each word whether n-grams with it are wanted.
    """
    names, last, at = c.words, c.ids, np.arange(len(c.ids))
    if ok is not None:
        at = at[ok[c.ids]]
        last = last[at]
    for n in range(1, hi + 1):
        if n > 1:
            fits = at + n - 1 < len(c.ids)
            at, last = at[fits], last[fits]
            fits = c.rows[at + n - 1] == c.rows[at]
            if ok is not None:
                fits &= ok[c.ids[at + n - 1]]
            at, last = at[fits], last[fits]
            codes, last = np.unique(last * max(1, len(c.words)) + c.ids[at + n - 1], return_inverse=True)
            head, tail = np.divmod(codes, max(1, len(c.words)))
            names = pc.binary_join_element_wise(names.take(pa.array(head)), c.words.take(pa.array(tail)), " ")
        if n >= lo:
            yield names, last, c.rows[at]


def gram_stats(texts: DataFrame, lo: int, hi: int, words: list[str] | None = None) -> DataFrame:
    """(term, cnt, df) of the n-grams in :func:`keyed_texts`, n from ``lo`` to ``hi``: how often they come, and with how many keys.

    With ``words`` only n-grams of these words are counted.
    """
    sent = texts.sparkSession.sparkContext.broadcast(pa.array(words, pa.string())) if words is not None else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, seen = None, {}  # the last key, and its n-grams so far
        for b in short_batches(batches, 1):
            of_row, starts, same = _groups(b.column(0), before)
            before = b.column(0)[b.num_rows - 1:]
            c = cut(b.column(1))
            ok = pc.is_in(c.words, value_set=sent.value).to_numpy(zero_copy_only=False) if sent else None
            for n, (names, gram, rows) in enumerate(grams(c, lo, hi, ok), lo):
                size = max(1, len(names))
                pairs = _distinct(of_row[rows] * size + gram)
                df = np.bincount(pairs % size, minlength=len(names))
                had = seen.get(n, set()) if same else set()
                if had:
                    own = pairs[pairs < size]
                    again = [g in had for g in names.take(pa.array(own)).to_pylist()]
                    df[own[again]] -= 1
                last = set(names.take(pa.array(pairs[pairs // size == len(starts) - 1] % size)).to_pylist())
                seen[n] = had | last if len(starts) == 1 else last
                cnt = np.bincount(gram, minlength=len(names))
                came = pa.array(np.flatnonzero(cnt))
                yield pa.RecordBatch.from_arrays([names.take(came), pa.array(cnt).take(came), pa.array(df).take(came)],
                                                 names=["term", "cnt", "df"])

    found = texts.mapInArrow(run, "term string, cnt long, df long")
    return found.groupBy("term").agg(F.sum("cnt").alias("cnt"), F.sum("df").alias("df"))


def gram_weights(texts: DataFrame, key: str, model: dict[str, float], lo: int, hi: int, sublinear_tf: bool,
                 norm: str | None) -> DataFrame:
    """(key, term, weight) of the n-grams in ``model`` (term -> idf) that come with a key, normalised by key."""
    if norm not in ("l1", "l2", None):
        raise ValueError(f"norm {norm!r}: l1, l2 or None")
    words = sorted({w for t in model for w in t.split(" ")})
    sent = texts.sparkSession.sparkContext.broadcast(
        (pa.array(list(model), pa.string()), np.array(list(model.values()), float), pa.array(words, pa.string())))

    def weighed(keys: pa.Array, at: np.ndarray, term: np.ndarray, tf: np.ndarray) -> pa.RecordBatch:
        names, idf, _ = sent.value
        w = (1 + np.log(tf) if sublinear_tf else tf) * idf[term]
        if norm == "l2":
            w = w / np.sqrt(np.bincount(at, w * w, len(keys)))[at]
        elif norm == "l1":
            w = w / np.bincount(at, np.abs(w), len(keys))[at]
        return pa.RecordBatch.from_arrays([keys.take(pa.array(at)), names.take(pa.array(term)), pa.array(w)],
                                          names=["key", "term", "weight"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _, used = sent.value
        none = np.zeros(0, np.int64)
        open_key, open_terms, open_tf = None, none, none  # the last key may go on in the next batch
        for b in short_batches(batches, 1):
            of_row, starts, same = _groups(b.column(0), open_key)
            c = cut(b.column(1))
            ok = pc.is_in(c.words, value_set=used).to_numpy(zero_copy_only=False)
            keys, shift = b.column(0).take(pa.array(starts)), 0
            if open_key is not None and not same:
                keys, shift = pa.concat_arrays([open_key, keys]), 1
            codes, times = [open_terms], [open_tf]
            for grams_, gram, rows in grams(c, lo, hi, ok):
                known = pc.fill_null(pc.index_in(grams_, value_set=names), -1).to_numpy().astype(np.int64)[gram]
                kept = known >= 0
                code, n = np.unique((of_row[rows[kept]] + shift) * len(names) + known[kept], return_counts=True)
                codes.append(code)
                times.append(n)
            code, to = np.unique(np.concatenate(codes), return_inverse=True)
            tf = np.bincount(to, np.concatenate(times), len(code))
            at, term = np.divmod(code, max(1, len(names)))
            more = at == len(keys) - 1
            open_key, open_terms, open_tf = keys[len(keys) - 1:], term[more], tf[more]
            yield weighed(keys, at[~more], term[~more], tf[~more])
        if open_key is not None:
            yield weighed(open_key, np.zeros(len(open_terms), np.int64), open_terms, open_tf)

    kind = texts.schema["key"].dataType.simpleString()
    return texts.mapInArrow(run, f"key {kind}, term string, weight double").withColumnRenamed("key", key)
