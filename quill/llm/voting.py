"""Quality classifier by votes of the nearest labelled documents in a latent-semantic space.

A text is a row of term weights: its words, hashed to ``WORDS`` places, and
the shapes of its words (``Aa``, ``0.0``, ``|``), hashed to ``SHAPES`` places
together with how much of it repeats (words next to themselves, lines, words in
all).  Words weigh (1 + ln count) * ln((N + 1) / (df + 1)), df counted over all
documents; shapes weigh the root of their share; either half has length one.

The labelled sample (about ``PER_LABEL`` documents of each label, chosen by a
hash of doc_id) gives the latent directions, the leading right singular vectors
of its rows.  Its vectors, a fixed size, go to every task.  A task multiplies
blocks of documents with all of them: the cosines are exact, and the
``NEIGHBOURS`` largest vote with a power of their cosine, times the number of
labelled documents that each sampled one of its label stands for.  The score is the
share of the votes for label 1.

Defined cases: null text is empty; a text without words, or with no similar
neighbour, has the share of label 1 among the labelled documents; several
labels of a doc_id count as their mean; null labels, labels without a document
and labels of held-out ids teach nothing; a null doc_id is not held out and
never labelled; of several rows of a labelled doc_id the smallest text teaches;
without any label the score is 0.5; of equal cosines any may vote; a text of
any length is read whole, a few megabytes at a time; an empty table gives an
empty result.  Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import chain
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORDS, SHAPES = 4096, 512
TERMS = WORDS + SHAPES
PER_LABEL, LATENT, NEIGHBOURS, SHARPNESS = 2048, 64, 9, 8
ROWS, PIECE, REMEMBER = 256, 1 << 22, 400_000
CLASSES = bytes(65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 97 if 97 <= b <= 122 or b >= 128 else b for b in range(256))
RUN = re.compile(rb"(.)\1+", re.DOTALL)
REPEATS = (b"word again", b"line again", b"any again")
BLANK = re.compile(rb"[ \t\n\x0b\x0c\r]")


def shape(word: bytes) -> bytes:
    """Runs of upper-case, lower-case or other letters and digits as one character each, the first eight."""
    return RUN.sub(rb"\1", word.translate(CLASSES))[:8]


def cut(data: bytes) -> Iterator[bytes]:
    """Pieces of some megabytes that end at a blank."""
    at = 0
    while len(data) - at > PIECE:
        end = BLANK.search(data, at + PIECE)
        if not end:
            break
        yield data[at:end.start()]
        at = end.start()
    yield data[at:]


class Places(dict):
    """Word -> its place and its shape's place, as one number; computed for words not met before."""

    def __init__(self) -> None:
        self.shapes: dict[bytes, int] = {}  # by the classes of the word's characters, which few words differ in

    def __missing__(self, word: bytes) -> int:
        classes = word.translate(CLASSES)
        place = self.shapes.get(classes)
        if place is None:
            place = zlib.crc32(shape(word)) % SHAPES
            if len(self.shapes) < REMEMBER:
                self.shapes[classes] = place
        self[word] = code = zlib.crc32(word.lower()) % WORDS * SHAPES + place
        return code


class Terms:
    """Term counts of texts; remembers the places of words it has met."""

    def __init__(self) -> None:
        self.places = Places()

    def codes(self, bags: list) -> tuple[np.ndarray, np.ndarray]:
        """(text, code) of the words of each bag."""
        if len(self.places) > REMEMBER:
            self.places.clear()
        sizes = np.fromiter(map(len, bags), np.int64, len(bags))
        code = np.fromiter(map(self.places.__getitem__, chain.from_iterable(bags)), np.int64, int(sizes.sum()))
        return np.repeat(np.arange(len(bags)), sizes), code

    def present(self, texts: list[str | None]) -> np.ndarray:
        """In how many of the texts each word place is."""
        bags = []
        for t in texts:
            bag: set[bytes] = set()
            for piece in cut((t or "").encode("utf-8", "replace")):
                bag.update(piece.split())
            bags.append(bag)
        of, code = self.codes(bags)
        return np.bincount(np.unique(of * WORDS + code // SHAPES) % WORDS, minlength=WORDS)

    def counts(self, texts: list[str | None]) -> np.ndarray:
        """A row of ``TERMS`` counts a text."""
        bags, repeats = [], np.zeros((len(texts), len(REPEATS)))
        for i, t in enumerate(texts):
            data = (t or "").encode("utf-8", "replace")
            bag: Counter = Counter()
            last = None
            for piece in cut(data):
                words = piece.split()
                bag.update(words)
                if words:
                    repeats[i, 0] += sum(map(eq, words, words[1:])) + (words[0] == last)
                    last = words[-1]
            lines = data.split(b"\n")
            if len(set(lines)) < len(lines):
                repeats[i, 1] = sum(n * len(x.split()) for x, n in Counter(lines).items() if n > 1)
            repeats[i, 2] = sum(bag.values()) - len(bag)
            bags.append(bag)
        of, code = self.codes(bags)
        count = np.fromiter(chain.from_iterable(b.values() for b in bags), np.float64, len(code))
        row, size = of * TERMS, len(texts) * TERMS
        flat = np.bincount(row + code // SHAPES, count, size) + np.bincount(row + WORDS + code % SHAPES, count, size)
        out = flat.reshape(len(texts), TERMS)
        for k, name in enumerate(REPEATS):
            out[:, WORDS + zlib.crc32(name) % SHAPES] += repeats[:, k]
        return out


def weights(counts: np.ndarray, rarity: np.ndarray) -> np.ndarray:
    """Rows of term weights; each half of a row has length one, or zero without words."""
    w = np.zeros(counts.shape, np.float32)
    words = np.where(counts[:, :WORDS] > 0, 1 + np.log(np.maximum(counts[:, :WORDS], 1)), 0) * rarity
    n = counts[:, :WORDS].sum(axis=1, keepdims=True)
    shapes = np.sqrt(counts[:, WORDS:] / np.maximum(n, 1))
    for part, where in ((words, slice(0, WORDS)), (shapes, slice(WORDS, TERMS))):
        length = np.sqrt((part * part).sum(axis=1, keepdims=True))
        w[:, where] = part / np.where(length > 0, length, 1)
    return w


def blocks(batch: pa.RecordBatch, text: int) -> Iterator[tuple[int, list[str | None]]]:
    """(first row, texts) of runs of at most ROWS rows and about PIECE characters."""
    at, size, run = 0, 0, []
    for i, t in enumerate(batch.column(text)):
        run.append(t.as_py())
        size += len(run[-1] or "")
        if len(run) == ROWS or size >= PIECE:
            yield at, run
            at, size, run = i + 1, 0, []
    if run:
        yield at, run


def document_counts(docs: DataFrame) -> tuple[int, np.ndarray]:
    """(documents, documents that hold each word place), over all rows of the column ``text``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, total = Terms(), np.zeros(WORDS + 1, np.int64)
        for b in batches:
            for _, texts in blocks(b, 0):
                total[:WORDS] += terms.present(texts)
                total[WORDS] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(WORDS + 1)), pa.array(total)], names=["place", "n"])

    rows = docs.select("text").mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).collect()
    total = np.zeros(WORDS + 1, np.int64)
    for r in rows:
        total[r.place] = r.n
    return int(total[WORDS]), total[:WORDS]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, per_label: int) -> tuple[DataFrame, dict[bool, int]]:
    """(doc_id, mean label, text) of the labelled sample, and the labelled documents by side of the label."""
    known = labels.filter("label is not null and doc_id is not null").filter(~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.avg(F.col("label").cast("double")).alias("label"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi").withColumn("good", F.col("label") >= 0.5)
    sizes = {r.good: r["count"] for r in known.groupBy("good").count().collect()}
    # a row is drawn where its hash, uniform in [0, 1), is below the share that is wanted
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 32)) / F.lit(float(1 << 32))
    share = F.when(F.col("good"), F.lit(per_label / sizes.get(True, 1))).otherwise(F.lit(per_label / sizes.get(False, 1)))
    few = known.filter(drawn < share).select("doc_id", "label")
    rows = docs.join(F.broadcast(few), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    return rows, sizes


class Voters(NamedTuple):
    """What a task needs: term rarity, latent directions, unit vectors, labels and weights of the labelled sample."""

    rarity: np.ndarray
    directions: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    stands_for: np.ndarray

    @property
    def prior(self) -> float:
        total = self.stands_for.sum()
        return float((self.stands_for * self.labels).sum() / total) if total else 0.5

    def scores(self, counts: np.ndarray, neighbours: int) -> np.ndarray:
        """Share of the votes for label 1, a row of counts a document."""
        out = np.full(len(counts), self.prior)
        k = min(neighbours, len(self.labels))
        if not k:
            return out
        cos = unit(weights(counts, self.rarity) @ self.directions) @ self.vectors.T
        near = np.argpartition(-cos, k - 1, axis=1)[:, :k]
        vote = np.maximum(np.take_along_axis(cos, near, 1), 0).astype(np.float64) ** SHARPNESS
        vote *= self.stands_for[near]
        total = vote.sum(axis=1)
        some = total > 1e-6
        out[some] = np.clip((vote * self.labels[near]).sum(axis=1)[some] / total[some], 0, 1)
        return out


def unit(v: np.ndarray) -> np.ndarray:
    length = np.sqrt((v * v).sum(axis=1, keepdims=True))
    return v / np.where(length > 1e-9, length, np.inf)


def latent_directions(rows: np.ndarray, k: int) -> np.ndarray:
    """Leading right singular vectors by subspace iteration; ``rows`` is the labelled sample."""
    k = min(k, *rows.shape)
    q = np.random.default_rng(0).normal(size=(rows.shape[1], min(k + 16, *rows.shape))).astype(np.float32)
    for _ in range(5):
        q, _ = np.linalg.qr(rows.T @ (rows @ q))
    _, _, v = np.linalg.svd(rows @ q, full_matrices=False)
    return np.ascontiguousarray((q @ v.T)[:, :k])


COUNTS = "doc_id long, label double, place array<int>, count array<double>"


def fit(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, latent: int = LATENT) -> Voters:
    """Fitted on the labelled sample of (doc_id, label), with word counts over all of (doc_id, text)."""
    n, df = document_counts(docs)
    rarity = np.log((n + 1) / (df + 1))
    rows, sizes = sample(docs, labels, per_label)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            for at, texts in blocks(b, 2):
                row, place = np.nonzero(c := terms.counts(texts))
                ends = pa.array(np.append(0, np.cumsum(np.bincount(row, minlength=len(texts)))), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)),
                    pa.ListArray.from_arrays(ends, pa.array(place, pa.int32())),
                    pa.ListArray.from_arrays(ends, pa.array(c[row, place]))], names=["doc_id", "label", "place", "count"])

    found = sorted(rows.mapInArrow(run, COUNTS).collect(), key=lambda r: r.doc_id)
    y = np.array([r.label for r in found])
    x = np.zeros((len(found), TERMS), np.float32)
    for i in range(0, len(found), ROWS):
        c = np.zeros((len(found[i:i + ROWS]), TERMS))
        for j, r in enumerate(found[i:i + ROWS]):
            c[j, r.place] = r["count"]
        x[i:i + ROWS] = weights(c, rarity)
    if not len(found):
        return Voters(rarity, np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), y, y)
    directions = latent_directions(x, latent)
    good = y >= 0.5
    stands = np.where(good, sizes.get(True, 0) / max(1, good.sum()), sizes.get(False, 0) / max(1, (~good).sum()))
    return Voters(rarity, directions, unit(x @ directions), y, stands)


SCORES = "doc_id long, held_out boolean, score double"


def score(docs: DataFrame, voters: Voters, neighbours: int = NEIGHBOURS) -> DataFrame:
    """doc_id, held_out, score of every row of (doc_id, held_out, text)."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for b in batches:
            for at, texts in blocks(b, 2):
                yield pa.RecordBatch.from_arrays([
                    b.column(0).slice(at, len(texts)), b.column(1).slice(at, len(texts)),
                    pa.array(sent.value.scores(terms.counts(texts), neighbours))], names=["doc_id", "held_out", "score"])

    return docs.select("doc_id", "held_out", "text").mapInArrow(run, SCORES)


def classify(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
             text_col: str = "text", per_label: int = PER_LABEL, neighbours: int = NEIGHBOURS) -> DataFrame:
    """Score and prediction of every document; labels of held-out ids are not looked at."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"),
                    F.col(text_col).alias("text"))
    known = labels.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(label_col).alias("label"))
    s = score(d, fit(d.select("doc_id", "text"), known, per_label), neighbours)
    return s.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
