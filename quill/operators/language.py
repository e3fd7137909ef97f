"""Language detection (T9): multinomial naive Bayes over character trigrams, trained from labelled texts.

The words of a text (runs of letters, lower-cased, a blank before and after)
give one trigram a letter.  Training counts trigrams by language, combined in
each task and then by Spark; the ``most`` trigrams by total count are the model,
the same size whatever the corpus.  A task scores whole batches: the trigrams of
all texts are numbers made of three code points, found in the model by binary
search, and their log weights are added up by text.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.functions.batches import short_batches

TRIGRAMS = 50_000
SMOOTHING = 0.5
# Distinct trigrams a task counts before it hands them on.
FLUSH = 1 << 20
BITS = 21


def trigrams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code) of every trigram."""
    import regex
    word = regex.compile(r"\p{L}+")
    padded = [" " + " ".join(word.findall(t.lower())) + " " if t else "" for t in texts]
    sizes = np.array([len(p) for p in padded], np.int64)
    cp = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    of = np.repeat(np.arange(len(texts)), sizes)
    if len(cp) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    # three characters of one text around a letter; blanks between words count once for each side
    ok = (of[2:] == of[:-2]) & (cp[1:-1] != 32)
    code = (cp[:-2] << 2 * BITS) | (cp[1:-1] << BITS) | cp[2:]
    return of[1:-1][ok], code[ok]


def code_text(code: int) -> str:
    return "".join(chr((code >> BITS * k) & ((1 << BITS) - 1)) for k in (2, 1, 0))


class Model(NamedTuple):
    """Languages in order, sorted trigram codes, log weights (trigram, language), that of an unknown trigram, priors."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    unknown: np.ndarray
    prior: np.ndarray

    def scores(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(log probability of each text and language up to a constant, number of trigrams)."""
        of, code = trigrams(texts)
        n = np.bincount(of, minlength=len(texts))
        out = np.tile(self.prior, (len(texts), 1))
        at = np.minimum(np.searchsorted(self.codes, code), max(len(self.codes) - 1, 0))
        known = self.codes[at] == code if len(self.codes) else np.zeros(len(code), bool)
        for k in range(len(self.languages)):
            w = np.where(known, self.weights[at, k], self.unknown[k]) if len(self.codes) else np.full(len(code), self.unknown[k])
            out[:, k] += np.bincount(of, w, len(texts))
        return out, n


def trigram_counts(docs: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, code, n): trigrams of the labelled texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, dict[int, int]] = {}

        def rows() -> pa.RecordBatch:
            flat = [(x, c, n) for x, own in counts.items() for c, n in own.items()]
            counts.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(
                zip(*flat, strict=True), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["lang", "code", "n"])

        for b in short_batches(batches, 1):
            of, code = trigrams(b.column(1).to_pylist())
            names = np.array(b.column(0).to_pylist(), object)
            for x in sorted(set(names)):
                got, n = np.unique(code[(names == x)[of]], return_counts=True)
                own = counts.setdefault(x, {})
                for c, k in zip(got.tolist(), n.tolist(), strict=True):
                    own[c] = own.get(c, 0) + k
            if sum(map(len, counts.values())) > FLUSH:
                yield rows()
        if any(counts.values()):
            yield rows()

    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    return known.mapInArrow(run, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))


def train(docs: DataFrame, text: str, lang: str, most: int = TRIGRAMS, smoothing: float = SMOOTHING) -> Model:
    """The model of the texts whose ``lang`` is known: trigram counts plus ``smoothing``, and document shares."""
    from quill.session import staged
    counts = staged(trigram_counts(docs, text, lang), "trigrams")
    top = counts.groupBy("code").agg(F.sum("n").alias("all")).orderBy(F.desc("all"), F.asc("code")).limit(most)
    rows = counts.join(top, "code").select("lang", "code", "n").collect()
    share = {r["lang"]: r["count"] for r in docs.filter(F.col(text).isNotNull()).groupBy(F.col(lang).alias("lang")).count().collect()}
    languages = sorted(x for x in share if x is not None)
    codes = np.array(sorted({r["code"] for r in rows}), np.int64)
    n = np.zeros((len(codes), len(languages)))
    number = {x: k for k, x in enumerate(languages)}
    for r in rows:
        n[np.searchsorted(codes, r["code"]), number[r["lang"]]] = r["n"]
    total = np.log(n.sum(axis=0) + smoothing * (len(codes) + 1))
    prior = np.log(np.array([share[x] for x in languages], float) / max(1, sum(share[x] for x in languages)))
    return Model(languages, codes, np.log(n + smoothing) - total, np.log(smoothing) - total, prior)


def held_out(key: Column) -> Column:
    """Three sixteenths of the keys, by hash; training leaves them out."""
    return F.substring(F.md5(key.cast("string")), 1, 1).isin("0", "1", "2")


def detect(docs: DataFrame, key: str, text: str, model: Model) -> DataFrame:
    """(key, detected): the likeliest language (the first by name on ties); NULL for texts without letters."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in short_batches(batches, 1):
            score, n = m.scores(b.column(1).to_pylist())
            best = [m.languages[i] if k else None for i, k in zip(score.argmax(axis=1).tolist(), n.tolist(), strict=True)] if m.languages \
                else [None] * b.num_rows
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(best, pa.string())], names=["key", "detected"])

    kind = docs.schema[key].dataType.simpleString()
    out = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, detected string")
    return out.withColumnRenamed("key", key)
