"""Document fingerprints by consistent weighted sampling.

A document is the multiset of its words.  For every sample k a word S of
weight w draws, from its own hash, r and c from Gamma(2, 1) and b from U(0, 1):

    t = floor(ln w / r + b),   ln a = ln c - r (t - b) - r

and the document's sample is the (S, t) of the smallest a.  Two documents have
the same sample with the probability of their generalised Jaccard similarity
(sum of smaller weights over sum of larger ones).  The draws depend on
(S, w, k) alone, so a task computes them once for each distinct (word, weight)
of a run of texts, and the smallest values of all texts by segmented minima.

A fingerprint is ``SAMPLES`` times 16 bits of hash, in hexadecimal digits;
likeness is the share of equal samples (two texts without words: 1, one: 0).

The next document by doc_id is found without gathering or self-joining texts:
quantiles of doc_id (existing ids) cut the table into blocks, every text goes
to its block once, the first document of a block is sent to the block before
as well, and each block is read in order.

Defined cases: null text is empty; a text without words has the fingerprint of
all zeros; a null doc_id sorts last; of equal doc_ids the smaller text comes
first, and rows equal in both follow each other; a single document is its own
next; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLES = 64
BLOCK_ROWS, MOST_BLOCKS = 1024, 1 << 16
TABLE_ROWS, GATHER_ROWS, CHUNK_CHARS = 1 << 18, 1 << 15, 1 << 22
# Rows of a buffer that stays in a core's cache.
KEY_ROWS, TAKE_ROWS = 256, 1 << 12
LAST = (1 << 63) - 1
STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray, spare: np.ndarray) -> None:
    """Mixes 64-bit numbers in place."""
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, None)):
        np.right_shift(x, np.uint64(shift), out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor:
            np.multiply(x, np.uint64(factor), out=x)


def _uniform(half: np.ndarray, out: np.ndarray) -> None:
    """Uniforms in (0, 1) from 32-bit halves of hashes."""
    np.add(half, 0.5, out=out)
    np.multiply(out, 2.0 ** -32, out=out)


def _log_product(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """``a``: minus the logarithm of the product of the two uniforms of each hash; ``b`` is spare."""
    halves = x.view(np.uint32).reshape(*x.shape, 2)
    _uniform(halves[..., 1], a)
    _uniform(halves[..., 0], b)
    np.multiply(a, b, out=a)
    np.log(a, out=a)
    np.negative(a, out=a)


def sample_keys(term: np.ndarray, weight: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """For each (term hash, weight) and sample a 64-bit key: ln a in sortable form, then 32 bits of hash of (term, t).

    Works on ``KEY_ROWS`` rows at a time, in buffers that stay in a core's cache.
    """
    out = np.empty((len(term), samples), np.uint64)
    k = np.arange(1, samples + 1, dtype=np.uint64) * STEP
    log_w = np.log(weight.astype(np.float64))[:, None]
    numbers = [np.empty((KEY_ROWS, samples), np.uint64) for _ in range(2)]
    reals = [np.empty((KEY_ROWS, samples)) for _ in range(4)]
    for i in range(0, len(term), KEY_ROWS):
        rows = slice(i, i + KEY_ROWS)
        n = len(term[rows])
        x, spare = (v[:n] for v in numbers)
        r, c, b, t = (v[:n] for v in reals)
        np.add(term[rows, None], k, out=x)
        _mix(x, spare)
        _log_product(x, r, t)
        np.add(x, STEP, out=x)
        _mix(x, spare)
        _log_product(x, c, t)
        np.log(c, out=c)
        np.add(x, STEP, out=x)
        _mix(x, spare)
        _uniform(x.view(np.uint32).reshape(n, samples, 2)[..., 1], b)
        np.divide(log_w[rows], r, out=t)
        np.add(t, b, out=t)
        np.floor(t, out=t)
        np.subtract(t, b, out=b)
        np.multiply(r, b, out=b)
        np.subtract(c, b, out=c)
        np.subtract(c, r, out=c)
        np.multiply(t.astype(np.int64).view(np.uint64), STEP, out=spare)
        np.bitwise_xor(x, spare, out=x)
        _mix(x, spare)
        bits = c.astype(np.float32).view(np.uint32)
        halves = out[rows].view(np.uint32).reshape(n, samples, 2)
        halves[..., 1] = bits ^ ((bits.view(np.int32) >> 31).view(np.uint32) | np.uint32(1 << 31))
        halves[..., 0] = x.view(np.uint32).reshape(n, samples, 2)[..., 1]
    return out


def _numbered(term: np.ndarray, weight: np.ndarray, terms: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct (term, weight) as two columns, and the place of each pair among them; most weights are 1."""
    single = weight == 1
    seen = np.zeros(terms, bool)
    seen[term[single]] = True
    ones = np.flatnonzero(seen)
    at = (np.cumsum(seen) - 1)[term]
    base = int(weight.max()) + 1
    pairs, place = np.unique(term[~single] * base + weight[~single], return_inverse=True)
    at[~single] = place + len(ones)
    return np.concatenate([ones, pairs // base]), np.concatenate([np.ones(len(ones), np.int64), pairs % base]), at


def _signatures(raw: list[bytes], samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Samples of each UTF-8 text, and its number of distinct words."""
    bags = [Counter(t.split()) for t in raw]
    size = np.fromiter(map(len, bags), np.int64, len(bags))
    total = int(size.sum())
    sig = np.zeros((len(raw), samples), np.uint16)
    if not total:
        return sig, size
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    term = np.fromiter(map(number.__getitem__, chain.from_iterable(bags)), np.int64, total)
    weight = np.fromiter(chain.from_iterable(b.values() for b in bags), np.int64, total)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, number), np.uint64, len(number))
    pair_term, pair_weight, at = _numbered(term, weight, len(number))
    ends = np.cumsum(size)
    table = sample_keys(hashes[pair_term], pair_weight, samples) if len(pair_term) <= TABLE_ROWS else None
    filled = np.flatnonzero(size)
    cut = np.flatnonzero(np.diff((ends[filled] - 1) // (GATHER_ROWS if table is None else TAKE_ROWS))) + 1
    for run in np.split(filled, cut):
        lo, hi = ends[run[0]] - size[run[0]], ends[run[-1]]
        part = at[lo:hi]
        if table is None:
            own, part = np.unique(part, return_inverse=True)
            keys = sample_keys(hashes[pair_term[own]], pair_weight[own], samples)[part]
        else:
            keys = table[part]
        low = np.minimum.reduceat(keys, ends[run] - size[run] - lo, axis=0)
        sig[run] = (low & np.uint64(0xFFFF)).astype(np.uint16)
    return sig, size


def signatures(texts: list[str | None], samples: int = SAMPLES) -> np.ndarray:
    """Samples of each text as 16-bit values, a row a text; texts without words get zeros."""
    return _signatures([(t or "").encode("utf-8", "replace") for t in texts], samples)[0]


def likeness(a: np.ndarray, b: np.ndarray, words_a: np.ndarray, words_b: np.ndarray) -> np.ndarray:
    """Share of equal samples, row by row; the flags tell which texts have words."""
    share = (a == b).mean(axis=1)
    return np.where(words_a & words_b, share, (words_a == words_b).astype(float))


def edited_text(text: str, following: str) -> str:
    """The last quarter of the code points replaced by as many first ones of the following text."""
    q = len(text) // 4
    return text[:len(text) - q] + following[:q]


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                   ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                   ("near_next", pa.float64())])


def _hex(sig: np.ndarray) -> list[str]:
    return [row.astype(">u2").tobytes().hex() for row in sig]


def _compare(ids: list, texts: list[str], samples: int) -> pa.RecordBatch:
    """Result rows of all texts but the last, each followed by the next one."""
    n = len(texts) - 1
    edited = [edited_text(texts[i], texts[i + 1]) for i in range(n)]
    raw = [t.encode("utf-8", "replace") for t in texts + edited]
    sig, n_words = _signatures(raw, samples)
    has = n_words > 0
    own, nxt, edt = sig[:n], sig[1:n + 1], sig[n + 1:]
    return pa.RecordBatch.from_arrays([
        pa.array(ids[:n], pa.int64()), pa.array([len(t) for t in texts[:n]], pa.int64()),
        pa.array([hashlib.sha256(t).hexdigest() for t in raw[n + 1:]], pa.string()),
        pa.array(_hex(own), pa.string()), pa.array(_hex(edt), pa.string()),
        pa.array(likeness(own, edt, has[:n], has[n + 1:])), pa.array(likeness(own, nxt, has[:n], has[1:n + 1]))],
        schema=ARROW)


def _walk(batches: Iterator[pa.RecordBatch], samples: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (block, guest, id, text); a guest is the first row after its block."""
    ids: list = []
    texts: list[str] = []
    at, chars, done = None, 0, True
    for b in batches:
        for block, guest, doc_id, text in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
            if block != at:
                at, ids, texts, chars, done = block, [], [], 0, False
            if done:
                continue
            ids.append(doc_id)
            texts.append(text)
            chars += len(text)
            done = guest
            if len(texts) > 1 and (done or chars >= CHUNK_CHARS):
                yield _compare(ids, texts, samples)
                ids, texts, chars = ids[-1:], texts[-1:], len(texts[-1])


def block_of(sort_id: Column, bounds: list[int]) -> Column:
    """Number of bounds at or below the id."""
    edges = np.array(bounds, np.int64)

    @F.pandas_udf("long")
    def find(s: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(edges, s.to_numpy(np.int64), "right").astype(np.int64))
    return find(sort_id)


def weighted_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                          samples: int = SAMPLES) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likenesses, one row a row of ``docs``."""
    d = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.withColumn("_q_id", F.coalesce("doc_id", F.lit(LAST)))
    # bounds: at most MOST_BLOCKS existing ids, whatever the table's size
    stats = d.agg(F.count("*").alias("n"), F.min("_q_id").alias("low")).first()
    blocks = min(MOST_BLOCKS, -(-stats["n"] // BLOCK_ROWS))
    bounds: list[int] = []
    if blocks > 1:
        cuts = F.lit([i / blocks for i in range(1, blocks)])
        found = d.agg(F.percentile_approx("_q_id", cuts, max(10_000, 8 * blocks))).first()[0]
        bounds = sorted({x for x in found if x > stats["low"]})
    d = d.withColumn("_q_block", block_of(F.col("_q_id"), bounds))
    # a block's first document is also a guest of the block before; the very first one of the last block
    before = (F.when(F.col("_q_id") == stats["low"], F.lit(len(bounds)))
              .when(block_of(F.col("_q_id") - 1, bounds) < F.col("_q_block"), F.col("_q_block") - 1))
    places = F.array_compact(F.array(
        F.struct(F.col("_q_block").alias("block"), F.lit(False).alias("guest")),
        F.when(before.isNotNull(), F.struct(before.cast("bigint").alias("block"), F.lit(True).alias("guest")))))
    d = d.withColumn("_q_place", F.explode(places))
    d = (d.select(F.col("_q_place")["block"].alias("block"), F.col("_q_place")["guest"].alias("guest"), "doc_id",
                  "text", "_q_id").repartition(len(bounds) + 1, "block").sortWithinPartitions("block", "guest", "_q_id", "text"))
    return d.select("block", "guest", "doc_id", "text").mapInArrow(lambda it: _walk(it, samples), SCHEMA)
