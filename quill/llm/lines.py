"""Line dedup: documents probe a sharded minimal perfect hash of the repeated lines.

1. One pass over the texts gives, for each document, its distinct line keys as
   two 64-bit hashes; grouped counts (combined map-side, so a line that a third
   of all documents hold is one row a task) give the number of documents and
   the largest doc_id of every key.
2. Keys found in ``min_docs`` documents are dealt to shards of about
   ``SHARD_KEYS`` keys by their first hash.  Each shard becomes one row: the
   levels of a minimal perfect hash and, at its slots, arrays of fingerprints
   (the second hash), counts and keepers.  Keys below ``min_docs`` are told
   apart by the fingerprint, so they need no slot.
3. Line hashes are sent in blocks of about ``BLOCK_PROBES`` to copies of their
   shard (a shard with a hot line just has more blocks) and probe its arrays.
   No line text and no key is joined.
4. Documents get the positions of their dropped lines back and are rebuilt.

Defined cases: null or empty text is one empty line; lines shorter than
``min_chars`` never count; rows that share a doc_id are one document (a null
doc_id counts as one document with the smallest id); repeated rows lose the
same lines; an empty table gives an empty result.  Extra columns pass through
``dedup_rows`` untouched.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quill.llm.common import BLANKS, ascii_lower, materialise

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 4096
BLOCK_PROBES = 16384
LEVEL_LOAD = 2.0
MIX = 0x9E3779B97F4A7C15
NO_ID = -(1 << 63)


# --- minimal perfect hash -----------------------------------------------------------------------

def _slot(h: np.ndarray, level: int, size: int) -> np.ndarray:
    """Position of 64-bit hashes in a level of ``size`` bits."""
    x = h ^ np.uint64(MIX * (level + 1) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(31))) % np.uint64(size)


def build_mph(h: np.ndarray) -> list[np.ndarray]:
    """Levels of bits for distinct hashes: a key sits at the first level where it is alone in its bit.

    Its number is the count of set bits before it, so n keys get 0 .. n-1.
    """
    levels, rest = [], h
    while len(rest):
        size = max(1, int(len(rest) * LEVEL_LOAD))
        at = _slot(rest, len(levels), size).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        levels.append(alone)
        rest = rest[~alone[at]]
    return levels


def probe_mph(levels: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """Number of each hash, -1 when no level holds it; hashes never indexed may get any number."""
    out, todo, base = np.full(len(h), -1, np.int64), np.arange(len(h)), 0
    for k, bits in enumerate(levels):
        at = _slot(h[todo], k, len(bits)).astype(np.int64)
        hit = bits[at]
        out[todo[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        base += int(bits.sum())
        todo = todo[~hit]
    return out


def pack_shard(h: np.ndarray, fp: np.ndarray, n: np.ndarray, keeper: np.ndarray) -> dict:
    levels = build_mph(h)
    at = probe_mph(levels, h)
    order = np.empty(len(h), np.int64)
    order[at] = np.arange(len(h))
    return {"sizes": np.array([len(x) for x in levels], np.int64).tobytes(),
            "bits": np.packbits(np.concatenate(levels)).tobytes() if levels else b"",
            "fps": fp[order].tobytes(), "counts": n[order].astype(np.int64).tobytes(),
            "keepers": keeper[order].tobytes()}


def unpack_levels(sizes: bytes, bits: bytes) -> list[np.ndarray]:
    n = np.frombuffer(sizes, np.int64)
    flat = np.unpackbits(np.frombuffer(bits, np.uint8))[:int(n.sum())].astype(bool)
    return np.split(flat, np.cumsum(n)[:-1])


SHARD_SCHEMA = "shard long, sizes binary, bits binary, fps binary, counts binary, keepers binary"


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    row = pack_shard(pdf["h1"].to_numpy(np.int64).view(np.uint64), pdf["h2"].to_numpy(np.int64),
                     pdf["n"].to_numpy(np.int64), pdf["keeper"].to_numpy(np.int64))
    return pd.DataFrame([{"shard": pdf["shard"].iloc[0], **row}])


def _probe(lines: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
    if not len(lines) or not len(shard):
        return lines[["id", "row", "at"]].iloc[:0]
    s = shard.iloc[0]
    fps, keepers = np.frombuffer(s["fps"], np.int64), np.frombuffer(s["keepers"], np.int64)
    levels = unpack_levels(s["sizes"], s["bits"])
    slot = probe_mph(levels, lines["h1"].to_numpy(np.int64).view(np.uint64))
    ok = slot >= 0
    ok[ok] = fps[slot[ok]] == lines["h2"].to_numpy(np.int64)[ok]
    ok[ok] = keepers[slot[ok]] != lines["id"].to_numpy(np.int64)[ok]
    return lines.loc[ok, ["id", "row", "at"]]


# --- Spark side ---------------------------------------------------------------------------------

def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _row(id_col: Column, text: Column) -> list[Column]:
    """A row is known by its id and a hash of its text; equal rows share all they lose."""
    return [F.coalesce(id_col, F.lit(NO_ID)).cast("bigint").alias("id"), F.xxhash64(text).alias("row")]


def line_hashes(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(id, row, at, h1, h2) of every line that can count.

    A split is never empty, so the outer generator gives the same rows; an inner
    one would be guarded by a filter that splits each text again.
    """
    d = docs.select(*_row(F.col(id_col), F.col(text_col)),
                    F.posexplode_outer(F.split(F.coalesce(F.col(text_col), F.lit("")), "\n")).alias("at", "line"))
    d = d.withColumn("key", line_key(F.col("line"))).filter(F.length("key") >= min_chars)
    return d.select("id", "row", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), F.col("key")).alias("h2"))


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """(h1, h2, n, keeper) of the keys found in ``min_docs`` documents."""
    per_doc = lines.select("h1", "h2", "id").distinct()
    return (per_doc.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("id").alias("keeper"))
            .filter(F.col("n") >= min_docs))


def line_index(keys: DataFrame, shard_keys: int = SHARD_KEYS) -> tuple[DataFrame, int]:
    """One row of packed arrays per shard, and the number of shards."""
    n_shards = max(1, -(-keys.count() // shard_keys))
    dealt = keys.withColumn("shard", F.pmod(F.col("h1"), F.lit(n_shards)).cast("bigint"))
    return materialise(dealt.groupBy("shard").applyInPandas(_build, SHARD_SCHEMA), "line-index"), n_shards


def dropped_positions(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
                      min_docs: int = MIN_DOCS) -> DataFrame:
    """(id, row, drop): positions of the lines a document row loses."""
    lines = materialise(line_hashes(docs, id_col, text_col, min_chars), "line-hashes")
    keys = materialise(repeated_keys(lines, min_docs), "line-keys")
    index, n_shards = line_index(keys)
    lines = lines.withColumn("shard", F.pmod(F.col("h1"), F.lit(n_shards)).cast("bigint"))
    # one row per shard (a few thousandths of the keys): the number of blocks its probes are cut into
    blocks = materialise(lines.groupBy("shard").agg(
        F.ceil(F.count("*") / BLOCK_PROBES).cast("bigint").alias("blocks")), "line-blocks")
    probes = lines.join(blocks, "shard").withColumn("block", F.pmod(F.xxhash64("id", "row", "at"), "blocks"))
    copies = index.join(blocks, "shard").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    hits = (probes.select("shard", "block", "id", "row", "at", "h1", "h2").groupBy("shard", "block")
            .cogroup(copies.drop("blocks").groupBy("shard", "block")).applyInPandas(_probe, "id long, row long, at int"))
    return hits.groupBy("id", "row").agg(F.collect_set("at").alias("drop"))


def marked(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """``_q_doc`` (all columns), ``_q_text`` and ``_q_drop`` (positions or null) of every row."""
    gone = dropped_positions(docs, id_col, text_col, min_chars, min_docs)
    d = docs.select(F.struct(*docs.columns).alias("_q_doc"))
    d = d.select(*_row(F.col("_q_doc")[id_col], F.col("_q_doc")[text_col]), "_q_doc").join(gone, ["id", "row"], "left")
    return d.select("_q_doc", F.col("_q_doc")[text_col].alias("_q_text"), F.col("drop").alias("_q_drop"))


def kept_text(text: Column, drop: Column) -> Column:
    """The text without the lines at the positions ``drop``."""
    @F.pandas_udf("string")
    def rebuild(t: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([x if g is None or x is None else "\n".join(
            line for i, line in enumerate(x.split("\n")) if i not in s)
            for x, g in zip(t, d, strict=True) for s in [set() if g is None else set(g.tolist())]], dtype=object)
    return rebuild(text, drop)


def dedup_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with the repeated lines gone from ``text_col``; all columns and rows stay."""
    d = marked(docs, id_col, text_col, min_chars, min_docs)
    text = kept_text(F.col("_q_text"), F.col("_q_drop"))
    return d.select("_q_doc", text.alias("_q_text")).select(
        *[F.col("_q_text").alias(c) if c == text_col else F.col("_q_doc")[c].alias(c) for c in docs.columns])


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS) -> DataFrame:
    """doc_id, n_lines, n_dropped and kept_sha256 of every row."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    d = marked(docs, "doc_id", "text", min_chars, min_docs)

    text = F.coalesce(F.col("_q_text"), F.lit(""))
    kept = F.coalesce(kept_text(F.col("_q_text"), F.col("_q_drop")), F.lit(""))
    return d.select(
        F.col("_q_doc")["doc_id"].alias("doc_id"),
        (F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).cast("bigint").alias("n_lines"),
        F.coalesce(F.size("_q_drop"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.sha2(F.encode(kept, "UTF-8"), 256).alias("kept_sha256"))
