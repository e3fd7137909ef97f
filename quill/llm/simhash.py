"""SimHash near-dedup with BK-trees.

Fingerprints are computed once and reduced to distinct values, so copies, from
two to a third of the table, are one node.  A distinct fingerprint is cut into
six blocks; two that differ in at most four bits agree in two whole blocks, so
each is dealt to the 15 shards of its block pairs and meets every partner in at
least one.  A shard's BK-tree has children keyed by their integer Hamming
distance to the parent, and a search follows only the edges within the radius
of the distance found.

Broadcasting shard trees to every task would grow with the corpus; here the
tree and the queries of a shard travel to the same task instead.  A shard above
``TREE_NODES`` is cut into that many-node trees, and each tree is copied to one
task for every equally sized part of the shard's queries, so no task grows with
a group.  Trees of a task are searched level by level as one forest of arrays.

A tree reports a spanning forest of the links it finds, never all pairs; the
links go through distributed connected components.

Defined cases: null, empty or blank text has fingerprint zero and links like
any other; fewer words than a shingle make one shingle; rows with equal ids are
separate rows with one text each; null ids never become a component id unless
a component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.llm.common import connected_components, materialise

SHINGLE, MAX_BITS, SEED = 4, 4, 42
BLOCKS = (11, 11, 11, 11, 10, 10)
TREE_NODES = 16384
SEARCH_CELLS = 1 << 22
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit fingerprint: a bit is 1 when set in over half the shingle hashes."""
    words = (text or "").encode("utf-8", "replace").translate(LOWER).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(shingle, len(words))
    spans = zip(starts[:len(words) - k + 1].tolist(), ends[k - 1:].tolist(), strict=True)
    h = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], dtype=">u8")
    ones = np.zeros(64, np.int64)
    for i in range(0, len(h), 8192):
        ones += np.unpackbits(h[i:i + 8192].view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(h)).tobytes(), "big")


def fingerprint(text: Column, shingle: int = SHINGLE) -> Column:
    """``simhash`` as a signed long column."""
    @F.pandas_udf("long")
    def prints(s: pd.Series) -> pd.Series:
        return pd.Series(np.array([simhash(t, shingle) for t in s], dtype=np.uint64).view(np.int64))
    return prints(text)


# --- BK-forest ----------------------------------------------------------------------------------

def bk_forest(x: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent (-1: root) and edge of every element; ``group`` is sorted, one tree for each value.

    Level by level: the first element of a cell becomes a node, the others fall
    into child cells by their Hamming distance to it.
    """
    n = len(x)
    parent, edge = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    todo = np.arange(n)
    cell = group.astype(np.int64)
    up, key = np.full(n, -1, np.int64), np.zeros(n, np.int64)
    while len(todo):
        first = np.ones(len(todo), bool)
        first[1:] = cell[1:] != cell[:-1]
        parent[todo[first]], edge[todo[first]] = up[first], key[first]
        node = todo[first][np.cumsum(first) - 1]
        rest = ~first
        todo, up = todo[rest], node[rest]
        key = np.bitwise_count(x[todo] ^ x[up]).astype(np.int64)
        cell = up * 65 + key
        order = np.argsort(cell, kind="stable")
        todo, up, key, cell = todo[order], up[order], key[order], cell[order]
    return parent, edge


def bk_links(x: np.ndarray, group: np.ndarray, parent: np.ndarray, edge: np.ndarray, q: np.ndarray,
             q_group: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query, node) index pairs within ``radius``, searching each query in the tree of its group."""
    at = np.flatnonzero(parent >= 0)
    at = at[np.argsort(parent[at] * 65 + edge[at], kind="stable")]
    keys = parent[at] * 65 + edge[at]
    roots = np.flatnonzero(parent < 0)
    root_of = np.searchsorted(group[roots], q_group)
    # queries are taken in blocks whose trees hold SEARCH_CELLS nodes together, which bounds the frontier
    cost = np.cumsum(np.diff(np.append(roots, len(x)))[root_of]) // SEARCH_CELLS
    for who in np.split(np.arange(len(q)), np.flatnonzero(np.diff(cost)) + 1):
        node = roots[root_of[who]]
        while len(who):
            d = np.bitwise_count(q[who] ^ x[node]).astype(np.int64)
            near = d <= radius
            yield who[near], node[near]
            a = np.searchsorted(keys, node * 65 + np.maximum(d - radius, 0), "left")
            b = np.searchsorted(keys, node * 65 + np.minimum(d + radius, 64), "right")
            n = b - a
            who = np.repeat(who, n)
            node = at[np.repeat(a - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(int(n.sum()))]


def spanning(n: int, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Root of each of ``n`` elements under the pairs: the smallest index of its component."""
    root = np.arange(n)
    for a, b in pairs:
        while True:
            ra, rb = root[a], root[b]
            if (ra == rb).all():
                break
            hi, lo = np.maximum(ra, rb), np.minimum(ra, rb)
            np.minimum.at(root, hi, lo)
            while (root[root] != root).any():
                root = root[root]
    return root


def _search(frames: Iterator[pd.DataFrame], radius: int) -> Iterator[pd.DataFrame]:
    """Rows come sorted by (shard, tree, part); whole groups are searched together, a bounded number at once."""
    held: list[pd.DataFrame] = []
    rows = 0
    for f in itertools.chain(frames, [None]):
        if f is not None:
            if not len(f):
                continue
            held.append(f)
            rows += len(f)
            if rows < 4 * TREE_NODES:
                continue
        if not held:
            break
        pdf = pd.concat(held, ignore_index=True)
        k = pdf[["shard", "tree", "part"]].to_numpy(np.int64)
        new = np.ones(len(k), bool)
        new[1:] = (k[1:] != k[:-1]).any(1)
        # the last group may go on in the next frame
        stop = len(k) if f is None else int(np.flatnonzero(new)[-1])
        held, rows = [pdf.iloc[stop:]], len(k) - stop
        if stop:
            yield _links(pdf.iloc[:stop], (np.cumsum(new) - 1)[:stop], radius)


def _links(pdf: pd.DataFrame, group: np.ndarray, radius: int) -> pd.DataFrame:
    fp = pdf["fp"].to_numpy(np.int64)
    size = np.bincount(group)
    inner = pdf["inner"].to_numpy(bool)
    asks = ~inner | (pdf["tree"].to_numpy() == pdf["part"].to_numpy())
    live = np.flatnonzero(size[group] > 1)
    fp, group, inner, asks = fp[live], group[live], inner[live], asks[live]
    t = np.flatnonzero(inner)  # the nodes of the trees
    x, xg = fp[t].view(np.uint64), group[t]
    qi = np.flatnonzero(asks & np.isin(group, xg))
    parent, edge = bk_forest(x, xg)
    links = ((qi[a], t[b]) for a, b in bk_links(x, xg, parent, edge, fp[qi].view(np.uint64), group[qi], radius))
    root = spanning(len(fp), links)
    out = np.flatnonzero(root != np.arange(len(fp)))
    return pd.DataFrame({"u": fp[out], "v": fp[root[out]]})


# --- Spark side ---------------------------------------------------------------------------------

def shard_rows(prints: DataFrame) -> DataFrame:
    """Each fingerprint once for every pair of its six blocks."""
    bits, low = [], 0
    for w in BLOCKS:
        bits.append(F.shiftrightunsigned("fp", low).bitwiseAND(F.lit((1 << w) - 1)))
        low += w
    pairs = list(itertools.combinations(range(len(BLOCKS)), 2))
    shards = [F.lit(n << 22).cast("bigint") + F.shiftleft(bits[i], 11) + bits[j] for n, (i, j) in enumerate(pairs)]
    return prints.select("fp", F.explode(F.array(*shards)).alias("shard"))


def near_links(prints: DataFrame, radius: int = MAX_BITS, tree_nodes: int = TREE_NODES) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (column ``fp``) within ``radius`` bits.

    The six blocks give whole results for a radius of four at most.
    """
    if radius > len(BLOCKS) - 2:
        raise ValueError(f"radius {radius}: six blocks cover {len(BLOCKS) - 2} bits")
    rows = shard_rows(prints)
    large = materialise(rows.groupBy("shard").agg(F.count("*").alias("n")).filter(F.col("n") > tree_nodes)
                        .select("shard", F.ceil(F.col("n") / tree_nodes).cast("bigint").alias("trees")), "large-shards")
    rows = rows.join(large, "shard", "left").withColumn("trees", F.coalesce("trees", F.lit(1)))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp"), F.col("trees")))
    # tree i meets part j once for i <= j: its own part as nodes and queries, later parts as queries
    meets = F.concat(
        F.transform(F.sequence(F.lit(0).cast("bigint"), F.col("own")), lambda i: F.struct(
            i.alias("tree"), F.col("own").alias("part"), (i == F.col("own")).alias("inner"))),
        F.filter(F.transform(F.sequence(F.col("own"), F.col("trees") - 1), lambda j: F.struct(
            F.col("own").alias("tree"), j.alias("part"), F.lit(True).alias("inner"))), lambda m: m["part"] > F.col("own")))
    rows = rows.select("fp", "shard", F.explode(meets).alias("m")).select("fp", "shard", "m.*")
    dealt = rows.repartition("shard", "tree", "part").sortWithinPartitions("shard", "tree", "part")
    return dealt.mapInPandas(lambda it: _search(it, radius), "u long, v long")


def components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               radius: int = MAX_BITS) -> tuple[DataFrame, DataFrame]:
    """Written table (doc_id, _q_text, fp) of all rows, and (fp, component_id) of all distinct fingerprints."""
    prints = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("_q_text"),
                         fingerprint(F.col(text_col), shingle).alias("fp"))
    prints = materialise(prints, "simhash")
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    nodes = connected_components(near_links(distinct.select("fp"), radius))
    named = distinct.join(nodes, distinct["fp"] == nodes["node"], "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("low").alias("component_id"))
    return prints, named.join(lowest, "root").select("fp", "root", "component_id")


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
               radius: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id and the hash of the text, for every row."""
    prints, named = components(docs, id_col, text_col, shingle, radius)
    return prints.join(named, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id", "_q_text")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
             radius: int = MAX_BITS) -> DataFrame:
    """One row of each component with all its columns: that of the smallest doc_id, then text hash.

    Rows equal in id and text are one row.  Only the (id, text hash) of the kept rows meets the texts.
    """
    prints, named = components(docs, id_col, text_col, shingle, radius)
    no_id = F.lit((1 << 63) - 1)
    rows = prints.join(named, "fp").withColumn("_q_id", F.coalesce("doc_id", no_id))
    kept = rows.groupBy("root").agg(F.min(F.struct("_q_id", "_q_text")).alias("_q_first")).select("_q_first.*")
    d = docs.select(F.struct(*docs.columns).alias("_q_doc"))
    d = d.select(F.coalesce(F.col("_q_doc")[id_col].cast("bigint"), no_id).alias("_q_id"),
                 F.xxhash64(F.col("_q_doc")[text_col]).alias("_q_text"), "_q_doc")
    d = d.join(kept, ["_q_id", "_q_text"])
    once = Window.partitionBy("_q_id", "_q_text").orderBy(F.lit(0))
    d = d.withColumn("_q_no", F.row_number().over(once)).filter("_q_no = 1")
    return d.select("_q_doc.*")
