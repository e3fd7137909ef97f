"""Merkle manifest of a dataset: a leaf a row, a tree of eight-way parents a group, one root over the groups.

A parent keeps a copy of its SHA-256 state before each child slot.  Folding a
changed child resumes the copy of its slot with the new digest and the
siblings to its right; what lies to the left is never hashed again.

A tree is built in blocks of ``8**STRIDE`` consecutive nodes.  The leaves are
ordered by a range sort and numbered without a window over a group, a task
turns each block into one node, and the same step is repeated on the blocks'
nodes until a group has one.  Then every block of leaves gets the siblings of
its ancestors as one row beside its leaves, rebuilds its parents and folds
each of its leaves up to the root.  A group of any size is many blocks, and a
task holds one block at a time.

Defined cases: a null field is hashed as ``-``; leaves ascend by doc_id, a null
doc_id first, equal ones by leaf; equal rows are leaves of their own and follow
each other; a null lang is the first group; a null doc_id is never tampered
with; a table of one row has its leaf as subroot and root and the digest of no
sibling as proof; an empty table gives an empty result.  Other columns are
neither hashed nor returned.  A long text is hashed whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quill.llm import common

ARITY, STRIDE = 8, 4
BLOCK = ARITY ** STRIDE
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TOP = "all"
OUT_ROWS = 4096


def field(c: Column) -> Column:
    """``-`` for null, else the number of UTF-8 bytes, a colon and the value."""
    s = c.cast("string")
    return F.when(s.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s))


def leaf(*cols: Column) -> Column:
    return F.sha2(F.concat(*map(field, cols)).cast("binary"), 256)


def depth(n: int) -> int:
    """Levels of parents above ``n`` nodes."""
    d = 0
    while n > 1:
        n, d = -(-n // ARITY), d + 1
    return d


class Parent:
    """Digest over the children's digests, with the state before each slot."""

    __slots__ = ("children", "digest", "states")

    def __init__(self, children: Sequence[str]) -> None:
        h, self.children, self.states = hashlib.sha256(), children, []
        for c in children:
            self.states.append(h.copy())
            h.update(c.encode())
        self.digest = h.hexdigest()

    def fold(self, slot: int, digest: str) -> str:
        """Digest with another child in ``slot``."""
        h = self.states[slot].copy()
        h.update("".join((digest, *self.children[slot + 1:])).encode())
        return h.hexdigest()

    def siblings(self, slot: int) -> list[str]:
        return [*self.children[:slot], *self.children[slot + 1:]]


def parents(nodes: Sequence[str], levels: int) -> list[list[Parent]]:
    """``levels`` levels of parents over consecutive nodes."""
    out, row = [], nodes
    for _ in range(levels):
        out.append([Parent(row[i:i + ARITY]) for i in range(0, len(row), ARITY)])
        row = [p.digest for p in out[-1]]
    return out


def numbered(df: DataFrame, group: str, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with ``_q_pos`` (from 0, in ``order`` within ``group``) and ``_q_n`` (rows of the group).

    A range sort with a last key of its own, so that equal rows spread too; the place in the written
    partition gives the number.  Only a row for each group and partition is windowed.
    """
    d = df.withColumn("_q_tie", F.monotonically_increasing_id())
    keys = [group, *order, "_q_tie"]
    d = d.repartitionByRange(common.shuffle_partitions(df.sparkSession), *keys).sortWithinPartitions(*keys)
    d = common.materialise(d.drop("_q_tie").withColumn("_q_at", F.monotonically_increasing_id()), name)
    d = d.withColumn("_q_part", F.shiftright("_q_at", 33))
    parts = d.groupBy(group, "_q_part").agg(F.min("_q_at").alias("_q_low"), F.count("*").alias("_q_rows"))
    w = Window.partitionBy(group)
    before = F.coalesce(F.sum("_q_rows").over(w.orderBy("_q_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = parts.select(group, "_q_part", (F.col("_q_low") - before).alias("_q_off"), F.sum("_q_rows").over(w).alias("_q_n"))
    return (d.join(parts, [group, "_q_part"]).withColumn("_q_pos", F.col("_q_at") - F.col("_q_off"))
            .drop("_q_at", "_q_part", "_q_off"))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[list[dict]]:
    """Rows sorted by (g, block, pos) in lists, one for each block."""
    rows: list[dict] = []
    for b in batches:
        for r in b.to_pylist():
            if rows and (r["g"], r["block"]) != (rows[0]["g"], rows[0]["block"]):
                yield rows
                rows = []
            rows.append(r)
    if rows:
        yield rows


def by_block(nodes: DataFrame) -> DataFrame:
    return nodes.repartition("g", "block").sortWithinPartitions("g", "block", "pos")


NODES = "g string, pos long, n long, digest string"
PATHS = "g string, pos long, path array<struct<`left`: string, `right`: string>>"
PATH_TYPE = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def _block_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The node of each block."""
    out: list[tuple] = []
    for rows in blocks(batches):
        digests, n = [r["digest"] for r in rows], rows[0]["n"]
        levels = parents(digests, min(STRIDE, depth(n)))
        out.append((rows[0]["g"], rows[0]["block"], -(-n // BLOCK), levels[-1][0].digest if levels else digests[0]))
        if len(out) >= OUT_ROWS:
            yield _batch(out, ("g", "pos", "n", "digest"), (pa.string(), pa.int64(), pa.int64(), pa.string()))
            out = []
    if out:
        yield _batch(out, ("g", "pos", "n", "digest"), (pa.string(), pa.int64(), pa.int64(), pa.string()))


def _block_paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each node of a block the siblings on its way to the block's node, level by level."""
    for rows in blocks(batches):
        levels = parents([r["digest"] for r in rows], min(STRIDE, depth(rows[0]["n"])))
        out = []
        for i, r in enumerate(rows):
            path = []
            for level in levels:
                p, slot = level[i // ARITY], i % ARITY
                path.append({"left": "".join(p.children[:slot]), "right": "".join(p.children[slot + 1:])})
                i //= ARITY
            out.append((r["g"], r["pos"], path))
        for k in range(0, len(out), 512):
            yield _batch(out[k:k + 512], ("g", "pos", "path"), (pa.string(), pa.int64(), PATH_TYPE))


def _batch(rows: list[tuple], names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)],
                                      names=list(names))


def _split(nodes: DataFrame) -> DataFrame:
    return by_block(nodes.select("g", F.expr(f"pos div {BLOCK}").alias("block"), "pos", "n", "digest"))


def climb(nodes: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
    """(paths of the nodes to the last node of their group, the last nodes (g, digest)).

    Each step replaces a block of nodes by one; the number of steps is the logarithm of the largest
    group to the base of a block.
    """
    paths = nodes.select("g", "pos", F.col("pos").alias("up"), F.from_json(F.lit("[]"), PATHS.partition("path ")[2]).alias("path"))
    step = 0
    while (nodes.agg(F.max("n")).first()[0] or 0) > 1:
        part = _split(nodes)
        own = part.mapInArrow(_block_paths, PATHS).select("g", F.col("pos").alias("up"), F.col("path").alias("more"))
        paths = paths.join(own, ["g", "up"]).select(
            "g", "pos", F.expr(f"up div {BLOCK}").alias("up"), F.concat("path", "more").alias("path"))
        nodes = common.materialise(part.mapInArrow(_block_nodes, NODES), f"{name}-{step}")
        step += 1
    return paths.select("g", "pos", "path"), nodes.select("g", "digest")


RESULT = [("doc_id", pa.int64()), ("leaf", pa.string()), ("subroot", pa.string()), ("root", pa.string()),
          ("proof_sha256", pa.string()), ("folded_root", pa.string()), ("verified", pa.bool_())]
PROOF = ("proof", pa.list_(pa.string()))


def _fold(with_proof: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of leaves, each led by its ancestors' siblings, to one result row a leaf."""
    fields = RESULT + [PROOF] * with_proof
    names, types = zip(*fields, strict=True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for head, *rows in blocks(batches):
            levels = parents([r["digest"] for r in rows], min(STRIDE, depth(rows[0]["n"])))
            above = []
            for p in head["path"]:
                h = hashlib.sha256(p["left"].encode())  # the state before the slot of this block's ancestor
                above.append((h, p["right"].encode()))
            upper = "".join(p["left"] + p["right"] for p in head["path"])
            out = []
            for i, r in enumerate(rows):
                now, proof = r["seen"], []
                for level in levels:
                    p, slot = level[i // ARITY], i % ARITY
                    now = p.fold(slot, now)
                    proof += p.siblings(slot)
                    i //= ARITY
                for state, right in above:
                    h = state.copy()
                    h.update(now.encode() + right)
                    now = h.hexdigest()
                row = (r["doc_id"], r["digest"], head["subroot"], head["digest"],
                       hashlib.sha256(("".join(proof) + upper).encode()).hexdigest(), now, now == head["digest"])
                if with_proof:
                    row += (proof + [upper[k:k + 64] for k in range(0, len(upper), 64)],)
                out.append(row)
                if len(out) >= OUT_ROWS:
                    yield _batch(out, names, types)
                    out = []
            if out:
                yield _batch(out, names, types)
    return run


def lowered() -> tuple[Column, Column]:
    """The tampering of the query: A-Z lower-cased where 3 divides the CRC-32 of the decimal doc_id."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, common.ascii_lower(F.col("text"))


def leaves(docs: DataFrame, tampered: Column | None = None, text: Column | None = None) -> DataFrame:
    """(doc_id, g, digest, seen): the leaf of every row and the leaf a reader sees, numbered within its group."""
    own = leaf(*map(F.col, FIELDS))
    seen = F.col("digest")
    if tampered is not None:
        seen = F.when(tampered, leaf(*map(F.col, FIELDS[:-1]), text)).otherwise(seen)
    d = docs.select(*FIELDS, own.alias("digest"))
    g = F.when(F.col("lang").isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col("lang")))
    d = common.materialise(d.select(F.col("doc_id").cast("bigint").alias("doc_id"), g.alias("g"), "digest",
                                    seen.alias("seen")), "merkle-leaves")
    return numbered(d, "g", ["doc_id", "digest"], "merkle-order")


def manifest(docs: DataFrame, tampered: Column | None = None, text: Column | None = None,
             with_proof: bool = False) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root folded from the row as a reader sees it.

    Where ``tampered`` holds, the reader sees ``text`` instead of the text; without it every row
    verifies.  ``with_proof`` adds the sibling digests themselves, from the leaf's level up.
    """
    d = leaves(docs, tampered, text).select(
        "g", F.expr(f"_q_pos div {BLOCK}").alias("block"), F.col("_q_pos").alias("pos"), F.col("_q_n").alias("n"),
        "digest", "doc_id", "seen")
    tops = common.materialise(by_block(d.select("g", "block", "pos", "n", "digest")).mapInArrow(_block_nodes, NODES),
                              "merkle-blocks")
    paths, subroots = climb(tops, "merkle-groups")
    top = numbered(subroots.withColumn("all", F.lit(TOP)), "all", ["g"], "merkle-subroots")
    top = top.select(F.col("all"), F.col("g").alias("own"), F.col("_q_pos").alias("pos"), F.col("_q_n").alias("n"), "digest")
    over, root = climb(top.select(F.col("all").alias("g"), "pos", "n", "digest"), "merkle-root")
    over = over.join(top.select("pos", "own", F.col("digest").alias("subroot")), "pos").join(
        root.withColumnRenamed("digest", "root"), "g")
    heads = paths.join(over.select(F.col("own").alias("g"), F.col("path").alias("over"), "subroot", "root"), "g")
    heads = heads.select("g", F.col("pos").alias("block"), F.lit(-1).cast("bigint").alias("pos"),
                         F.col("root").alias("digest"), "subroot", F.concat("path", "over").alias("path"))
    rows = by_block(d.unionByName(heads, allowMissingColumns=True))
    fields = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return rows.mapInArrow(_fold(with_proof), fields + ", proof array<string>" * with_proof)
