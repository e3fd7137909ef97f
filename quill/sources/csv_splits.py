"""CSV records cut out of file splits (S1): quoted line breaks without one task a file.

Spark reads a file as lines, split anywhere.  Whether a line begins a record
depends on whether a quoted field is open before it, that is on every line of
the file before it.  A line turns "closed before" and "open before" into an
open or closed state after it; two such pairs compose, so

1. each task composes the lines of its splits (one row a split),
2. the pairs of a file's splits are composed in order, which gives the state
   each split begins with and the split that owns an open record,
3. each task cuts its lines into records from that state.  A record over split
   borders comes in pieces, which are put together by their owner.

Fields follow the usual rules: a field is quoted when it begins with a quote, a
doubled quote inside stands for one, a quote inside an unquoted field is a
character.  Lines end in a line feed, records also in a carriage return before
it.
"""

from __future__ import annotations

import csv
import io
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CORRUPT = "_corrupt_record"
# So many splits at most are sent to every task (some hundred bytes each); beyond, lines are joined and sorted.
BROADCAST_SPLITS = 100_000
RECORDS = "file string, owner long, block long, whole boolean, head boolean, record string"


class LineRule:
    """What a line does to the quote state."""

    def __init__(self, sep: str, quote: str) -> None:
        s, q = re.escape(sep), re.escape(quote)
        body = f"[^{q}]*+(?:{q}{q}[^{q}]*+)*+"
        rest = f"(?:(?!{s}).)*+"
        fields = f"(?:(?:{q}{body}{q}|(?!{q})){rest}{s})*+"
        self.sep, self.quote = sep, quote
        self.opens = re.compile(rf"{fields}{q}{body}\Z", re.DOTALL)
        self.closing = re.compile(f"{body}{q}", re.DOTALL)

    def after(self, line: str) -> tuple[bool, bool]:
        """Whether a quoted field is open after the line: if none was before it, and if one was."""
        return self.opens.match(line) is not None, self._after_open(line)

    def _after_open(self, line: str) -> bool:
        end = self.closing.match(line)
        if end is None:
            return True
        at = line.find(self.sep, end.end())
        return at >= 0 and self.opens.match(line, at + len(self.sep)) is not None


def lines_of(spark: SparkSession, path: str, encoding: str, opts: dict) -> DataFrame:
    """(file, block, line): the lines of every split."""
    r = spark.read.options(lineSep="\n", encoding=encoding, **opts)
    return r.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                               F.col("value").alias("line"))


def _runs(b: pa.RecordBatch) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, block, lines) of the runs of rows of one split; ``file`` and ``block`` are the first columns."""
    n = b.num_rows
    if not n:
        return
    file, block = b.column(0), b.column(1).to_numpy()
    new = np.ones(n, bool)
    if n > 1:
        same = pc.equal(file.slice(0, n - 1), file.slice(1)).to_numpy(zero_copy_only=False)
        new[1:] = ~same | (block[1:] != block[:-1])
    at = np.append(np.flatnonzero(new), n)
    for i, j in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        yield file[i].as_py(), int(block[i]), b.slice(i, j - i)


def _quoted(lines: pa.Array, rule: LineRule) -> list[tuple[int, str]]:
    """Number and text of the lines that hold a quote; the others leave the state as it is."""
    at = np.flatnonzero(pc.match_substring(lines, rule.quote).to_numpy(zero_copy_only=False))
    return list(zip(at.tolist(), lines.take(pa.array(at)).to_pylist(), strict=True))


def split_states(lines: DataFrame, rule: LineRule) -> DataFrame:
    """(file, block, entry, owner): whether a split begins inside a quoted field, and the split its open record began in."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begins = None, (False, True), (False, False)
        out = []
        for b in batches:
            for file, block, rows in _runs(b):
                if now != (file, block):
                    if now:
                        out.append((*now, *state, *begins))
                    now, state, begins = (file, block), (False, True), (False, False)
                col = rows.column(2)
                last = len(col)
                at = 0
                for i, line in _quoted(col, rule):
                    # lines up to this one begin records where the state before them is closed
                    begins = tuple(x or not s for x, s in zip(begins, state, strict=True))
                    after = rule.after(line)
                    state = tuple(after[s] for s in state)
                    at = i + 1
                if at < last:
                    begins = tuple(x or not s for x, s in zip(begins, state, strict=True))
        if now:
            out.append((*now, *state, *begins))
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(("file", "block", "c", "o", "bc", "bo"), r, strict=True)) for r in out])

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        state, owner, rows = False, -1, []
        for r in pdf.itertuples(index=False):
            rows.append((r.file, r.block, state, owner))
            if r.bo if state else r.bc:
                owner = r.block
            state = bool(r.o if state else r.c)
        return pd.DataFrame(rows, columns=["file", "block", "entry", "owner"])

    pairs = lines.mapInArrow(run, "file string, block long, c boolean, o boolean, bc boolean, bo boolean")
    return pairs.groupBy("file").applyInPandas(compose, "file string, block long, entry boolean, owner long")


def _cut(rule: LineRule):
    """Lines of splits, with the state the split begins with, to records and pieces of records."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, owner, open_lines, first = None, False, -1, [], False

        def last() -> list[tuple]:
            """What is left when a split ends: its last record, which the next split may go on with."""
            return [(now[0], owner, now[1], False, first, "\n".join(open_lines))] if open_lines else []

        for b in batches:
            out: list[tuple] = []
            for file, block, rows in _runs(b):
                if now != (file, block):
                    out += last()
                    now = (file, block)
                    state, owner, open_lines = rows.column(3)[0].as_py(), rows.column(4)[0].as_py(), []
                    first = False
                    head = block == 0
                col = rows.column(2)
                before = np.zeros(len(col), bool)
                at = 0
                for i, line in _quoted(col, rule):
                    before[at:i + 1] = state
                    state, at = rule.after(line)[state], i + 1
                before[at:] = state
                text = col.to_pylist()
                begin = np.flatnonzero(~before).tolist()
                if not begin:
                    open_lines += text
                    continue
                open_lines += text[:begin[0]]
                for k, i in enumerate(begin):
                    if open_lines:
                        if owner == now[1]:  # it began in this split, so it is whole
                            out.append((file, owner, block, True, first, "\n".join(open_lines)))
                        else:
                            out += last()
                    open_lines = text[i:begin[k + 1] if k + 1 < len(begin) else len(text)]
                    owner, first = block, head
                    if head and (len(open_lines) > 1 or open_lines[0].strip("\r\ufeff")):
                        head = False
                    elif first:
                        first = False
            if out:
                yield _records(out)
        if now and open_lines:
            yield _records(last())
    return run


def _records(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string())
    names = [f.split()[0] for f in RECORDS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def records(spark: SparkSession, path: str, encoding: str = "utf-8", sep: str = ",", quote: str = '"',
            **opts) -> DataFrame:
    """(file, head, record): every record of the files, ``head`` on the first of a file; blank lines between are left out."""
    rule = LineRule(sep, quote)
    lines = lines_of(spark, path, encoding, opts)
    from quill.session import staged
    splits = staged(split_states(lines, rule), "csv-splits")
    few = splits.count() <= BROADCAST_SPLITS
    if few:
        rows = lines.join(F.broadcast(splits), ["file", "block"])
    else:
        numbered = lines.withColumn("at", F.monotonically_increasing_id())
        rows = numbered.join(splits, ["file", "block"]).sortWithinPartitions("file", "block", "at")
    cut = rows.select("file", "block", "line", "entry", "owner").mapInArrow(_cut(rule), RECORDS)
    whole = cut.filter("whole").select("file", "head", "record")
    pieces = cut.filter("not whole").groupBy("file", "owner").agg(
        F.max("head").alias("head"), F.sort_array(F.collect_list(F.struct("block", "whole", "record"))).alias("p"))
    joined = pieces.select("file", "head", F.array_join(F.transform("p", lambda x: x["record"]), "\n").alias("record"))
    out = whole.unionByName(joined).withColumn("record", F.regexp_replace("record", "\\r\\z", ""))
    out = out.withColumn("record", F.when(F.col("head"), F.regexp_replace("record", "^\ufeff", "")).otherwise(F.col("record")))
    return out.filter("record <> ''")


def _names(head: str | None, sep: str, quote: str, header: bool) -> list[str]:
    """Column names as Spark gives them: the header's, with their number where they repeat."""
    if head is None:
        return []
    cells = next(csv.reader(io.StringIO(head), delimiter=sep, quotechar=quote, doublequote=True), [])
    if not header:
        return [f"_c{i}" for i in range(len(cells))]
    low = [c.lower() for c in cells]
    return [f"_c{i}" if not c else f"{c}{i}" if low.count(c.lower()) > 1 else c for i, c in enumerate(cells)]


def read(spark: SparkSession, path: str, mode: str, header: bool = True, encoding: str = "utf-8",
         schema: T.StructType | str | None = None, sep: str = ",", quote: str = '"', parse: dict | None = None,
         **opts) -> DataFrame:
    """The parsed records with ``_source_file``; without a schema all columns are strings.

    ``mode``: DROPMALFORMED, PERMISSIVE or FAILFAST; ``parse``: more options of Spark's CSV parser;
    ``opts``: options of the file listing.
    """
    rows = records(spark, path, encoding, sep, quote, **opts)
    if schema is None:
        first = rows.filter("head").orderBy("file").select("record").first()
        names = _names(first["record"] if first else None, sep, quote, header)
        schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    elif isinstance(schema, str):
        schema = T.StructType.fromDDL(schema)
    if header:
        rows = rows.filter(~F.col("head"))
    names = [f.name for f in schema.fields]
    wide = schema if CORRUPT in names else T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"sep": sep, "quote": quote, "escape": quote, "columnNameOfCorruptRecord": CORRUPT,
               "mode": "FAILFAST" if mode == "FAILFAST" else "PERMISSIVE", **(parse or {})}
    if not names:
        return rows.select(F.col("file").alias("_source_file"))
    ddl = schema if mode == "FAILFAST" else wide
    r = rows.select("file", F.from_csv("record", _ddl(ddl), options).alias("r"))
    if mode == "DROPMALFORMED":
        r = r.filter(F.col(f"r.{CORRUPT}").isNull())
    return r.select(*[F.col("r")[n].alias(n) for n in names], F.col("file").alias("_source_file"))


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema.fields)
