"""File scans (S1-S14, S22, S25) as Spark readers.

Each reader returns a DataFrame; nothing is loaded on the driver.  File
provenance comes from the ``_metadata`` column, error policy maps to the
reader ``mode``, and mixed directories use one reader per extension.
"""

from __future__ import annotations

import datetime as dt
import json
import logging
import os
import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quill.functions.text import strip_text
from quill.sources import csv_splits

LOG = logging.getLogger(__name__)
CORRUPT = "_corrupt_record"
# Error policy of the reference loader -> Spark reader mode.
ERROR_MODES = {"skip": "DROPMALFORMED", "log": "PERMISSIVE", "raise": "FAILFAST"}
# Reader options that choose files; the others are the parser's.
LISTING = ("pathGlobFilter", "recursiveFileLookup", "modifiedBefore", "modifiedAfter", "ignoreMissingFiles", "ignoreCorruptFiles")
# Extensions the loader accepts, by reader.
FORMATS = {".csv": "csv", ".json": "json", ".jsonl": "json", ".txt": "text", ".parquet": "parquet",
           ".yaml": "yaml", ".yml": "yaml"}


def with_provenance(df: DataFrame) -> DataFrame:
    """``_source_file`` (string) and ``_loaded_at`` (timestamp) columns."""
    return df.withColumn("_source_file", F.col("_metadata.file_path")).withColumn("_loaded_at", F.current_timestamp())


def located(df: DataFrame) -> DataFrame:
    """Provenance columns of a frame that a reader gave."""
    if "_source_file" in df.columns:
        return df.withColumn("_loaded_at", F.current_timestamp())
    return with_provenance(df)


def handle_error(message: str, errors: str) -> None:
    """``raise`` raises, ``log`` logs an error, ``skip`` leaves a debug line."""
    if errors == "raise":
        raise RuntimeError(message)
    LOG.log(logging.ERROR if errors == "log" else logging.DEBUG, message)


def nothing_loaded(spark: SparkSession) -> DataFrame:
    """The result of a source that was skipped: no rows."""
    return spark.createDataFrame([], "_source_file string, _loaded_at timestamp")


def path_kind(spark: SparkSession, path: str) -> str:
    """``file``, ``dir`` or ``missing``, in whatever store the path names."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return "missing"
    return "dir" if fs.getFileStatus(p).isDirectory() else "file"


def read_csv(spark: SparkSession, path: str, header: bool = True, encoding: str = "utf-8",
             schema: T.StructType | str | None = None, errors: str = "log", multiline: bool = True,
             provenance: bool = False, **opts) -> DataFrame:
    """CSV with a header row; quoted fields may hold line breaks.

    Records are cut out of the files' splits (:mod:`quill.sources.csv_splits`), so a large file is
    many tasks.  Files known to have no quoted line breaks go through Spark's line reader
    (``multiline=False``); a schema to be inferred, or another escape than the doubled quote, through
    its multi-line reader, which takes a file a task.  ``provenance`` adds ``_source_file``.
    """
    listing = {k: opts.pop(k) for k in list(opts) if k in LISTING}
    if multiline and not opts.get("inferSchema") and opts.get("escape", '"') == opts.get("quote", '"'):
        opts.pop("escape", None)
        opts.pop("inferSchema", None)
        sep, quote = opts.pop("sep", opts.pop("delimiter", ",")), opts.pop("quote", '"')
        df = csv_splits.read(spark, path, ERROR_MODES[errors], header, encoding, schema, sep, quote, opts, **listing)
        return df if provenance else df.drop("_source_file")
    r = spark.read.options(**{"header": header, "encoding": encoding, "multiLine": multiline, "escape": '"',
                              "mode": ERROR_MODES[errors], **opts, **listing})
    if schema is not None:
        r = r.schema(schema)
    df = r.csv(path)
    return df.withColumn("_source_file", F.col("_metadata.file_path")) if provenance else df


def read_json(spark: SparkSession, path: str, multiline: bool = False, errors: str = "log",
              schema: T.StructType | str | None = None) -> DataFrame:
    """JSON lines (default) or pretty-printed documents (``multiline``); bad lines isolated."""
    r = spark.read.options(multiLine=multiline, mode=ERROR_MODES[errors], columnNameOfCorruptRecord=CORRUPT)
    if schema is not None:
        r = r.schema(schema)
    return r.json(path)


def read_text_lines(spark: SparkSession, path: str, **opts) -> DataFrame:
    """S3: trimmed non-blank lines with their original 1-based line number, per file.

    Files are split like any text.  A line's place in its split is its row id
    less the first row id of the split; the lines of the file's earlier splits
    are added from a table of one row a split.
    """
    raw = spark.read.options(**opts).text(path).select(
        "value", F.col("_metadata.file_path").alias("_source_file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"))
    splits = raw.groupBy("_source_file", "block").agg(F.min("row").alias("first"), F.count("value").alias("lines"))
    before = Window.partitionBy("_source_file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("_source_file", "block", "first", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("before"))
    text = strip_text(F.col("value"))
    return raw.join(splits, ["_source_file", "block"]).filter(text != "").select(
        "_source_file", text.alias("text"), (F.col("row") - F.col("first") + F.col("before") + 1).cast("int").alias("line_number"))


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet (column pruning and filter pushdown by Catalyst)."""
    return spark.read.parquet(path)


def _parse_yaml(text: str):
    """The document, by libyaml where it is installed: the plain parser takes many times as long.

    The plain parser decides on what libyaml refuses, and on tabs, of which libyaml allows more.
    """
    import yaml
    fast = getattr(yaml, "CSafeLoader", None)
    if fast and "\t" not in text:
        try:
            return yaml.load(text, Loader=fast)
        except yaml.YAMLError:
            pass
    return yaml.safe_load(text)


def _yaml_docs(errors: str) -> Callable[[Iterable[pd.DataFrame]], Iterable[pd.DataFrame]]:
    """Each row is one document of a file; a parsed list becomes one row an item.

    A document that cannot be parsed goes by the error policy: the load fails, the document is left
    out, or its text is kept in the corrupt-record column.
    """
    def run(it: Iterable[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        import yaml
        for pdf in it:
            rows = []
            for path, at, text in zip(pdf["_source_file"], pdf["at"], pdf["value"], strict=True):
                try:
                    doc = _parse_yaml(text.removeprefix("---"))
                except yaml.YAMLError as e:
                    if errors == "raise":
                        raise RuntimeError(f"YAML document in {path}: {e}") from e
                    if errors == "log":
                        rows.append((path, at, 0, None, text))
                    continue
                for j, rec in enumerate(doc if isinstance(doc, list) else [doc]):
                    if rec:
                        rows.append((path, at, j, json.dumps(rec, default=str, ensure_ascii=False), None))
            yield pd.DataFrame(rows, columns=["_source_file", "doc", "item", "json", CORRUPT])
    return run


def read_yaml(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              glob: str | None = None, errors: str = "log") -> DataFrame:
    """Multi-document YAML (empty documents dropped) -> JSON rows, parsed with ``schema``.

    Spark splits files at the document markers, so a task parses single
    documents however large a file is; ``doc`` grows along a file.  Under the
    policy ``log``, documents that cannot be parsed are in the corrupt-record column.
    """
    r = spark.read.option("lineSep", "\n---").options(**({"pathGlobFilter": glob} if glob else {}))
    if not glob:
        r = r.option("recursiveFileLookup", "true")
    raw = r.text(path).select(F.col("_metadata.file_path").alias("_source_file"),
                              F.monotonically_increasing_id().alias("at"), "value")
    docs = raw.mapInPandas(_yaml_docs(errors), f"_source_file string, doc long, item int, json string, {CORRUPT} string")
    more = [CORRUPT] if errors == "log" else []
    if schema is None:
        return docs.select("_source_file", "doc", "item", "json", *more)
    return docs.select("_source_file", "doc", "item", F.from_json("json", schema).alias("r"), CORRUPT).select(
        "_source_file", "doc", "item", "r.*", *more)


def load_file(spark: SparkSession, path: str, file_format: str | None = None, errors: str = "log",
              schema=None, **opts) -> DataFrame:
    """Dispatch by extension (or ``file_format``).

    A missing file or an unknown format goes by the error policy; under
    ``skip`` and ``log`` the result is empty.
    """
    fmt = file_format or FORMATS.get(os.path.splitext(path)[1].lower())
    if path_kind(spark, path) == "missing":
        handle_error(f"file not found: {path}", errors)
        return nothing_loaded(spark)
    if fmt not in FORMATS.values():
        handle_error(f"unsupported format: {path}", errors)
        return nothing_loaded(spark)
    return read_as(spark, path, fmt, errors, schema, **opts)


def read_as(spark: SparkSession, path: str, fmt: str, errors: str = "log", schema=None, provenance: bool = False,
            **opts) -> DataFrame:
    """The reader of a format; with ``provenance`` the source file is a column or in ``_metadata``."""
    if fmt == "csv":
        return read_csv(spark, path, errors=errors, schema=schema, provenance=provenance, **opts)
    if fmt == "json":
        r = spark.read.options(mode=ERROR_MODES[errors], columnNameOfCorruptRecord=CORRUPT, **opts)
        return (r.schema(schema) if schema is not None else r).json(path)
    if fmt == "text":
        return read_text_lines(spark, path, **opts)
    if fmt == "parquet":
        return spark.read.options(**opts).parquet(path)
    return read_yaml(spark, path, schema, opts.get("pathGlobFilter"), errors)


def narrowed(pattern: str, ext: str) -> str | None:
    """The glob of the names that match ``pattern`` and end in ``ext``; None when there can be none."""
    tail, rest = "", ext
    tokens = re.findall(r"\[[^\]]*\]|.", pattern)
    while rest:
        if not tokens:
            return None
        t = tokens.pop()
        if t == "*":
            return "".join(tokens) + "*" + rest + tail
        if t != "?" and t != rest[-1] and not (len(t) > 1 and re.match(t, rest[-1])):
            return None
        tail, rest = rest[-1] + tail, rest[:-1]
    return "".join(tokens) + tail


def load_directory(spark: SparkSession, directory: str, pattern: str = "*", recursive: bool = True,
                   errors: str = "log") -> DataFrame:
    """Every file whose name matches ``pattern``, one reader for each extension found, with provenance.

    The files are listed by Spark; only their distinct extensions reach the
    driver.  Extensions without a reader go by the error policy.
    """
    if path_kind(spark, directory) != "dir":
        handle_error(f"directory not found: {directory}", errors)
        return nothing_loaded(spark)
    where = {"recursiveFileLookup": "true", "pathGlobFilter": pattern} if recursive else {}
    at = directory if recursive else f"{directory.rstrip('/')}/{pattern}"
    try:
        files = spark.read.format("binaryFile").options(**where).load(at).select("path")
        found = [r[0] for r in files.select(F.regexp_extract("path", r"(\.[^./]*)$", 1)).distinct().collect()]
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
        found = []
    frames = []
    for ext in sorted(found):
        fmt, glob = FORMATS.get(ext.lower()), narrowed(pattern, ext)
        if fmt is None or glob is None:
            handle_error(f"unsupported format: {ext or 'no extension'} in {directory}", errors)
            continue
        opts = {"recursiveFileLookup": "true", "pathGlobFilter": glob} if recursive else {}
        df = read_as(spark, directory if recursive else f"{directory.rstrip('/')}/{glob}", fmt, errors, provenance=True,
                     **opts)
        frames.append(located(df))
    return union_all(frames) if frames else nothing_loaded(spark)


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Union by name; a column of different types becomes a string."""
    kinds: dict[str, set[str]] = {}
    for f in frames:
        for name, kind in f.dtypes:
            kinds.setdefault(name, set()).add(kind)
    mixed = {n for n, k in kinds.items() if len(k) > 1}
    frames = [f.withColumns({n: F.col(n).cast("string") for n in mixed & set(f.columns)}) if mixed & set(f.columns) else f
              for f in frames]
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def load_batch(spark: SparkSession, sources: list, transform: Callable[[DataFrame], DataFrame] | None = None,
               errors: str = "log") -> DataFrame:
    """Union of files, directories and ready frames, with an optional DataFrame -> DataFrame transform."""
    frames = []
    for s in sources:
        if isinstance(s, DataFrame):
            frames.append(s)
            continue
        kind = path_kind(spark, s)
        known = os.path.splitext(s)[1].lower() in FORMATS
        if kind == "missing":
            handle_error(f"invalid source: {s}", errors)
        elif kind == "file" or known:  # a folder named data.csv is what Spark writes for one file
            df = load_file(spark, s, errors=errors, provenance=True)
            frames.append(df if "_loaded_at" in df.columns else located(df))
        else:
            frames.append(load_directory(spark, s, errors=errors))
    out = union_all(frames) if frames else nothing_loaded(spark)
    return out.transform(transform) if transform else out


def load_stats(df: DataFrame, started: dt.datetime | None = None) -> DataFrame:
    """Files, records, errors, start, end and duration of loading a frame (one row).

    The frame is read here; ``started`` is when its loading began (now if absent).
    """
    started = started or dt.datetime.now(dt.timezone.utc)
    has_corrupt = CORRUPT in df.columns
    src = F.col("_source_file") if "_source_file" in df.columns else F.col("_metadata.file_path")
    r = df.agg(F.countDistinct(src).cast("bigint").alias("files"), F.count("*").cast("bigint").alias("records"),
               (F.count_if(F.col(CORRUPT).isNotNull()) if has_corrupt else F.lit(0)).cast("bigint").alias("errors")).first()
    ended = dt.datetime.now(dt.timezone.utc)
    return df.sparkSession.createDataFrame(
        [(r["files"], r["records"], r["errors"], started, ended, (ended - started).total_seconds())],
        "files long, records long, errors long, start_time timestamp, end_time timestamp, duration_s double")


def save_load_stats(stats: DataFrame, path: str, run_id: str) -> None:
    """Append one stats row (with run id and time) to a parquet table kept between runs."""
    stats.withColumns({"run_id": F.lit(run_id), "saved_at": F.current_timestamp()}).write.mode("append").parquet(path)


def last_load_stats(spark: SparkSession, path: str) -> DataFrame:
    """The most recent stats row of the table (``max_by`` on the save time)."""
    df = spark.read.parquet(path)
    return df.agg(F.max_by(F.struct(*df.columns), "saved_at").alias("s")).select("s.*")


def enrich_batch(df: DataFrame) -> DataFrame:
    """Tag historical rows: ``source = 'batch'`` and ``processed_at``."""
    return df.withColumns({"source": F.lit("batch"), "processed_at": F.current_timestamp()})


def label_index(df: DataFrame, label: str = "label", out: str = "label_id") -> DataFrame:
    """String labels -> ids in sorted label order (0-based).

    Distinct labels are ranked by distributed running sums, so any number of
    labels will do; Spark broadcasts the ids when they are small.
    """
    from quill.operators.stats import running_sums
    labels = df.select(F.col(label).cast("string").alias(label)).distinct().withColumn("one", F.lit(1))
    ids = running_sums(labels, [], [F.col(label)], ["one"]).select(label, (F.col("cum_one") - 1).cast("int").alias(out))
    return df.withColumn(label, F.col(label).cast("string")).join(ids, label)


def read_json_columnar(spark: SparkSession, path: str, text_key: str = "text", label_key: str = "label",
                       multiline: bool = False) -> DataFrame:
    """JSON objects of parallel lists {text: [...], label: [...]} -> rows.

    One object a line (splittable) or, with ``multiline``, one object a file.
    """
    doc = spark.read.option("multiLine", multiline).json(path)
    z = F.explode(F.arrays_zip(F.col(text_key).alias("t"), F.col(label_key).alias("l")))
    return doc.select(z.alias("r")).select(F.col("r.t").alias("text"), F.col("r.l").alias("label"))


def save_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """One dataset partitioned by split."""
    df.write.mode("overwrite").partitionBy(split).parquet(path)


def load_splits(spark: SparkSession, path: str, splits=("train", "validation", "test")) -> tuple[DataFrame, list]:
    """The saved splits (partition filter on ``split``) and the names that are missing (by their folders)."""
    df = spark.read.parquet(path)
    present = {s for s in splits if path_kind(spark, f"{path.rstrip('/')}/split={s}") == "dir"}
    return df.filter(F.col("split").isin(*splits)), [s for s in splits if s not in present]
