"""Export tables and writers.

Each ``*_table`` function builds the DataFrame a file format would hold;
``write_*`` functions persist it with Spark writers (one task per
partition, never through the driver).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quill.functions import text as tx
from quill.operators import aggregate as ag


def flat_results_table(results: DataFrame, include_entities: bool = True, text_limit: int = 500) -> DataFrame:
    """One flat row per result (text cut to ``text_limit`` characters)."""
    t = F.coalesce(F.col("text"), F.lit(""))
    cols = [F.coalesce(F.col("document_id"), F.lit("")).alias("document_id"),
            F.substring(t, 1, text_limit).alias("text"), F.length(t).cast("bigint").alias("text_length"),
            tx.word_count(t).alias("word_count"),
            ag.sent_label().alias("sentiment_label"), ag.sent_score().alias("sentiment_score"),
            F.col("classification.label").alias("classification_label"),
            F.col("classification.score").alias("classification_score")]
    if include_entities:
        cols += [F.size("entities").cast("bigint").alias("entity_count"),
                 F.array_join(F.transform("entities", lambda e: F.coalesce(e["text"], F.lit(""))), "; ").alias("entities"),
                 F.array_join(F.array_sort(F.array_distinct(F.transform(
                     "entities", lambda e: F.coalesce(e["label"], F.lit(""))))), "; ").alias("entity_types")]
    cols += [F.col("processed_at").cast("timestamp_ntz").alias("processed_at"),
             F.coalesce(F.col("processing_time"), F.lit(0.0)).alias("processing_time"),
             F.coalesce(F.col("error"), F.lit("")).alias("error")]
    return results.select(*cols)


def entity_rows_table(results: DataFrame) -> DataFrame:
    """One row per entity, with -1 offsets and 0.0 score defaults."""
    return (tx.unnest(results, "entities", "e", "document_id")
            .select(F.coalesce(F.col("document_id"), F.lit("")).alias("document_id"),
                    F.coalesce(F.col("e.text"), F.lit("")).alias("entity_text"),
                    F.coalesce(F.col("e.label"), F.lit("")).alias("entity_type"),
                    F.coalesce(F.col("e.score"), F.lit(0.0)).alias("confidence"),
                    F.coalesce(F.col("e.start"), F.lit(-1)).alias("start_position"),
                    F.coalesce(F.col("e.end"), F.lit(-1)).alias("end_position")))


def report_rows_table(results: DataFrame, n: int = 100, n_entities: int = 5) -> DataFrame:
    """First ``n`` results by id with a preview and up to ``n_entities`` entity tags."""
    tags = F.array_join(F.transform(F.slice(F.coalesce(F.col("entities"), F.array()), 1, n_entities),
                                    lambda e: F.format_string("%s (%s)", e["text"], e["label"])), "")
    more = F.greatest(ag.n_entities() - n_entities, F.lit(0))
    return (results.orderBy("document_id").limit(n)
            .select("document_id", tx.preview(F.coalesce(F.col("text"), F.lit(""))).alias("text_preview"),
                    F.coalesce(ag.sent_label(), F.lit("N/A")).alias("sentiment_label"),
                    F.format_string("%.3f", F.round(F.coalesce(ag.sent_score(), F.lit(0.0)), 3)).alias("sentiment_score"),
                    tags.alias("entity_tags"), more.cast("bigint").alias("more_entities")))


def workbook_results_table(results: DataFrame) -> DataFrame:
    """S19 'Results' sheet."""
    return results.select(F.col("document_id").alias("Document ID"),
                          tx.preview(F.coalesce(F.col("text"), F.lit(""))).alias("Text Preview"),
                          F.coalesce(ag.sent_label(), F.lit("")).alias("Sentiment"),
                          F.coalesce(ag.sent_score(), F.lit(0.0)).alias("Sentiment Score"),
                          ag.n_entities().alias("Entity Count"),
                          tx.word_count(F.coalesce(F.col("text"), F.lit(""))).alias("Word Count"))


def workbook_entities_table(results: DataFrame) -> DataFrame:
    """S19 'Entities' sheet."""
    return (tx.unnest(results, "entities", "e", "document_id")
            .select(F.col("document_id").alias("Document ID"), F.coalesce("e.text", F.lit("")).alias("Entity"),
                    F.coalesce("e.label", F.lit("")).alias("Type"), F.coalesce("e.score", F.lit(0.0)).alias("Confidence")))


def workbook_summary_table(results: DataFrame) -> DataFrame:
    """S19 'Summary' sheet: (Metric, Value)."""
    return results.agg(F.count("*").cast("string").alias("v")).select(
        F.lit("Total Documents").alias("Metric"), F.col("v").alias("Value"))


def summary_lines_table(summary: DataFrame) -> DataFrame:
    """The A2 summary row as ordered (seq, section, line) markdown lines."""
    lines = [
        ("Overview", F.format_string("- **Total Documents**: %d", "total_documents")),
        ("Overview", F.format_string("- **Success Rate**: %.1f%%", F.round(F.col("success_rate") * 100, 1))),
        ("Sentiment Analysis", F.format_string("- **negative**: %d", "n_negative")),
        ("Sentiment Analysis", F.format_string("- **neutral**: %d", "n_neutral")),
        ("Sentiment Analysis", F.format_string("- **positive**: %d", "n_positive")),
        ("Sentiment Analysis", F.format_string("- **Average Confidence**: %.3f", F.round("avg_confidence", 3))),
        ("Sentiment Analysis", F.format_string("- **Confidence Std Dev**: %.3f", F.round("std_confidence", 3))),
        ("Entity Analysis", F.format_string("- **Total Entities**: %d", "total_entities")),
        ("Entity Analysis", F.format_string("- **Unique Entities**: %d", "unique_entities")),
        ("Entity Analysis", F.format_string("- **Average per Document**: %.2f", F.round("avg_entities_per_doc", 2))),
        ("Text Statistics", F.format_string("- **Average Length**: %d characters", F.round("avg_length", 0).cast("bigint"))),
        ("Text Statistics", F.format_string("- **Average Words**: %d words", F.round("avg_words", 0).cast("bigint"))),
    ]
    arr = F.array(*[F.struct(F.lit(i).cast("bigint").alias("seq"), F.lit(sec).alias("section"), ln.alias("line"))
                    for i, (sec, ln) in enumerate(lines)])
    return summary.select(F.explode(arr).alias("l")).select("l.*")


def prediction_cache_rows(results: DataFrame, model_type: str = "sentiment") -> DataFrame:
    """Rows of the prediction cache: (text_hash, model_type, prediction_data, confidence, created_at)."""
    return results.filter(F.col("sentiment").isNotNull()).select(
        F.md5("text").alias("text_hash"), F.lit(model_type).alias("model_type"),
        ag.sent_label().alias("prediction_data"), ag.sent_score().alias("confidence"), F.col("processed_at").alias("created_at"))


def write_json(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """JSON lines; nested structs written as they are, non-ASCII kept."""
    df.write.mode(mode).options(**options).json(path)


def write_csv(df: DataFrame, path: str, mode: str = "overwrite", **options) -> None:
    """CSV with a header (an empty frame still gets one); quotes doubled, outer blanks kept."""
    df.write.mode(mode).options(header=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False,
                                **options).csv(path)


def write_lines(df: DataFrame, col: str, path: str) -> None:
    """Text lines in one file (the frame is a handful of summary lines)."""
    df.select(col).coalesce(1).write.mode("overwrite").text(path)


def export_batch(results: DataFrame, base: str, formats=("json", "csv", "parquet"), compress: bool = True) -> dict:
    """One result set to several formats; gzip codec instead of a zip archive.

    The Parquet form is written first and read back for the others, so the
    results are computed once and nothing stays cached.
    """
    codec = {"compression": "gzip"} if compress else {}
    paths = {f: f"{base}/{f}" for f in formats}
    first = paths.get("parquet", f"{base}/_rows")
    results.write.mode("overwrite").parquet(first)
    rows = results.sparkSession.read.schema(results.schema).parquet(first)
    if "json" in paths:
        write_json(rows, paths["json"], **codec)
    if "csv" in paths:
        write_csv(flat_results_table(rows), paths["csv"], **codec)
    return paths
