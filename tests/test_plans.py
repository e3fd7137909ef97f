"""Plan guards: no cartesian / nested-loop joins, pushdown and pruning reach the scan,
per-group top-k gets a window group limit."""

import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"
CORE = ["batch_analyze", "summary_stats", "agg_by_entity_type", "agg_by_window", "entity_cooccurrence",
        "report_summary", "chart_confidence_box", "eval_overall", "auc_ovr", "roc_points", "metric_histograms",
        "alert_cooldown", "alert_fire", "health_failures", "tfidf", "count_vector", "embed_mean", "cosine_topk",
        "run_summary", "quantiles_exclusive", "dedup_documents", "prediction_upsert", "network_nodes"]


def plan(spark, name):
    return queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", CORE)
def test_no_cartesian(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p
    assert "BroadcastNestedLoopJoin" not in p


def test_pushdown_and_pruning(spark):
    p = queries()["scan_parquet"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(lang), EqualTo(lang,en)]" in p
    assert "ReadSchema: struct<doc_id:bigint,lang:string,n_chars:bigint>" in p


def test_group_limit(spark):
    assert "WindowGroupLimit" in plan(spark, "agg_by_sentiment_entities")
    assert "WindowGroupLimit" in plan(spark, "metric_histograms")


def scans(spark, name):
    """Scans of the documents' texts in a query's plan, subqueries included."""
    p = queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    return p.count("text#") and sum("Relation [" in line and "text#" in line for line in p.split("\n"))


@pytest.mark.parametrize("name", ["summary_stats", "report_summary", "quality_metrics"])
def test_summaries_scan_the_documents_once(spark, name):
    assert scans(spark, name) == 1


def test_every_parity_query_is_registered():
    from tests.test_parity import FAST
    assert set(FAST) <= set(queries())
