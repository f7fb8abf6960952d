"""The dashboard views, their export, filters and shared rollups."""

import csv
import glob

import pytest

from tidemark.operators import export, funnel, growth, retention, revenue, views
from tidemark.plans import scratch
from tidemark.plans.rollups import materialize, materialize_bucketed, user_facts
from tidemark.sources.commerce import RULES, commerce_model

SMALL = "/root/testdata/sf0.001"
from tidemark.model import Rules


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


@pytest.fixture(autouse=True)
def no_views(spark):
    for name in views.VIEWS:
        spark.catalog.dropTempView(name)


def test_missing_views_are_created_once(spark, hand):
    views.register_views(hand, names=["v_mrr_trend"])
    created = views.ensure_views(hand)
    assert "v_mrr_trend" not in created and len(created) == 8
    assert views.ensure_views(hand) == []
    assert {r[0] for r in rows(views.view_row_counts(hand))} == set(views.VIEWS)


def test_unknown_view(hand):
    with pytest.raises(ValueError, match="nothing"):
        views.ensure_views(hand, required=["nothing"])


def test_export_writes_one_file_per_view_and_a_manifest(hand, tmp_path):
    names = ["v_funnel_summary", "v_mrr_trend"]
    manifest = export.export_views(hand, str(tmp_path), names=names)
    assert manifest.columns == ["view_name", "dashboard", "rows", "size_kb", "primary_use"]
    rows_of = {r.view_name: r.rows for r in manifest.collect()}
    assert rows_of == {"v_funnel_summary": 5, "v_mrr_trend": 15}
    assert all(r.size_kb > 0 for r in manifest.collect())
    (part,) = glob.glob(f"{tmp_path}/v_funnel_summary.csv/part-*")
    with open(part, encoding="utf-8") as handle:
        table = list(csv.reader(handle))
    assert table[0][:3] == ["step_order", "stage", "users"] and len(table) == 6
    assert glob.glob(f"{tmp_path}/manifest.csv/part-*")


def test_exported_files_are_not_read_back(spark, hand, tmp_path, monkeypatch):
    monkeypatch.setattr(export, "read_export", None)
    manifest = {r.view_name: r.rows for r in export.export_views(hand, str(tmp_path)).collect()}
    assert list(manifest) == list(views.VIEWS)
    for name, n in manifest.items():
        df = views.build_view(name, hand)
        assert n == df.count()
        assert rows(spark.read.schema(df.schema).option("header", True).csv(f"{tmp_path}/{name}.csv")) == rows(df)
    with pytest.raises(KeyError):
        export.export_views(hand, str(tmp_path), names=["v_mrr_trend", "nothing"])


def test_export_replaces_earlier_output(spark, hand, tmp_path):
    df = growth.dau(hand)
    path = export.export_csv(df, str(tmp_path / "dau"))
    export.export_csv(df, path)
    assert rows(export.read_export(spark, path, df)) == rows(df)


def test_filters_on_columns_a_table_lacks(hand):
    df = revenue.revenue_by_channel(hand)
    every = dict(period=7, max_months=3, segment_type="plan", plans=["Pro"], ignore_missing=True)
    assert views.slice_rows(df, **every).count() == df.count()
    for one in ({"period": 7}, {"max_months": 3}, {"segment_type": "plan"}, {"plans": ["Pro"]}):
        with pytest.raises(ValueError):
            views.slice_rows(df, **one)
    assert rows(views.slice_rows(df, channels=["Email"]).select("acquisition_channel")) == [("Email",)]
    long = views.slice_rows(funnel.activation_analysis(hand), channels=["Email"])
    kinds = {(r.segment_type, r.segment) for r in long.collect() if r.segment_type == "channel"}
    assert kinds == {("channel", "Email")}


def test_company_sizes_have_their_natural_order(spark):
    sizes = ["1000+", "51-200", "1-10", "other", "201-1000", "11-50"]
    df = views.with_size_order(spark.createDataFrame([(s,) for s in sizes], "company_size string"))
    got = [r[0] for r in df.orderBy(df.size_order.asc_nulls_last()).collect()]
    assert got == ["1-10", "11-50", "51-200", "201-1000", "1000+", "other"]


def test_rollups_do_not_change_results(spark, hand):
    rolled = materialize(hand)
    for metric in (growth.dau, growth.stickiness, growth.headline_kpis, retention.retention_long,
                   retention.cohort_retention, revenue.revenue_by_plan, funnel.funnel_stages,
                   revenue.top_customers):
        assert rows(metric(rolled)) == rows(metric(hand))


def test_views_of_a_materialized_model_read_only_rollups(spark):
    model = commerce_model(spark, SMALL)
    rolled = materialize(model, rules=RULES)
    for name in views.VIEWS:
        text = views.build_view(name, rolled, RULES)._jdf.queryExecution().optimizedPlan().toString()
        assert "o_orderkey" not in text and "o_custkey" not in text and "stored_" not in text
        assert rows(views.build_view(name, rolled, RULES)) == rows(views.build_view(name, model, RULES))


def test_scratch_needs_a_shared_folder_and_removes_only_there(spark):
    path = scratch.scratch_path(spark, "x")
    spark.range(3).write.parquet(path)
    assert scratch.remove(spark, path) and not scratch.remove(spark, path)
    with pytest.raises(ValueError):
        scratch.remove(spark, "/somewhere/else")


def test_bucketed_rollups_need_no_user_shuffle(spark, hand):
    spark.sql("CREATE DATABASE IF NOT EXISTS rollup_test")
    rolled = materialize_bucketed(hand, "rollup_test", 4)
    assert rows(funnel.funnel_stages(rolled)) == rows(funnel.funnel_stages(hand))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = user_facts(rolled, Rules())._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan
        assert "hashpartitioning(user_id" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP DATABASE rollup_test CASCADE")
