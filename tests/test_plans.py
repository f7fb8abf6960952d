"""Plans that must hold at scale, with broadcasts off as for inputs too large for them."""

import re
from pathlib import Path

import pytest

import __spark_entry__ as contract
from tidemark.model import Model, Rules
from tidemark.operators import growth, revenue
from tidemark.plans import rollups, tuning
from tidemark.plans.rollups import recent_days, user_facts
from tidemark.sources.commerce import commerce_model
from tidemark.sources.files import load_parquet_model, write_parquet_model

SMALL = contract.SMALL
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="no test data here")

def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    """The plan that ran, after adaptive changes, with those of scalar subqueries."""
    df.collect()
    return plan(df)


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", list(contract.metric_queries()))
def test_plan(spark, no_broadcast, name):
    """No nested loops, no Python, and only aggregated rows gathered in one partition."""
    text = final_plan(contract.metric_queries()[name](spark, SMALL))
    text = text.split("== Initial Plan ==")[0]
    assert "NestedLoop" not in text and "Cartesian" not in text
    assert "Python" not in text and "ArrowEval" not in text
    lines = text.splitlines()
    for i, line in enumerate(lines):
        if "Exchange SinglePartition" not in line:
            continue
        below = "\n".join(lines[i + 1 : i + 6])
        assert "HashAggregate" in below or "LocalLimit" in below, below


@pytest.mark.parametrize("name,pushed", [
    ("wau_recent", "GreaterThanOrEqual(o_orderdate"),
    ("dau_recent_stats", "GreaterThanOrEqual(o_orderdate"),
    ("events_wau_recent", "GreaterThanOrEqual(ts"),
    ("headline_kpis", "GreaterThanOrEqual(o_orderdate"),
    ("latest_kpi_cards", "GreaterThanOrEqual(o_orderdate"),
    ("renewal_overall", "EqualTo(o_orderstatus,F)"),
    ("mrr_arr", "EqualTo(o_orderstatus,F)"),
    ("revenue_by_plan", "EqualTo(o_orderstatus,F)"),
    ("renewal_overall", "GreaterThanOrEqual(c_acctbal,2000.0)"),
])
def test_limits_reach_the_scan(spark, name, pushed):
    df = contract.metric_queries()[name](spark, SMALL)
    filters = re.findall(r"PushedFilters: \[[^\n]*", plan(df))
    assert any(pushed in f for f in filters), filters


def test_active_users_of_the_headline_are_limited_at_the_scan(spark):
    text = plan(recent_days(commerce_model(spark, SMALL), 29))
    assert "GreaterThanOrEqual(o_orderdate" in text


def test_limits_open_only_the_months_they_need(spark, hand, tmp_path):
    write_parquet_model(hand, str(tmp_path))
    model = load_parquet_model(spark, str(tmp_path))
    df = growth.wau_recent(model)
    filters = re.findall(r"PartitionFilters: \[([^\n]*?)\], ", plan(df))
    assert any("month" in f for f in filters), filters
    assert df.collect() == growth.wau_recent(hand).collect()


def test_today_of_a_written_model_reads_no_activity(spark, hand, tmp_path):
    write_parquet_model(hand, str(tmp_path))
    model = load_parquet_model(spark, str(tmp_path))
    read = spark.range(1).select(rollups.today(model).alias("day"))
    text = read._jdf.queryExecution().optimizedPlan().toString()
    assert "last_day" in text and "activity_id" not in text and "user_id" not in text
    assert read.first().day == max(r.activity_date for r in hand.activity.collect())
    assert growth.headline_kpis(model).collect() == growth.headline_kpis(hand).collect()


@pytest.mark.parametrize("name", ["renewal_by_value_segment", "revenue_pareto", "pareto_running_share"])
def test_payers_of_tiles_are_derived_three_times_at_most(spark, no_broadcast, name):
    text = contract.metric_queries()[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Relation [") <= 6


@pytest.mark.parametrize("metric", [growth.dau, growth.wau, growth.wau_recent, growth.mau, growth.mau_mom, growth.stickiness,
                                    growth.dau_recent_stats, growth.headline_kpis])
def test_active_users_of_a_materialized_model_are_united_not_shuffled(spark, no_broadcast, hand, metric):
    for model in (hand, commerce_model(spark, SMALL)):
        rolled = rollups.materialize(model)
        text = plan(metric(rolled))
        assert "bitmap_or_agg" in text or metric in (growth.dau, growth.dau_recent_stats)
        assert not re.search(r"hashpartitioning\([^)]*user_id", text) and "o_custkey" not in text
        assert metric(rolled).collect() == metric(model).collect()


@pytest.mark.parametrize("name", ["renewal_overall", "revenue_by_channel", "mrr_arr"])
def test_orders_are_summed_before_they_are_shuffled(spark, no_broadcast, name):
    lines = plan(contract.metric_queries()[name](spark, SMALL)).split("== Initial Plan ==")[-1].splitlines()
    for i, line in enumerate(lines):
        if "Exchange hashpartitioning" not in line:
            continue
        below = "\n".join(lines[i + 1 : i + 4])
        if "o_orderstatus" in "\n".join(lines[i + 1 : i + 8]):
            assert "partial_" in below, below


@pytest.mark.parametrize("name", ["cohort_retention", "top_customers"])
def test_orders_are_read_twice_at_most(spark, name):
    text = plan(contract.metric_queries()[name](spark, SMALL)).split("== Initial Plan ==")[-1]
    assert len(re.findall(r"FileScan parquet \[[^\]]*o_custkey", text)) <= 2


@pytest.mark.parametrize("name", ["revenue_pareto", "pareto_running_share", "renewal_by_value_segment"])
def test_ranks_run_no_job_before_the_action(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"build-{name}", "")
    contract.metric_queries()[name](spark, SMALL)
    jobs = tracker.getJobIdsForGroup(f"build-{name}")
    spark.sparkContext.setJobGroup("", "")
    assert list(jobs) == []


def test_a_slice_computes_only_its_segments_and_periods(spark):
    text = contract.metric_queries()["slice_retention_card_short"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "channel" not in text and "Enterprise" not in text and text.count(" AS cohort_size") == 1
    every = contract.metric_queries()["retention_long"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert "channel" in every and "Enterprise" in every


@pytest.mark.parametrize("name", ["retention_long", "retention30_by_channel"])
def test_days_are_words_when_they_are_shuffled(spark, no_broadcast, name):
    """The log is shuffled once, as one row per user and nine weeks; what follows are those rows and the users."""
    text = plan(contract.metric_queries()[name](spark, SMALL)).split("== Initial Plan ==")[-1]
    words = [line for line in text.splitlines() if "partial_bit_or" in line]
    assert words and "activity_date" not in "".join(re.findall(r"hashpartitioning\([^)]*", text))


def test_scan_reads_only_the_needed_columns(spark):
    text = contract.metric_queries()["dau"](spark, SMALL)._jdf.queryExecution().toString()
    (schema,) = set(re.findall(r"ReadSchema: struct<([^>]*)>", text))
    assert schema.split(",") == ["o_custkey:bigint", "o_orderdate:timestamp_ntz"]


def test_status_filter_reaches_the_parquet_scan(spark, hand, tmp_path):
    hand.subscription.write.parquet(str(tmp_path / "s"))
    model = Model(hand.users, hand.activity, spark.read.parquet(str(tmp_path / "s")))
    assert "EqualTo(payment_status,Success)" in plan(revenue.arppu_by_plan(model))


def test_activity_is_collapsed_before_it_is_shuffled(spark, no_broadcast, hand):
    text = plan(user_facts(hand, Rules()))
    assert text.count("hashpartitioning(user_id") == 2  # per (user, day), and the users
    aggregates = [l for l in text.splitlines() if "HashAggregate(keys=[user_id" in l]
    assert any("activity_date" in l and "partial_count" in l for l in aggregates)


def test_annual_payments_are_not_expanded(spark, hand):
    """No generator reads payments: months are made of sums that were shuffled twice at least."""
    text = plan(revenue.mrr_arr(hand)).split("== Initial Plan ==")[-1]
    explode = text.index("Generate explode(sequence")
    assert text.index("Exchange") > explode and text[explode:].count("Exchange hashpartitioning") >= 2


def test_tuning(spark):
    assert tuning.partitions_for(10, at_least=8) == 8
    assert tuning.partitions_for(10**12, at_least=8) == 7451
    assert tuning.partitions_for(10**14, at_least=8) == 745059


def test_input_size_is_that_of_the_columns_that_are_read(spark, hand):
    orders = Path(SMALL, "orders.parquet").stat().st_size
    size = tuning.input_bytes(commerce_model(spark, SMALL))
    assert 0 < size < 2 * orders
