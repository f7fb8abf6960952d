"""A store that grows by batches, next to a full rebuild."""

import glob
import os
from datetime import timedelta

import pytest

from tests.data import random_rows, to_model
from tidemark.operators import growth, quality, retention, revenue, views
from tidemark.plans import refresh
from tidemark.plans.rollups import today


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def split(data, day):
    """Rows up to the day, and those after it or of no day."""
    parts = {"users": 1, "activity": 2, "subscription": 2}
    before = {k: [r for r in data[k] if r[i] is not None and r[i] <= day] for k, i in parts.items()}
    return before, {k: [r for r in data[k] if r not in before[k]] for k in parts}


def files(base):
    return {f: os.path.getmtime(f) for f in glob.glob(f"{base}/**/*.parquet", recursive=True)}


@pytest.mark.parametrize("messy,unit", [(True, "quarter")])
def test_a_store_of_batches_equals_a_full_rebuild(spark, tmp_path, messy, unit):
    data = random_rows(3, n_users=60, messy=messy)
    days = sorted({r[2] for r in data["activity"] if r[2]})
    first, rest = split(data, days[len(days) // 3])
    second, third = split(rest, days[2 * len(days) // 3])
    base = str(tmp_path / "store")
    for batch in (first, second, third):
        store = refresh.add_batch(base, to_model(spark, batch), unit)
    with pytest.raises(ValueError, match="folders per"):
        refresh.add_batch(base, to_model(spark, third), "year")
    whole = to_model(spark, data)
    for name in views.VIEWS:
        assert rows(views.build_view(name, store)) == rows(views.build_view(name, whole)), name
    for metric in (growth.headline_kpis, growth.stickiness, growth.wau_recent, revenue.top_customers, retention.retention_overall,
                   revenue.revenue_pareto, revenue.revenue_by_plan_detail, revenue.cash_revenue_monthly, quality.table_row_counts,
                   quality.orphan_activity, views.latest_kpi_cards):
        assert rows(metric(store)) == rows(metric(whole)), metric
    again = refresh.load_store(spark, base)
    assert rows(growth.headline_kpis(again)) == rows(growth.headline_kpis(whole))


def test_one_more_day_reads_and_writes_its_month_only(spark, tmp_path, monkeypatch):
    data = random_rows(4, n_users=15)
    base = str(tmp_path / "store")
    last = max(r[2] for r in data["activity"])
    refresh.add_batch(base, to_model(spark, data))
    before, record = files(base), {(r.kind, r.month): r.folder for r in refresh.record(spark, base) if r.month}
    day = last.replace(day=1) + timedelta(3)
    batch = {"users": [], "subscription": [], "activity": [
        ("A-new", "U00001", day, 1, 1, "Share"), ("A-new2", "U00001", day, 1, 1, "Share"), ("A-new3", "new", day, 1, 1, "Share"),
    ]}
    read, real = [], refresh._read
    monkeypatch.setattr(refresh, "_read", lambda s, b, kind, folders, schema: read.append((kind, sorted(folders))) or real(s, b, kind, folders, schema))
    monkeypatch.setattr(refresh, "load_store", lambda *a: None)
    refresh.add_batch(base, to_model(spark, batch))
    month = day.replace(day=1)
    merged = [(k, f) for k, f in read if k in refresh._ROLLUPS and f]
    assert merged == [("user_day", [record["user_day", month]])]
    after = files(base)
    assert all(after[f] == t for f, t in before.items())  # nothing is rewritten in place
    new = {(r.kind, r.month): r.folder for r in refresh.record(spark, base) if r.month}
    assert {k for k in new if new[k] != record.get(k)} == {("user_day", month)}
    monkeypatch.undo()
    data["activity"] += batch["activity"]
    store, whole = refresh.load_store(spark, base), to_model(spark, data)
    for name in ("v_mrr_trend", "v_funnel_summary", "cohort_retention_tableau"):
        assert rows(views.build_view(name, store)) == rows(views.build_view(name, whole)), name


def test_today_of_a_store_reads_no_rows(spark, tmp_path):
    data = random_rows(5, n_users=20)
    store = refresh.add_batch(str(tmp_path / "store"), to_model(spark, data))
    df = spark.range(1).select(today(store).alias("day"))
    assert "Relation [" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert df.first().day == max(r[2] for r in data["activity"])


def test_users_with_new_values_replace_old_ones(spark, tmp_path):
    data = random_rows(6, n_users=20)
    base = str(tmp_path / "store")
    refresh.add_batch(base, to_model(spark, data))
    changed = [(*r[:5], "Pro", r[6]) for r in data["users"][:5]]
    store = refresh.add_batch(base, to_model(spark, {"users": changed, "activity": [], "subscription": []}))
    assert rows(store.users) == sorted([*changed, *data["users"][5:]], key=str)


def test_no_store_and_empty_batches(spark, tmp_path, empty):
    with pytest.raises(ValueError, match="no store"):
        refresh.load_store(spark, str(tmp_path / "none"))
    base = str(tmp_path / "store")
    assert growth.headline_kpis(refresh.add_batch(base, empty)).first().total_users == 0
    data = random_rows(7, n_users=10)
    refresh.add_batch(base, to_model(spark, data))
    store = refresh.add_batch(base, empty)
    assert rows(growth.dau(store)) == rows(growth.dau(to_model(spark, data)))
