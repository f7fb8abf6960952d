"""Known results on the hand rows (today is 2025-01-01)."""

from datetime import date

from tests.data import d
from tidemark.model import Rules
from tidemark.operators import funnel, retention, revenue, views


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_retention(hand):
    assert rows(retention.retention_overall(hand)) == [(50.0, 62.5, 57.14)]


def test_funnel(hand):
    got = rows(funnel.funnel_summary(hand).select("stage", "users"))
    assert got == [("Registered", 7), ("Activated", 4), ("Retained", 2), ("Paid", 2), ("Renewed", 1)]


def test_funnel_percentages(hand):
    got = rows(funnel.funnel_stages(hand))
    assert got[0][3:] == (100.0, 100.0)
    assert got[4] == (5, "Renewed", 1, 50.0, 14.29)


def test_retention_by_activation(hand):
    got = rows(funnel.retention30_by_activation(hand))
    assert got == [("Activated", 4, 3, 75.0), ("Not Activated", 3, 1, 33.33)]


def test_retention_after_the_activation_window(hand):
    got = rows(funnel.retention30_by_activation(hand, after_activation=True))
    assert got == [("Activated", 4, 2, 50.0), ("Not Activated", 3, 0, 0.0)]


def test_cohorts(hand):
    got = {(r[0], r[1]): (r[2], r[3]) for r in rows(retention.cohort_retention(hand))}
    assert got == {
        (d("2024-01-01"), 0): (2, 2),
        (d("2024-01-01"), 1): (2, 1),
        (d("2024-03-01"), 0): (4, 2),
        (d("2024-03-01"), 1): (4, 1),
        (d("2024-12-01"), 0): (2, 2),
        (d("2025-01-01"), 0): (1, 1),
    }


def test_wide_cohorts_leave_empty_cells_null(hand):
    got = retention.cohort_retention_wide(hand).collect()
    assert got[0].asDict() == {
        "cohort_month": d("2024-01-01"), "cohort_users": 2, "0": 100.0, "1": 50.0,
        "2": None, "3": None, "4": None, "5": None, "6": None,
    }


def test_recurring_revenue(hand):
    got = {r[0]: r[1:] for r in rows(revenue.mrr_arr(hand))}
    assert got[d("2024-02-01")] == (2, 198.00, 2376.00)
    assert got[d("2024-03-01")] == (4, 262.18, 3146.10)
    assert got[d("2024-04-01")] == (2, 64.18, 770.10)
    for year, month in [(2024, m) for m in range(5, 13)] + [(2025, 1), (2025, 2)]:
        assert got[date(year, month, 1)] == (1, 29.18, 350.10)
    assert got[d("2025-03-01")] == got[d("2025-04-01")] == (0, None, None)
    assert len(got) == 15


def test_payer_definitions_differ(hand):
    any_status = {r[0]: r[2:4] for r in rows(revenue.revenue_by_plan_detail(hand))}
    successful = {r[0]: r[2:4] for r in rows(revenue.revenue_by_plan(hand))}
    assert any_status == {"Pro": (2, 420.10), "Enterprise": (2, 396.0), "Basic": (2, 0.0), "Free": (0, 0.0)}
    assert successful == {"Pro": (2, 420.10), "Enterprise": (2, 396.0), "Basic": (0, 0.0), "Free": (0, 0.0)}
    arppu = {r["plan_type"]: r["arppu"] for r in revenue.revenue_by_plan(hand).collect()}
    assert arppu["Basic"] is None and arppu["Free"] is None


def test_renewal(hand):
    assert rows(funnel.renewal_overall(hand)) == [(4, 3, 75.0, 1.75)]


def test_young_cohort_keeps_its_rows(hand):
    got = views.slice_rows(
        retention.retention_long(hand), segment_type="overall",
        first_date=d("2025-01-01"), last_date=d("2025-01-31"),
    )
    assert {r[3:] for r in rows(got)} == {(1, 0, 0, None), (7, 0, 0, None), (30, 0, 0, None)}


def test_gap(hand):
    paid, free, gap = rows(retention.paid_free_gap(hand))[0]
    assert (paid, free, gap) == (60.0, 50.0, 10.0)


def test_ties_go_to_the_smaller_user_id(hand):
    got = [r[0] for r in rows(revenue.top_customers(hand, 4))]
    assert got == ["h2", "h8", "h9", "h1"]


def test_tiles_with_few_payers_are_ranks(hand):
    got = rows(revenue.pareto_running_share(hand))
    # 4 payers: 350.10, 198, 198, 70 of 816.10
    assert got == [
        ("Top 1%", 1, 1, 350.10, 42.90, 42.90),
        ("Top 10%", 2, 3, 466.00, 57.10, 100.00),
    ]


def test_rates_without_anyone_are_null(empty):
    rules = Rules()
    assert rows(retention.retention_overall(empty, rules)) == [(None, None, None)]
    assert rows(funnel.activation_overall(empty, rules)) == [(0, 0, None)]
    assert rows(funnel.activation_analysis(empty, rules)) == [("overall", "all", 0, 0, None)]
    assert rows(revenue.mrr_arr(empty)) == []
