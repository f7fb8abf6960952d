"""Rolling retention and the cohort grid."""

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.functions.calendar import month_gap, month_of
from tidemark.functions.cohorts import tier
from tidemark.model import Model, Rules
from tidemark.plans.rollups import active_days, user_returns
from tidemark.plans.segments import long_segments


# Segment types of the long table, and the column of each but the first.
SEGMENT_TYPES = ("overall", "channel", "tier")
SEGMENT_COLUMNS = {"channel": "acquisition_channel", "tier": "tier"}


def _eligible(n: int) -> Column:
    return F.col("tenure") >= n


def _retained(n: int) -> Column:
    return _eligible(n) & (F.col("first_return_day") <= n)


def _rate(n: int) -> Column:
    return exact.percent(F.count_if(_retained(n)), F.count_if(_eligible(n)))


def _rates(rules: Rules) -> list[Column]:
    return [_rate(n).alias(f"d{n}_pct") for n in rules.periods]


def retention_overall(model: Model, rules: Rules = Rules()) -> DataFrame:
    """Share of users who came back within N days, among those registered N days ago."""
    return user_returns(model, rules).agg(*_rates(rules))


def retention_by_channel(model: Model, rules: Rules = Rules()) -> DataFrame:
    longest = rules.longest_period
    return (
        user_returns(model, rules, "acquisition_channel")
        .groupBy("acquisition_channel")
        .agg(*_rates(rules), F.count_if(_eligible(longest)).alias("n"))
        .orderBy(F.desc_nulls_last(f"d{longest}_pct"), "acquisition_channel")
    )


def retention_by_tier(model: Model, rules: Rules = Rules()) -> DataFrame:
    return (
        user_returns(model, rules, "plan_type")
        .groupBy(tier().alias("tier"))
        .agg(*_rates(rules), F.count_if(_eligible(rules.longest_period)).alias("n"))
        .orderBy("tier")
    )


def retention_longest_by_plan(model: Model, rules: Rules = Rules()) -> DataFrame:
    """Retention over the longest period (30 days by default) per plan."""
    n = rules.longest_period
    return (
        user_returns(model, rules, "plan_type")
        .groupBy("plan_type")
        .agg(F.count_if(_eligible(n)).alias("n"), _rate(n).alias(f"d{n}_pct"))
        .orderBy(F.desc_nulls_last(f"d{n}_pct"), "plan_type")
    )


# ---- cohort grid ----------------------------------------------------------------


def _cohort_cells(model: Model) -> DataFrame:
    """Users of each register month who were active K calendar months later."""
    cohorts = model.users.select("user_id", month_of("register_date").alias("cohort_month"))
    months = active_days(model).groupBy("user_id").agg(
        F.collect_set(month_of("activity_date")).alias("months")  # as many as the calendar has
    )
    later = F.filter("months", lambda m: m >= F.col("cohort_month"))
    member = F.array(F.lit(None).cast("date"))  # one row for the user beside those of active months
    rows = cohorts.where(F.col("cohort_month").isNotNull()).join(months, "user_id", "left").select(
        "cohort_month", F.explode(F.concat(member, F.coalesce(later, F.array().cast("array<date>")))).alias("active_month")
    )
    gap = month_gap(F.col("cohort_month"), F.col("active_month"))
    size = F.max(F.when(F.col("months_since_register").isNull(), F.col("active_users")))
    return (
        rows.groupBy("cohort_month", gap.alias("months_since_register"))
        .agg(F.count("*").alias("active_users"))
        .withColumn("cohort_users", size.over(Window.partitionBy("cohort_month")))
        .where(F.col("months_since_register").isNotNull())
    )


def cohort_retention(model: Model) -> DataFrame:
    """Long grid; a cell without activity has no row. Do not average over cohorts."""
    return (
        _cohort_cells(model)
        .select(
            "cohort_month",
            "months_since_register",
            "cohort_users",
            "active_users",
            exact.percent(F.col("active_users"), F.col("cohort_users")).alias("retention_pct"),
        )
        .orderBy("cohort_month", "months_since_register")
    )


def cohort_retention_wide(model: Model, months: int = 6) -> DataFrame:
    """Grid with columns ``0`` .. ``months``; NULL where a cell has no activity."""
    share = exact.percent1(F.col("active_users"), F.col("cohort_users"))
    return (
        _cohort_cells(model)
        .where(F.col("months_since_register").between(0, months))
        .withColumn("retention_pct", share)
        .groupBy("cohort_month", "cohort_users")
        .pivot("months_since_register", list(range(months + 1)))
        .agg(F.sum("retention_pct"))
        .orderBy("cohort_month")
    )


# ---- long format and insights ---------------------------------------------------


def retention_long(
    model: Model, rules: Rules = Rules(), segment_types: Iterable[str] = SEGMENT_TYPES, periods: Iterable[int] | None = None
) -> DataFrame:
    """Cohort month x segment x period; cohorts too young for a period give 0 / 0 / NULL.

    Users are counted once per (cohort, channel, tier); the segments are sums of those. Only the segment types and periods
    that are asked for are computed, and only their columns are read.
    """
    wanted = {kind: SEGMENT_COLUMNS[kind] for kind in SEGMENT_COLUMNS if kind in set(segment_types)}
    counts = [
        F.struct(
            F.lit(n).alias("period"),
            F.count_if(_eligible(n)).alias("cohort_size"),
            F.count_if(_retained(n)).alias("retained_users"),
        )
        for n in rules.periods
        if periods is None or n in set(periods)
    ]
    source = {"acquisition_channel": "acquisition_channel", "tier": "plan_type"}
    fine = (
        user_returns(model, rules, *[source[c] for c in wanted.values()])
        .groupBy(
            month_of("register_date").alias("cohort_month"),
            *[tier().alias("tier") if c == "tier" else F.col(c) for c in wanted.values()],
        )
        .agg(F.array(*counts).alias("counts"))
        .select("cohort_month", *wanted.values(), F.inline("counts"))
    )
    return long_segments(
        fine, wanted, ["cohort_size", "retained_users"], by=["cohort_month", "period"], overall="overall" in set(segment_types)
    ).select(
        "cohort_month",
        "segment_type",
        "segment",
        "period",
        "cohort_size",
        "retained_users",
        exact.percent(F.col("retained_users"), F.col("cohort_size")).alias("retention_pct"),
    )


def best_worst_channel(model: Model, rules: Rules = Rules()) -> DataFrame:
    """Channels with the highest and the lowest longest-period retention, ties included."""
    n = rules.longest_period
    rate = f"d{n}_pct"
    everything = Window.partitionBy()
    per_channel = (
        user_returns(model, rules, "acquisition_channel", mature_days=n)
        .groupBy("acquisition_channel")
        .agg(F.count("*").alias("n"), _rate(n).alias(rate))
        .withColumn("highest", F.max(rate).over(everything))
        .withColumn("lowest", F.min(rate).over(everything))
    )
    labels = F.array_compact(
        F.array(
            F.when(F.col(rate) == F.col("highest"), "best"),
            F.when(F.col(rate) == F.col("lowest"), "worst"),
        )
    )
    return per_channel.select(
        F.explode(labels).alias("label"), "acquisition_channel", rate, "n"
    ).orderBy("label", "acquisition_channel")


def paid_free_gap(model: Model, rules: Rules = Rules()) -> DataFrame:
    """Longest-period retention of paid and free users, and the gap in points."""
    n = rules.longest_period
    hundredths = {
        name: exact.half_up(
            F.count_if(_retained(n) & (F.col("tier") == name)),
            F.count_if(_eligible(n) & (F.col("tier") == name)),
            10_000,
        )
        for name in ("Paid", "Free")
    }
    return (
        user_returns(model, rules, "plan_type", mature_days=n)
        .withColumn("tier", tier())
        .agg(hundredths["Paid"].alias("paid"), hundredths["Free"].alias("free"))
        .select(
            exact.money(F.col("paid")).alias(f"paid_d{n}"),
            exact.money(F.col("free")).alias(f"free_d{n}"),
            exact.money(F.col("paid") - F.col("free")).alias("gap_pp"),
        )
    )
