"""Active users, signups, cumulative growth and headline numbers.

Windows without a partition appear only over rows that are already aggregated to one
per day, month or segment.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.functions.calendar import month_of, week_of
from tidemark.functions.cohorts import is_paid, slug
from tidemark.model import Model, Rules
from tidemark.plans.rollups import (
    active_days,
    day_users,
    first_day,
    recent_days,
    side_by_side,
    user_month,
)


# ---- user mix -------------------------------------------------------------------


def mix(model: Model, dim: str, share_name: str = "pct") -> DataFrame:
    """Users per value of ``dim`` and their share of all users."""
    return (
        model.users.groupBy(dim).agg(F.count("*").alias("users"))
        .withColumn(share_name, exact.percent(F.col("users"), F.sum("users").over(Window.partitionBy())))
        .orderBy(F.desc("users"), dim)
    )


def mix_by_plan(model: Model, share_name: str = "pct") -> DataFrame:
    return mix(model, "plan_type", share_name)


def mix_by_channel(model: Model, share_name: str = "pct") -> DataFrame:
    return mix(model, "acquisition_channel", share_name)


def total_registered(model: Model) -> DataFrame:
    return model.users.agg(F.count("*").alias("total_registered"))


# ---- active users ---------------------------------------------------------------


def _united(days: DataFrame, *by: Column | str) -> DataFrame:
    """Bit maps of users united over days, one per bucket and ``by``."""
    return days.groupBy(*by, "bucket").agg(F.bitmap_or_agg("users").alias("users"))


def _active_users(model: Model, bucket: Column, name: str, out: str, days: int | None = None):
    if model.day_users is not None:
        rows = day_users(model, None if days is None else first_day(model, days))
        return _united(rows, bucket.alias(name)).groupBy(name).agg(F.sum(F.bitmap_count("users")).alias(out))
    rows = active_days(model) if days is None else recent_days(model, days)
    return rows.groupBy(bucket.alias(name)).agg(F.count_distinct("user_id").alias(out))


def _daily(model: Model, days: int | None = None) -> DataFrame:
    if model.user_day is None or model.day_users is not None:
        return _active_users(model, F.col("activity_date"), "activity_date", "dau", days)
    rows = active_days(model) if days is None else recent_days(model, days)
    return rows.groupBy("activity_date").agg(F.count("user_id").alias("dau"))


def dau(model: Model) -> DataFrame:
    return _daily(model).orderBy(F.asc_nulls_last("activity_date"))


def dau_recent_stats(model: Model, days: int = 30) -> DataFrame:
    """Mean, peak and lowest DAU since ``days`` before today (both ends included)."""
    return _daily(model, days).agg(
        exact.average0(F.sum("dau"), F.count("dau")).alias("avg_dau_30d"),
        F.max("dau").alias("peak_dau"),
        F.min("dau").alias("min_dau"),
    )


def top_dau_days(model: Model, k: int = 10) -> DataFrame:
    return _daily(model).orderBy(F.desc("dau"), "activity_date").limit(k)


def wau(model: Model) -> DataFrame:
    return _active_users(model, week_of("activity_date"), "week_start", "wau").orderBy(
        F.asc_nulls_last("week_start")
    )


def wau_recent(model: Model, days: int = 56) -> DataFrame:
    """WAU since ``days`` before today; the first week is usually partial."""
    return _active_users(model, week_of("activity_date"), "week_start", "wau", days).orderBy(
        F.asc_nulls_last("week_start")
    )


def _monthly_active(model: Model) -> DataFrame:
    return _active_users(model, month_of("activity_date"), "month", "mau")


def mau(model: Model) -> DataFrame:
    return _monthly_active(model).orderBy(F.asc_nulls_last("month"))


def mau_mom(model: Model) -> DataFrame:
    """MAU against the previous row; a month without activity has no row."""
    previous = F.lag("mau").over(Window.orderBy(F.asc_nulls_last("month")))
    return (
        _monthly_active(model)
        .withColumn("prev_mau", previous)
        .withColumn("mom_pct", exact.change(F.col("mau"), F.col("prev_mau")))
        .orderBy(F.asc_nulls_last("month"))
    )


def _user_days(model: Model) -> DataFrame:
    """(month, user_days, days, mau)"""
    if model.day_users is not None:
        month = month_of("activity_date").alias("month")
        daily = day_users(model).groupBy("activity_date").agg(F.sum(F.bitmap_count("users")).alias("dau"))
        daily = daily.groupBy(month).agg(F.sum("dau").alias("user_days"), F.count("*").cast("int").alias("days"))
        return daily.join(_active_users(model, month_of("activity_date"), "month", "mau"), "month")
    user_days = F.sum(F.when(F.col("user_id").isNotNull(), F.bit_count("day_bits")))
    return user_month(model).groupBy("month").agg(
        F.coalesce(user_days, F.lit(0)).alias("user_days"),
        F.bit_count(F.bit_or("day_bits")).alias("days"),
        F.count("user_id").alias("mau"),
    )


def stickiness(model: Model) -> DataFrame:
    """Mean DAU over the active days of a month, and its share of MAU.

    The sum of DAU over a month is the sum of active days over its users, so one pass
    over (user, month) day masks gives DAU and MAU together.
    """
    return (
        _user_days(model)
        .where(F.col("month").isNotNull())
        .select(
            "month",
            exact.average0(F.col("user_days"), F.col("days")).alias("avg_dau"),
            "mau",
            exact.percent(F.col("user_days"), F.col("days") * F.col("mau")).alias("stickiness_pct"),
        )
        .orderBy(F.asc_nulls_last("month"))
    )


# ---- signups --------------------------------------------------------------------


def _signups(model: Model, *by: Column) -> DataFrame:
    return model.users.groupBy(*by).agg(F.count("*").alias("new_users"))


def _register_month() -> Column:
    return month_of("register_date").alias("month")


def _running(order: str, *partition: str) -> Column:
    window = Window.partitionBy(*partition).orderBy(F.asc_nulls_last(order)).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return F.sum("new_users").over(window)


def signups_daily(model: Model) -> DataFrame:
    return _signups(model, F.col("register_date")).orderBy(F.asc_nulls_last("register_date"))


def signups_monthly(model: Model) -> DataFrame:
    return _signups(model, _register_month()).orderBy(F.asc_nulls_last("month"))


def signups_monthly_cum(model: Model) -> DataFrame:
    return (
        _signups(model, _register_month())
        .withColumn("cum_users", _running("month"))
        .orderBy(F.asc_nulls_last("month"))
    )


def _signups_wide(model: Model, dim: str, values: tuple[str, ...]) -> DataFrame:
    counts = [F.count_if(F.col(dim) == value).alias(slug(value)) for value in values]
    return (
        model.users.groupBy(_register_month())
        .agg(*counts, F.count("*").alias("total"))
        .orderBy(F.asc_nulls_last("month"))
    )


def signups_monthly_by_channel(model: Model, rules: Rules = Rules()) -> DataFrame:
    return _signups_wide(model, "acquisition_channel", rules.channels)


def signups_monthly_by_plan(model: Model, rules: Rules = Rules()) -> DataFrame:
    return _signups_wide(model, "plan_type", rules.plans)


def signups_monthly_channel_long(model: Model) -> DataFrame:
    return _signups(model, _register_month(), F.col("acquisition_channel")).orderBy(
        F.asc_nulls_last("month"), "acquisition_channel"
    )


def cum_users_daily(model: Model) -> DataFrame:
    return (
        _signups(model, F.col("register_date"))
        .withColumn("cum_users", _running("register_date"))
        .orderBy(F.asc_nulls_last("register_date"))
    )


def cum_users_monthly_mom_yoy(model: Model) -> DataFrame:
    """Running total with growth against 1 and 12 rows before."""
    by_month = Window.orderBy(F.asc_nulls_last("month"))
    new = F.col("new_users")
    return (
        _signups(model, _register_month())
        .select(
            "month",
            "new_users",
            _running("month").alias("cum_users"),
            exact.change(new, F.lag("new_users", 1).over(by_month)).alias("mom_pct"),
            exact.change(new, F.lag("new_users", 12).over(by_month)).alias("yoy_pct"),
        )
        .orderBy(F.asc_nulls_last("month"))
    )


def cum_users_by_channel(model: Model) -> DataFrame:
    return (
        _signups(model, _register_month(), F.col("acquisition_channel"))
        .withColumn("cum_users", _running("month", "acquisition_channel"))
        .orderBy(F.asc_nulls_last("month"), "acquisition_channel")
    )


# ---- headline -------------------------------------------------------------------


def _recently_active(model: Model) -> DataFrame:
    """One row (dau_today, wau, mau): users of today and of the last 7 and 30 days.

    A user was active in the last N days exactly if their last active day was, so one
    row per recently active user answers all three windows.
    """
    windows = {"dau_today": 1, "wau": 7, "mau": 30}
    first = first_day(model, 30 - 1)

    def inside(day: str, n: int) -> Column:
        return F.col(day) >= F.date_add(first, 30 - n)

    if model.day_users is not None:
        days = day_users(model, first)
        united = days.groupBy("bucket").agg(*[
            F.bitmap_or_agg(F.when(inside("activity_date", n), F.col("users"))).alias(name) for name, n in windows.items()
        ])
        return united.agg(*[F.coalesce(F.sum(F.bitmap_count(name)), F.lit(0)).alias(name) for name in windows])
    recent = (
        recent_days(model, 30 - 1)
        .where(F.col("user_id").isNotNull())
        .groupBy("user_id")
        .agg(F.max("activity_date").alias("last_day"))
    )
    return recent.agg(*[F.count_if(inside("last_day", n)).alias(name) for name, n in windows.items()])


def headline_kpis(model: Model) -> DataFrame:
    """One row of dashboard numbers; wau and mau are trailing 7 and 30 days here."""
    people = model.users.agg(
        F.count("*").alias("total_users"),
        F.count_if(is_paid()).alias("paid_users"),
        F.count_if(F.col("register_date") >= first_day(model, 30 - 1)).alias("new_users_30d"),
    )
    columns = ("total_users", "paid_users", "dau_today", "wau", "mau", "new_users_30d")
    return side_by_side(people, _recently_active(model)).select(*columns)
