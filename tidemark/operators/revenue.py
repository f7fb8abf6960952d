"""Cash and recurring revenue, revenue per user, concentration."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.functions.calendar import month_of, months_until, plus_months
from tidemark.functions.cohorts import is_paid
from tidemark.model import Model
from tidemark.plans.ranking import tile_sums
from tidemark.plans.recurring import recurring_levels, recurring_levels_by_plan
from tidemark.plans.rollups import (
    of_payers,
    paid_months,
    payment_rows,
    user_revenue,
    users_with_revenue,
)
from tidemark.schema import REFUNDED, SUCCESS

# Concentration buckets, as the last percentile of each and its label.
PARETO_BUCKETS = (
    (1, "Top 1%"),
    (10, "Top 10%"),
    (20, "Top 20%"),
    (50, "Top 50%"),
    (100, "Bottom 50%"),
)


# ---- cash -----------------------------------------------------------------------


def cash_revenue_monthly(model: Model) -> DataFrame:
    """Payments by month of payment; revenue and refunds are NULL in a month without any."""
    in_cents = exact.cents(F.col("amount"))
    paid = F.sum(F.when(F.col("payment_status") == SUCCESS, in_cents))
    refunded = F.sum(F.when(F.col("payment_status") == REFUNDED, in_cents))
    per_user = payment_rows(model).groupBy("user_id", month_of("payment_date").alias("month")).agg(
        F.count("*").alias("payments"), paid.alias("paid"), refunded.alias("refunded")
    )
    paid, refunded = F.sum("paid"), F.sum("refunded")
    return (
        of_payers(model, per_user).groupBy("month")
        .agg(
            F.sum("payments").alias("payments"),
            exact.money(paid).alias("revenue"),
            exact.money(refunded).alias("refunded"),
            exact.money(F.coalesce(paid, F.lit(0)) - F.coalesce(refunded, F.lit(0))).alias("net_revenue"),
        )
        .orderBy("month")
    )


# ---- recurring ------------------------------------------------------------------


def _recurring_cents(model: Model) -> DataFrame:
    has_amount = F.col("amounts") > 0
    return recurring_levels(model).select(
        "month",
        F.col("users").alias("paying_users"),
        F.when(has_amount, exact.twelfth(F.col("twelfths"))).alias("mrr_cents"),
        F.when(has_amount, F.col("twelfths")).alias("arr_cents"),
    )


def mrr_arr(model: Model, month_name: str = "month") -> DataFrame:
    """Recognised recurring revenue per calendar month; NULL in months nothing covers."""
    return (
        _recurring_cents(model)
        .select(
            F.col("month").alias(month_name),
            "paying_users",
            exact.money(F.col("mrr_cents")).alias("mrr"),
            exact.money(F.col("arr_cents")).alias("arr"),
        )
        .orderBy(month_name)
    )


def mrr_mom(model: Model) -> DataFrame:
    now = F.col("mrr_cents")
    before = F.lag("mrr_cents").over(Window.orderBy("month"))
    return (
        _recurring_cents(model)
        .select("month", "mrr_cents", before.alias("prev_cents"))
        .select(
            "month",
            exact.money(now).alias("mrr"),
            exact.money(F.col("prev_cents")).alias("prev_mrr"),
            exact.change(now, F.col("prev_cents")).alias("mom_pct"),
        )
        .orderBy("month")
    )


def mrr_by_plan(model: Model) -> DataFrame:
    """Recurring revenue per month and plan; a month nothing covers has a NULL plan."""
    covered = F.max(~F.col("is_calendar") & (F.col("payments") > 0)).over(
        Window.partitionBy("month")
    )
    return (
        recurring_levels_by_plan(model)
        .withColumn("covered", covered)
        .where(
            F.when(F.col("is_calendar"), ~F.col("covered")).otherwise(F.col("payments") > 0)
        )
        .select(
            F.col("month").alias("month_start"),
            "plan_type",
            F.when(F.col("amounts") > 0, exact.money(exact.twelfth(F.col("twelfths")))).alias("mrr"),
        )
        .orderBy("month_start", "plan_type")
    )


# ---- revenue per user -----------------------------------------------------------


def arpu_lifetime(model: Model) -> DataFrame:
    revenue = user_revenue(model).agg(F.sum("cents").alias("cents"))
    cents = F.col("cents")
    return (
        model.users.agg(
            F.count("*").alias("total_users"), F.count_if(is_paid()).alias("paid_users")
        )
        .withColumn("cents", revenue.scalar())
        .select(
            "total_users",
            "paid_users",
            exact.money(cents).alias("total_revenue"),
            exact.money_per(cents, F.col("total_users")).alias("arpu"),
            exact.money_per(cents, F.col("paid_users")).alias("arppu"),
        )
    )


def arpu_running(model: Model) -> DataFrame:
    """Cumulative users, revenue and ARPU for each calendar month with or between signups.

    Revenue outside the span of register months is left out.
    """
    signups = model.users.groupBy(month_of("register_date").alias("month")).agg(
        F.count("*").alias("users"),
        F.count_if(is_paid()).alias("paid_users"),
        F.lit(0).cast("bigint").alias("cents"),
    )
    revenue = (
        paid_months(model)
        .groupBy(F.col("start_month").alias("month"))
        .agg(F.sum("cents").alias("cents"))
        .select(
            "month",
            F.lit(0).cast("bigint").alias("users"),
            F.lit(0).cast("bigint").alias("paid_users"),
            F.coalesce("cents", F.lit(0)).alias("cents"),
        )
    )
    totals = ("users", "paid_users", "cents")
    registered = F.when(F.col("users") > 0, F.col("month"))
    by_month = Window.orderBy("month")
    so_far = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        signups.unionByName(revenue)
        .groupBy("month").agg(*[F.sum(name).alias(name) for name in totals])
        .withColumn("first_month", F.min(registered).over(Window.partitionBy()))
        .withColumn("last_month", F.max(registered).over(Window.partitionBy()))
        .where(F.col("month").between(F.col("first_month"), F.col("last_month")))
        .select(
            "month",
            F.lead("month").over(by_month).alias("next_month"),
            *[F.sum(name).over(so_far).alias(name) for name in totals],
        )
        .select(
            F.explode(
                months_until(
                    F.col("month"),
                    F.coalesce(F.col("next_month"), plus_months(F.col("month"), 1)),
                )
            ).alias("month"),
            F.col("users").alias("cum_users"),
            F.col("paid_users").alias("cum_paid_users"),
            exact.money(F.col("cents")).alias("cum_revenue"),
            exact.money_per(F.col("cents"), F.col("users")).alias("arpu"),
            exact.money_per(F.col("cents"), F.col("paid_users")).alias("arppu"),
        )
        .orderBy("month")
    )


def paid_conversion_overall(model: Model, pct_name: str = "conversion_pct") -> DataFrame:
    paid = F.count_if(is_paid())
    return model.users.agg(
        F.count("*").alias("total_users"),
        paid.alias("paid_users"),
        exact.percent(paid, F.count("*")).alias(pct_name),
    )


def paid_conversion_by_cohort(model: Model) -> DataFrame:
    paid = F.count_if(is_paid())
    return (
        model.users.groupBy(month_of("register_date").alias("register_month"))
        .agg(
            F.count("*").alias("users"),
            paid.alias("paid"),
            exact.percent(paid, F.count("*")).alias("conversion_pct"),
        )
        .orderBy("register_month")
    )


# ---- revenue by segment ---------------------------------------------------------


def revenue_segments(model: Model, dim: str) -> DataFrame:
    """(dim, users, paying_users, cents): payers have at least one successful payment."""
    return users_with_revenue(model, dim).groupBy(dim).agg(
        F.count("*").alias("users"),
        F.count("pay_cnt").alias("paying_users"),
        F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"),
    )


def _share() -> Column:
    return exact.percent(F.col("cents"), F.sum("cents").over(Window.partitionBy()))


def revenue_by_plan_detail(model: Model) -> DataFrame:
    """Revenue per plan where a payer is anyone with a payment row, whatever its status."""
    in_cents = F.when(F.col("payment_status") == SUCCESS, exact.cents(F.col("amount")))
    payments = of_payers(model, payment_rows(model).groupBy("user_id").agg(
        F.count("*").alias("payments"), F.sum(in_cents).alias("cents")
    ))
    return (
        model.users.select("user_id", "plan_type")
        .join(payments, "user_id", "left")
        .groupBy("plan_type")
        .agg(
            F.count("*").alias("users"),
            F.count("payments").alias("paying_users"),
            F.coalesce(F.sum("cents"), F.lit(0)).alias("cents"),
        )
        .select(
            "plan_type",
            "users",
            "paying_users",
            exact.money(F.col("cents")).alias("revenue"),
            _share().alias("revenue_share_pct"),
            exact.money_per(F.col("cents"), F.col("paying_users")).alias("arppu"),
        )
        .orderBy(F.desc("revenue"), "plan_type")
    )


def revenue_by_channel(model: Model) -> DataFrame:
    return (
        revenue_segments(model, "acquisition_channel")
        .select(
            "acquisition_channel",
            "users",
            "paying_users",
            exact.percent(F.col("paying_users"), F.col("users")).alias("conversion_pct"),
            exact.money(F.col("cents")).alias("revenue"),
            exact.money_per(F.col("cents"), F.col("users")).alias("arpu"),
            exact.money_per(F.col("cents"), F.col("paying_users")).alias("arppu"),
            _share().alias("revenue_share_pct"),
        )
        .orderBy(F.desc("revenue"), "acquisition_channel")
    )


def revenue_by_plan(model: Model) -> DataFrame:
    return (
        revenue_segments(model, "plan_type")
        .select(
            "plan_type",
            "users",
            "paying_users",
            exact.money(F.col("cents")).alias("revenue"),
            _share().alias("revenue_share_pct"),
            exact.money_per(F.col("cents"), F.col("paying_users")).alias("arppu"),
        )
        .orderBy(F.desc("revenue"), "plan_type")
    )


def arpu_arppu_by_plan(model: Model) -> DataFrame:
    return (
        revenue_segments(model, "plan_type")
        .select(
            "plan_type",
            "users",
            "paying_users",
            exact.money_per(F.col("cents"), F.col("users")).alias("arpu"),
            exact.money_per(F.col("cents"), F.col("paying_users")).alias("arppu"),
        )
        .orderBy(F.desc_nulls_last("arppu"), "plan_type")
    )


def arppu_by_plan(model: Model) -> DataFrame:
    """Revenue per payer for the plans that have payers."""
    return (
        model.users.select("user_id", "plan_type")
        .join(user_revenue(model).select("user_id", "cents"), "user_id")
        .groupBy("plan_type")
        .agg(F.count("*").alias("paying_users"), F.sum("cents").alias("cents"))
        .select(
            "plan_type",
            "paying_users",
            exact.money(F.col("cents")).alias("revenue"),
            exact.money_per(F.col("cents"), F.col("paying_users")).alias("arppu"),
        )
        .orderBy(F.desc_nulls_last("arppu"), "plan_type")
    )


def top_channels_by_revenue(model: Model, k: int = 3) -> DataFrame:
    return (
        model.users.select("user_id", "acquisition_channel")
        .join(user_revenue(model).select("user_id", "cents"), "user_id")
        .groupBy("acquisition_channel")
        .agg(exact.money(F.sum("cents")).alias("revenue"))
        .orderBy(F.desc_nulls_last("revenue"), "acquisition_channel")
        .limit(k)
    )


# ---- concentration --------------------------------------------------------------


def top_customers(model: Model, k: int = 10) -> DataFrame:
    """Users with the highest lifetime revenue; ties go to the smaller ``user_id``."""
    profile = ("user_id", "country", "acquisition_channel", "plan_type", "company_size")
    return (
        model.users.select(*profile)
        .join(user_revenue(model), "user_id")
        .orderBy(F.desc_nulls_last("cents"), F.asc("user_id"))
        .limit(k)
        .select(
            *profile,
            exact.money(F.col("cents")).alias("lifetime_revenue"),
            F.col("pay_cnt").alias("payment_count"),
            "first_payment",
            "last_payment",
        )
    )


def top_customers_table(model: Model, k: int = 10) -> DataFrame:
    """The dashboard form: ``payments`` for the count, without the first payment."""
    return (
        top_customers(model, k)
        .withColumnRenamed("payment_count", "payments")
        .drop("first_payment")
    )


def _pareto(model: Model) -> DataFrame:
    """Payers by revenue percentile."""
    lasts = [last for last, _ in PARETO_BUCKETS]
    parts = tile_sums(user_revenue(model).select("user_id", "cents"), "cents", "user_id", lasts, 100, cents=F.col("cents"))
    names, first = [F.lit(name) for _, name in PARETO_BUCKETS], [F.lit(last + 1) for last in (0, *lasts)]
    return parts.select(
        F.get(F.array(*names), F.col("part")).alias("segment"),
        F.get(F.array(*first), F.col("part")).alias("sort_order"),
        F.col("n").alias("users"),
        "cents",
        exact.half_up(F.col("cents"), F.sum("cents").over(Window.partitionBy()), 10_000).alias("share"),
    )


def revenue_pareto(model: Model) -> DataFrame:
    """Payers by revenue percentile in exclusive buckets: ``Top 10%`` is percentiles 2..10."""
    return _pareto(model).orderBy("sort_order").select(
        "segment",
        "sort_order",
        "users",
        exact.money(F.col("cents")).alias("revenue"),
        exact.money(F.col("share")).alias("share_pct"),
    )


def pareto_running_share(model: Model) -> DataFrame:
    to_date = Window.orderBy("sort_order").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return _pareto(model).select(
        "segment",
        "sort_order",
        "users",
        exact.money(F.col("cents")).alias("revenue"),
        exact.money(F.col("share")).alias("share_pct"),
        exact.money(F.sum("share").over(to_date)).alias("cum_share_pct"),
    ).orderBy("sort_order")
