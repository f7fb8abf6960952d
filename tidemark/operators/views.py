"""The nine tables that dashboards read, and their filters."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.model import Model, Rules
from tidemark.operators import funnel, growth, retention, revenue
from tidemark.plans.rollups import side_by_side, user_revenue
from tidemark.schema import size_order


@dataclass(frozen=True)
class View:
    dashboard: str
    primary_use: str
    build: Callable[[Model, Rules], DataFrame]


# View names and the dashboards they feed.
VIEWS: dict[str, View] = {
    "v_mrr_trend": View(
        "D1 / D4", "MRR and ARR over time",
        lambda m, r: revenue.mrr_arr(m, month_name="month_start"),
    ),
    "v_funnel_summary": View(
        "D1 / D2", "five-stage funnel", funnel.funnel_stages
    ),
    "v_revenue_by_channel": View(
        "D1 / D4", "revenue share per channel", lambda m, r: revenue.revenue_by_channel(m)
    ),
    "v_revenue_by_plan": View(
        "D1 / D4", "revenue share per plan", lambda m, r: revenue.revenue_by_plan(m)
    ),
    "v_activation_analysis": View(
        "D2", "activation per channel and plan", funnel.activation_analysis
    ),
    "v_paid_conversion": View(
        "D2 / D4", "paid share per channel, device and company size",
        lambda m, r: funnel.paid_conversion_analysis(m),
    ),
    "cohort_retention_tableau": View(
        "D3", "cohort heat map", lambda m, r: retention.cohort_retention(m)
    ),
    "retention_tableau": View(
        "D3", "retention curves per channel and tier", retention.retention_long
    ),
    "v_renewal_analysis": View(
        "D4", "renewal and mean number of payments", lambda m, r: funnel.renewal_analysis(m)
    ),
}


def build_view(name: str, model: Model, rules: Rules = Rules()) -> DataFrame:
    return VIEWS[name].build(model, rules)


def register_views(model: Model, rules: Rules = Rules(), names: Iterable[str] = VIEWS) -> None:
    """Create or replace the named temporary views; they are computed when read."""
    for name in names:
        build_view(name, model, rules).createOrReplaceTempView(name)


def ensure_views(model: Model, rules: Rules = Rules(), required: Iterable[str] = VIEWS) -> list[str]:
    """Create the required views that do not exist yet, and return their names."""
    required = list(required)
    unknown = [name for name in required if name not in VIEWS]
    if unknown:
        raise ValueError(f"no such view: {', '.join(unknown)}")
    missing = [name for name in required if not model.spark.catalog.tableExists(name)]
    register_views(model, rules, missing)
    return missing


def view_row_counts(model: Model, names: Iterable[str] = VIEWS) -> DataFrame:
    """(view_name, row_count) of registered views."""
    spark = model.spark
    counts = None
    for name in names:
        one = spark.table(name).agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("view_name"), "row_count"
        )
        counts = one if counts is None else counts.unionByName(one)
    return counts


# ---- filters --------------------------------------------------------------------

# Columns a date or channel filter applies to, where a view has them.
DATE_COLUMNS = ("month_start", "month", "cohort_month", "register_date", "activity_date")
CHANNEL_COLUMN = "acquisition_channel"


def slice_rows(
    df: DataFrame,
    *,
    segment_type: str | None = None,
    segment: str | None = None,
    period: int | None = None,
    max_months: int | None = None,
    first_date: date | None = None,
    last_date: date | None = None,
    channels: Iterable[str] | None = None,
    plans: Iterable[str] | None = None,
    ignore_missing: bool = False,
) -> DataFrame:
    """Dashboard filters. One that names a column the table lacks raises, or with ``ignore_missing`` leaves it unchanged."""
    day = next((name for name in DATE_COLUMNS if name in df.columns), DATE_COLUMNS[0])
    tests = (
        ("segment_type", segment_type, Column.__eq__),
        ("segment", segment, Column.__eq__),
        ("period", period, Column.__eq__),
        ("months_since_register", max_months, Column.__le__),
        (day, first_date, Column.__ge__),
        (day, last_date, Column.__le__),
    )
    for column, value, test in tests:
        if value is None:
            continue
        if column in df.columns:
            df = df.where(test(F.col(column), F.lit(value)))
        elif not ignore_missing:
            raise ValueError(f"the table has no column {column}")
    for column, kind, values in (
        (CHANNEL_COLUMN, "channel", channels),
        ("plan_type", "plan", plans),
    ):
        if values is None:
            continue
        values = list(values)
        if column in df.columns:
            df = df.where(F.col(column).isin(values))
        elif "segment_type" in df.columns:
            df = df.where((F.col("segment_type") != kind) | F.col("segment").isin(values))
        elif not ignore_missing:
            raise ValueError(f"the table has no column {column} and no segments")
    return df


def with_size_order(df: DataFrame, column: str = "company_size") -> DataFrame:
    """Add ``size_order``, the natural order of company sizes."""
    return df.withColumn("size_order", size_order(F.col(column)))


def paid_by_company_size(model: Model) -> DataFrame:
    """Paid share per company size, from small to large."""
    sizes = slice_rows(funnel.paid_conversion_analysis(model), segment_type="company_size")
    return with_size_order(sizes, "segment").orderBy(F.asc_nulls_last("size_order"), "segment")


def activation_by_segment(model: Model, kind: str, rules: Rules = Rules()) -> DataFrame:
    return slice_rows(funnel.activation_analysis(model, rules), segment_type=kind).orderBy(
        F.desc_nulls_last("activation_pct"), "segment"
    )


# ---- cards and scatter ----------------------------------------------------------


def latest_kpi_cards(model: Model) -> DataFrame:
    """(kpi, value): users, trailing MAU, MRR of the last payment month, ARPU, conversion, renewal."""
    last_month = user_revenue(model).agg(F.trunc(F.max("last_payment"), "month").alias("m"))
    mrr = (
        revenue.mrr_arr(model)
        .where(F.col("month") == last_month.scalar())
        .agg(F.max("mrr").alias("mrr"))
    )
    renewal = user_revenue(model).agg(
        F.sum("cents").alias("cents"),
        exact.percent(F.count_if(F.col("pay_cnt") >= 2), F.count("*")).alias("renewal_pct"),
    )
    cards = {
        "total_users": F.col("total_users").cast("double"),
        "mau": F.col("mau").cast("double"),
        "mrr": F.col("mrr"),
        "arpu": exact.money_per(F.col("cents"), F.col("total_users")),
        "conversion_pct": exact.percent(F.col("paid_users"), F.col("total_users")),
        "renewal_pct": F.col("renewal_pct"),
    }
    rows = F.array(
        *[F.struct(F.lit(k).alias("kpi"), v.alias("value")) for k, v in cards.items()]
    )
    return side_by_side(growth.headline_kpis(model), mrr, renewal).select(F.inline(rows))


def channel_quality_quadrants(model: Model) -> DataFrame:
    """Conversion against ARPU per channel, with the plain averages over channels."""
    everything = Window.partitionBy()
    conversion = exact.half_up(F.col("paying_users"), F.col("users"), 10_000)
    arpu = exact.half_up(F.col("cents"), F.col("users"))

    def mean(column: str):
        return exact.money(
            exact.half_up(F.sum(column).over(everything), F.count(column).over(everything))
        )

    return (
        revenue.revenue_segments(model, "acquisition_channel")
        .select("acquisition_channel", "users", conversion.alias("c"), arpu.alias("a"))
        .select(
            "acquisition_channel",
            "users",
            exact.money(F.col("c")).alias("conversion_pct"),
            exact.money(F.col("a")).alias("arpu"),
            mean("c").alias("avg_conversion_pct"),
            mean("a").alias("avg_arpu"),
        )
        .orderBy("acquisition_channel")
    )
