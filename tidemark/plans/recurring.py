"""Recurring revenue per month, from changes instead of expanded months.

An annual payment counts in 12 months. Rather than repeating it 12 times, each payment
month contributes an increase where a contribution starts and a decrease where it ends;
a running sum over the few hundred calendar months gives the level. Amounts are carried
in twelfths of a cent, so an annual amount is spread without rounding.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.functions.calendar import month_of, months_until, plus_months
from tidemark.model import Model
from tidemark.plans.rollups import SPREAD, paid_months

_LEVELS = ("users", "payments", "amounts", "twelfths")


def _change(month: Column, **deltas: Column) -> Column:
    """One entry of the change log: a month and what rises or falls in it."""
    values = [
        deltas.get(name, F.lit(0)).cast("bigint").alias(name) for name in ("starts", *_LEVELS)
    ]
    return F.struct(month.alias("month"), *values)


def _amount_changes() -> list[Column]:
    start = F.col("start_month")
    return [
        _change(
            start,
            starts=F.lit(1),
            payments=F.col("n_short") + F.col("n_spread"),
            amounts=F.col("a_short") + F.col("a_spread"),
            twelfths=F.col("short") + F.col("spread"),
        ),
        _change(
            plus_months(start, 1),
            payments=-F.col("n_short"), amounts=-F.col("a_short"), twelfths=-F.col("short"),
        ),
        _change(
            plus_months(start, SPREAD),
            payments=-F.col("n_spread"), amounts=-F.col("a_spread"), twelfths=-F.col("spread"),
        ),
    ]


def _sum_changes(rows: DataFrame, changes: list[Column], *keys: str) -> DataFrame:
    totals = [F.sum(name).alias(name) for name in ("starts", *_LEVELS)]
    return (
        rows.select(*keys, F.inline(F.array(*changes)))
        .groupBy(*keys, "month").agg(*totals)
    )


def _levels(changes: DataFrame, *keys: str) -> DataFrame:
    """Running sums per month, with the months between two changes filled in.

    The calendar runs from the first payment month to twelve months after the last one.
    """
    everything = Window.partitionBy()
    by_month = Window.partitionBy(*keys).orderBy("month")
    so_far = by_month.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = plus_months(F.max(F.when(F.col("starts") > 0, F.col("month"))).over(everything), SPREAD)
    return (
        changes
        .select(
            *keys,
            "month",
            last.alias("last_month"),
            F.lead("month").over(by_month).alias("next_month"),
            *[F.sum(name).over(so_far).alias(name) for name in _LEVELS],
        )
        .select(
            *keys,
            F.explode(
                months_until(
                    F.col("month"),
                    F.coalesce(F.col("next_month"), plus_months(F.col("last_month"), 1)),
                )
            ).alias("month"),
            *_LEVELS,
        )
    )


def recurring_levels(model: Model) -> DataFrame:
    """(month, users, payments, amounts, twelfths) over the whole calendar.

    ``users`` counts distinct payers: per user the covered months are merged into runs,
    and only the first month of a run and the month after it change the count.
    """
    start, until = F.col("start_month"), F.col("run_until")
    in_order = Window.partitionBy("user_id").orderBy("start_month")
    covered_until = F.when(F.col("n_spread") > 0, plus_months(start, SPREAD)).when(
        F.col("n_short") > 0, plus_months(start, 1)
    )
    before = in_order.rowsBetween(Window.unboundedPreceding, -1)
    so_far = in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = (
        paid_months(model)
        .withColumn("covered_until", covered_until)
        .select(
            "*",
            F.max("covered_until").over(before).alias("run_before"),
            F.max("covered_until").over(so_far).alias("run_until"),
            F.lead("start_month").over(in_order).alias("next_start"),
        )
    )
    known = F.col("user_id").isNotNull()
    opens = (
        known
        & F.col("covered_until").isNotNull()
        & (F.col("run_before").isNull() | (start > F.col("run_before")))
    )
    closes = (
        known & (start <= until) & (F.col("next_start").isNull() | (F.col("next_start") > until))
    )
    changes = [
        *_amount_changes(),
        _change(start, users=F.when(opens, 1).otherwise(0)),
        _change(F.coalesce(until, start), users=F.when(closes, -1).otherwise(0)),
    ]
    return _levels(_sum_changes(rows, changes))


def recurring_levels_by_plan(model: Model) -> DataFrame:
    """(is_calendar, plan_type, month, ...) levels per plan, and once for the calendar.

    Payments of unknown users are left out. Rows with ``is_calendar`` cover every
    calendar month and carry no plan.
    """
    paid = paid_months(model).join(model.users.select("user_id", "plan_type"), "user_id")
    per_plan = _sum_changes(paid, _amount_changes(), "plan_type")
    both = per_plan.select(
        F.inline(
            F.array(
                F.struct(F.lit(False).alias("is_calendar"), F.col("plan_type")),
                F.struct(
                    F.lit(True).alias("is_calendar"), F.lit(None).cast("string").alias("plan_type")
                ),
            )
        ),
        "month", "starts", *_LEVELS,
    ).groupBy("is_calendar", "plan_type", "month").agg(
        *[F.sum(name).alias(name) for name in ("starts", *_LEVELS)]
    )
    return _levels(both, "is_calendar", "plan_type")
