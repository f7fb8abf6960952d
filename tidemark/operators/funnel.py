"""Activation, conversion, renewal, and the nested five-stage funnel."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.functions.cohorts import is_paid
from tidemark.model import Model, Rules
from tidemark.plans.ranking import tile_sums
from tidemark.plans.rollups import user_facts, user_returns, user_revenue
from tidemark.plans.segments import long_segments

# Funnel stages and the labels of segments.
STAGES = ("Registered", "Activated", "Retained", "Paid", "Renewed")
ACTIVATED, NOT_ACTIVATED = "Activated", "Not Activated"
VALUE_SEGMENTS = ((1, "Top 10% (whales)"), (5, "Top 11-50% (mid)"), (10, "Bottom 50% (tail)"))


def _mature(model: Model, rules: Rules, *dims: str) -> DataFrame:
    return user_facts(model, rules, *dims, mature_days=rules.maturity_days)


def _activated(rules: Rules) -> Column:
    return F.col("early_sessions") >= rules.activation_events


def _returned(rules: Rules) -> Column:
    """Active on a day 1..retention_days."""
    return F.col("first_return_day") <= rules.retention_days


def _stayed(rules: Rules) -> Column:
    """Active after the activation window, up to day retention_days."""
    return F.col("first_late_day") <= rules.retention_days


def _segment(rules: Rules) -> Column:
    return F.when(_activated(rules), ACTIVATED).otherwise(NOT_ACTIVATED)


def _rate(flag: Column, users: str, hits: str, pct: str) -> list[Column]:
    """Group size, members with the flag, and their share."""
    hit = F.count_if(flag)
    return [
        F.count("*").alias(users),
        hit.alias(hits),
        exact.percent(hit, F.count("*")).alias(pct),
    ]


def _by(df: DataFrame, dim: str, columns: list[Column], pct: str) -> DataFrame:
    return df.groupBy(dim).agg(*columns).orderBy(F.desc_nulls_last(pct), dim)


# ---- activation -----------------------------------------------------------------


def activation_overall(model: Model, rules: Rules = Rules()) -> DataFrame:
    return _mature(model, rules).agg(
        *_rate(_activated(rules), "eligible_users", "activated_users", "activation_pct")
    )


def _activation_by(model: Model, rules: Rules, dim: str) -> DataFrame:
    columns = _rate(_activated(rules), "users", "activated", "activation_pct")
    return _by(_mature(model, rules, dim), dim, columns, "activation_pct")


def activation_by_channel(model: Model, rules: Rules = Rules()) -> DataFrame:
    return _activation_by(model, rules, "acquisition_channel")


def activation_by_plan(model: Model, rules: Rules = Rules()) -> DataFrame:
    return _activation_by(model, rules, "plan_type")


def activation_analysis(model: Model, rules: Rules = Rules()) -> DataFrame:
    """Activation overall, per channel and per plan, in long format."""
    fine = (
        _mature(model, rules, "acquisition_channel", "plan_type")
        .groupBy("acquisition_channel", "plan_type")
        .agg(F.count("*").alias("users"), F.count_if(_activated(rules)).alias("activated"))
    )
    dims = {"channel": "acquisition_channel", "plan": "plan_type"}
    return long_segments(fine, dims, ["users", "activated"]).withColumn(
        "activation_pct", exact.percent(F.col("activated"), F.col("users"))
    )


# ---- retention of the eligible --------------------------------------------------


def retention30_overall(model: Model, rules: Rules = Rules()) -> DataFrame:
    return user_returns(model, rules, mature_days=rules.maturity_days).agg(
        *_rate(_returned(rules), "eligible_users", "retained_users", "retention_pct")
    )


def retention30_by_channel(model: Model, rules: Rules = Rules()) -> DataFrame:
    columns = _rate(_returned(rules), "users", "retained", "retention_pct")
    dim = "acquisition_channel"
    users = user_returns(model, rules, dim, mature_days=rules.maturity_days)
    return _by(users, dim, columns, "retention_pct")


def retention30_by_activation(
    model: Model, rules: Rules = Rules(), after_activation: bool = False
) -> DataFrame:
    """Retention of activated users and of the others.

    The standard window is days 1..retention_days, in which activated users are nearly
    always retained; ``after_activation`` starts it after the activation window instead.
    """
    flag = _stayed(rules) if after_activation else _returned(rules)
    return (
        _mature(model, rules)
        .groupBy(_segment(rules).alias("segment"))
        .agg(*_rate(flag, "users", "retained", "retention_pct"))
        .orderBy("segment")
    )


# ---- paid conversion ------------------------------------------------------------


def paid_by_channel(model: Model) -> DataFrame:
    columns = _rate(is_paid(), "users", "paid", "paid_pct")
    return _by(model.users, "acquisition_channel", columns, "paid_pct")


def paid_by_activation(model: Model, rules: Rules = Rules()) -> DataFrame:
    return (
        _mature(model, rules, "plan_type")
        .groupBy(_segment(rules).alias("segment"))
        .agg(*_rate(is_paid(), "users", "paid", "paid_pct"))
        .orderBy("segment")
    )


def activation_lift(model: Model, rules: Rules = Rules()) -> DataFrame:
    """Retention and paid share of activated users beside those of the others."""
    _, retained, retention_pct = _rate(_returned(rules), "users", "retained_users", "retention_pct")
    users, paid, paid_pct = _rate(is_paid(), "users", "paid_users", "paid_pct")
    return (
        _mature(model, rules, "plan_type")
        .groupBy(_segment(rules).alias("segment"))
        .agg(users, retained, retention_pct, paid, paid_pct)
        .orderBy("segment")
    )


def paid_conversion_analysis(model: Model) -> DataFrame:
    """Paid share overall, per channel, device and company size, in long format."""
    dims = {
        "channel": "acquisition_channel",
        "device": "device_type",
        "company_size": "company_size",
    }
    fine = model.users.groupBy(*dims.values()).agg(
        F.count("*").alias("users"), F.count_if(is_paid()).alias("paid")
    )
    return long_segments(fine, dims, ["users", "paid"]).withColumn(
        "paid_pct", exact.percent(F.col("paid"), F.col("users"))
    )


# ---- renewal --------------------------------------------------------------------


def _renewed() -> Column:
    """At least two successful payments."""
    return F.col("pay_cnt") >= 2


def _renewal(*, average: bool = True) -> list[Column]:
    columns = _rate(_renewed(), "paying_users", "renewed", "renewal_pct")
    if average:
        columns.append(exact.average(F.sum("pay_cnt"), F.count("*")).alias("avg_payments"))
    return columns


def _payers(model: Model, *dims: str) -> DataFrame:
    payments = user_revenue(model).select("user_id", "pay_cnt")
    return model.users.select("user_id", *dims).join(payments, "user_id")


def renewal_overall(model: Model) -> DataFrame:
    return user_revenue(model).agg(*_renewal())


def renewal_by_plan(model: Model) -> DataFrame:
    return _by(_payers(model, "plan_type"), "plan_type", _renewal(), "renewal_pct")


def renewal_by_channel(model: Model) -> DataFrame:
    dim = "acquisition_channel"
    return _by(_payers(model, dim), dim, _renewal(average=False), "renewal_pct")


def renewal_by_value_segment(model: Model) -> DataFrame:
    """Renewal of the top revenue decile, deciles 2..5, and the rest."""
    amount = F.col("cents")
    parts = tile_sums(
        user_revenue(model).select("user_id", "pay_cnt", "cents"), "cents", "user_id", [last for last, _ in VALUE_SEGMENTS], 10,
        amounts=amount, counted=F.when(amount.isNotNull(), 1).otherwise(0), renewals=_renewed().cast("bigint"),
    )
    name = F.get(F.array(*[F.lit(n) for _, n in VALUE_SEGMENTS]), F.col("part"))
    return parts.orderBy("part").select(
        name.alias("value_segment"),
        F.col("n").alias("users"),
        exact.money_per(F.col("amounts"), F.col("counted")).alias("avg_lifetime_rev"),
        F.col("renewals").alias("renewed"),
        exact.percent(F.col("renewals"), F.col("n")).alias("renewal_pct"),
    )


def renewal_analysis(model: Model) -> DataFrame:
    """Renewal overall, per channel and per plan, in long format."""
    fine = (
        _payers(model, "acquisition_channel", "plan_type")
        .groupBy("acquisition_channel", "plan_type")
        .agg(
            F.count("*").alias("paying_users"),
            F.count_if(_renewed()).alias("renewed_users"),
            F.sum("pay_cnt").alias("payments"),
        )
    )
    dims = {"channel": "acquisition_channel", "plan": "plan_type"}
    sums = ["paying_users", "renewed_users", "payments"]
    return long_segments(fine, dims, sums).select(
        "segment_type",
        "segment",
        "paying_users",
        "renewed_users",
        exact.percent(F.col("renewed_users"), F.col("paying_users")).alias("renewal_pct"),
        exact.average(F.col("payments"), F.col("paying_users")).alias("avg_payments"),
    )


# ---- funnel ---------------------------------------------------------------------


def funnel_stages(model: Model, rules: Rules = Rules()) -> DataFrame:
    """One row per stage, each a subset of the one before.

    Columns: step_order, stage, users, step_conversion_pct, overall_conversion_pct.
    """
    payments = user_revenue(model).select("user_id", "pay_cnt")
    conditions = [_activated(rules), _stayed(rules), is_paid(), _renewed()]
    reached, counts = F.lit(True), []
    for condition in conditions:
        reached = reached & condition
        counts.append(F.count_if(reached))

    stages = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("step_order"),
                F.lit(stage).alias("stage"),
                F.col(stage).alias("users"),
                F.col(STAGES[max(i - 1, 0)]).alias("previous"),
                F.col(STAGES[0]).alias("registered"),
            )
            for i, stage in enumerate(STAGES)
        ]
    )
    hundred = F.lit(100.0)
    first = F.col("step_order") == 1
    return (
        _mature(model, rules, "plan_type")
        .join(payments, "user_id", "left")
        .agg(
            F.count("*").alias(STAGES[0]),
            *[count.alias(stage) for count, stage in zip(counts, STAGES[1:])],
        )
        .select(F.inline(stages))
        .select(
            "step_order",
            "stage",
            "users",
            F.when(first, hundred)
            .otherwise(exact.percent(F.col("users"), F.col("previous")))
            .alias("step_conversion_pct"),
            F.when(first, hundred)
            .otherwise(exact.percent(F.col("users"), F.col("registered")))
            .alias("overall_conversion_pct"),
        )
    )


def funnel_summary(model: Model, rules: Rules = Rules()) -> DataFrame:
    """The funnel in its report form."""
    return (
        funnel_stages(model, rules)
        .orderBy("step_order")
        .select(
            "stage",
            "users",
            F.col("step_conversion_pct").alias("step_pct"),
            F.col("overall_conversion_pct").alias("overall_pct"),
        )
    )
