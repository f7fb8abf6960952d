"""Frames that several metrics share, each reduced before it is shuffled.

A single user, day or segment may hold a large part of all rows. Every frame here
therefore starts with a ``groupBy`` whose partial aggregation collapses such a group
inside each scan task: a user becomes at most one row per day (``user_day``), one row
per month (``user_month``) or one row (``user_revenue``) before it meets a join.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.functions.calendar import month_of
from tidemark.model import Model, Rules
from tidemark.plans.scratch import scratch_path
from tidemark.schema import ANNUAL, MONTHLY, SUCCESS

#: Months that an annual payment covers.
SPREAD = 12
#: Days in a word: nine weeks, and the sign bit stays free.
DAYS = 63


def today(model: Model, days_ago: int = 0) -> Column:
    """Last day with activity, or a day before it, as a scalar subquery.

    The wall clock is never used. The shift is made inside the subquery, so that a
    comparison with a stored date reaches the parquet scan as a plain literal.
    """
    return _today(model, F.date_sub(F.max("activity_date"), days_ago))


def _today(model: Model, value: Column) -> Column:
    source = model.last_day if model.last_day is not None else active_days(model)
    return source.agg(value.alias("day")).scalar()


def first_day(model: Model, days_ago: int) -> Column:
    """The day ``days_ago`` days before today, by the same subquery as the limit of :func:`recent_days`.

    Different subqueries on one table are merged into one with a struct, a field of which does not reach a scan; equal ones stay.
    """
    if model.activity_time is None or model.user_day is not None:
        return today(model, days_ago)
    return _first_time(model, days_ago).cast("date")


def _first_time(model: Model, days_ago: int) -> Column:
    return _today(model, F.date_sub(F.max("activity_date"), days_ago).cast("timestamp_ntz"))


def recent_days(model: Model, days_ago: int) -> DataFrame:
    """:func:`active_days` from ``days_ago`` days before today on.

    On raw activity the limit is put on the stored time column and the partition column, where
    the model names them: a date made from a timestamp would hide it from the scan.
    """
    if model.user_day is not None or model.activity_time is None and model.activity_month is None:
        return active_days(model).where(F.col("activity_date") >= today(model, days_ago))
    first = F.date_sub(F.max("activity_date"), days_ago)
    rows = model.activity
    if model.activity_month is not None:
        rows = rows.where(F.col(model.activity_month) >= _today(model, F.trunc(first, "month")))
    if model.activity_time is not None:
        rows = rows.where(F.col(model.activity_time) >= _first_time(model, days_ago))
    else:
        rows = rows.where(F.col("activity_date") >= _today(model, first))
    return rows.select("user_id", "activity_date")


def side_by_side(*frames: DataFrame) -> DataFrame:
    """The columns of frames of one row each, in one row.

    The rows are stacked and merged. As scalar subqueries, frames on one table would be merged into one scan, and a limit of
    one of them lost; a join of single rows would be a nested loop.
    """
    rows = frames[0]
    for df in frames[1:]:
        rows = rows.unionByName(df, allowMissingColumns=True)
    return rows.agg(*[F.max(c).alias(c) for c in rows.columns])


def active_days(model: Model) -> DataFrame:
    """(user_id, activity_date) for metrics that do not depend on duplicates."""
    source = model.activity if model.user_day is None else model.user_day
    return source.select("user_id", "activity_date")


def user_day(model: Model) -> DataFrame:
    """(user_id, activity_date, sessions): one row per user and active day."""
    if model.user_day is not None:
        return model.user_day
    return model.activity.groupBy("user_id", "activity_date").agg(F.count("*").alias("sessions"))


def day_words(model: Model) -> DataFrame:
    """(user_id, word, days): bit k of ``days`` is set if the user was active on day DAYS * word + k since 1970.

    Words are made in the scan tasks, so of a user's sessions one row in nine weeks is shuffled.
    """
    if model.day_words is not None:
        return model.day_words
    day = F.unix_date("activity_date")
    place = F.pmod(day, F.lit(DAYS))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), place)
    return (
        active_days(model)
        .where(F.col("activity_date").isNotNull())
        .groupBy("user_id", F.call_function("div", day - place, F.lit(DAYS)).alias("word"))
        .agg(F.bit_or(bit).alias("days"))
    )


def user_month(model: Model) -> DataFrame:
    """(user_id, month, day_bits): bit k-1 is set if the user was active on day k."""
    bit = F.call_function("shiftleft", F.lit(1), F.dayofmonth("activity_date") - 1)
    return (
        active_days(model)
        .groupBy("user_id", month_of("activity_date").alias("month"))
        .agg(F.bit_or(bit).alias("day_bits"))
    )


def day_users(model: Model, first: Column | None = None) -> DataFrame:
    """(activity_date, bucket, users): the active users of a day as bit maps over stored user numbers.

    Bit maps of the same bucket unite by ``bitmap_or_agg``, so distinct users of any set of days are counted exactly without
    a shuffle by user. Days from ``first`` on only, if it is given.
    """
    rows = model.day_users
    return rows if first is None else rows.where(F.col("activity_date") >= first)


def _user_numbers(days: DataFrame) -> DataFrame:
    """(user_id, number): the different users of daily rows, numbered from 0 in each partition, so that bit maps are full.

    To be stored before it is used: numbers differ from run to run."""
    users = days.select("user_id").where(F.col("user_id").isNotNull()).distinct()
    return users.withColumn("number", F.monotonically_increasing_id())


def _day_users(days: DataFrame, numbers: DataFrame) -> DataFrame:
    """Days on which only unknown users were active keep a row, with an empty bit map."""
    number = F.col("number")
    return (
        days.select("user_id", "activity_date")
        .join(numbers, "user_id", "left")
        .groupBy("activity_date", F.bitmap_bucket_number(number).alias("bucket"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(number)).alias("users"))
    )


def payment_rows(model: Model) -> DataFrame:
    """Payments, in a model with ``payers`` also of others: sum them per user, then use :func:`of_payers`."""
    return model.subscription if model.payments is None else model.payments


def of_payers(model: Model, per_user: DataFrame) -> DataFrame:
    """The rows of users whose payments count; a join of sums, not of payments."""
    if model.payers is None:
        return per_user
    return per_user.join(model.payers, "user_id", "left_semi")


def successful(model: Model) -> DataFrame:
    """The successful ones of :func:`payment_rows`."""
    stored = F.col("payment_status") == SUCCESS if model.success is None else F.expr(model.success)
    return payment_rows(model).where(stored)


def paid_months(model: Model) -> DataFrame:
    """Successful payments summed per user and month of payment."""
    if model.paid_months is not None:
        return model.paid_months
    kind = F.col("subscription_type")
    in_cents = exact.cents(F.col("amount"))
    rows = (
        successful(model)
        .where(F.col("payment_date").isNotNull())
        .groupBy("user_id", month_of("payment_date").alias("start_month"))
        .agg(
            F.coalesce(F.sum(F.when(kind == MONTHLY, in_cents * SPREAD)), F.lit(0)).alias("short"),
            F.coalesce(F.sum(F.when(kind == ANNUAL, in_cents)), F.lit(0)).alias("spread"),
            F.count_if(kind == MONTHLY).alias("n_short"),
            F.count_if(kind == ANNUAL).alias("n_spread"),
            F.count(F.when(kind == MONTHLY, F.col("amount"))).alias("a_short"),
            F.count(F.when(kind == ANNUAL, F.col("amount"))).alias("a_spread"),
            F.sum(in_cents).alias("cents"),
        )
    )
    return of_payers(model, rows)


def user_revenue(model: Model) -> DataFrame:
    """One row per user with a successful payment."""
    if model.user_revenue is not None:
        return model.user_revenue
    rows = successful(model).groupBy("user_id").agg(
        F.count("*").alias("pay_cnt"),
        F.sum(exact.cents(F.col("amount"))).alias("cents"),
        F.min("payment_date").alias("first_payment"),
        F.max("payment_date").alias("last_payment"),
    )
    return of_payers(model, rows)


def user_facts(
    model: Model, rules: Rules, *dims: str, mature_days: int | None = None
) -> DataFrame:
    """One row per user with everything retention and activation need.

    Columns: ``user_id``, ``register_date``, the user columns named in ``dims``,
    ``tenure`` (days from registration to today), ``first_return_day`` (first active day
    after registration), ``early_sessions`` (sessions on days 0..activation_days) and
    ``first_late_day`` (first active day after activation_days). Active days after
    ``rules.reach`` are ignored; users without activity stay. ``mature_days`` keeps only
    users registered at least that long before today.
    """
    ago = mature_days or 0
    cut = today(model, ago)
    stored = model.facts is not None and model.facts_rules == rules
    users = model.facts if stored else model.users.select("user_id", "register_date", *dims)
    if mature_days is not None:
        users = users.where(F.col("register_date") <= cut)
    rows = users.select("user_id", "register_date", *dims, *FACTS) if stored else _facts(model, rules, users)
    return rows.withColumn("tenure", F.datediff(F.date_add(cut, ago), F.col("register_date")))


def user_returns(model: Model, rules: Rules, *dims: str, mature_days: int | None = None) -> DataFrame:
    """:func:`user_facts` without what depends on sessions or on late days: user_id, register_date, dims, first_return_day, tenure.

    Made from words of days: the first day after registration is the lowest bit of a word that is left when earlier days are cleared.
    """
    columns = ("user_id", "register_date", *dims, "first_return_day", "tenure")
    if model.facts is not None and model.facts_rules == rules:
        return user_facts(model, rules, *dims, mature_days=mature_days).select(*columns)
    ago = mature_days or 0
    cut = today(model, ago)
    users = model.users.select("user_id", "register_date", *dims)
    if mature_days is not None:
        users = users.where(F.col("register_date") <= cut)
    words = day_words(model).withColumnRenamed("user_id", "active_user")
    since, base, days = F.unix_date("register_date"), F.col("word") * DAYS, F.col("days")
    early = since + 1 - base  # bits of the word up to the register date
    mask = F.call_function("shiftleft", F.lit(1).cast("bigint"), early.cast("int")) - 1
    left = F.when(early <= 0, days).otherwise(days - days.bitwiseAND(mask))
    first = base + F.bit_count(left.bitwiseXOR(left - 1)) - 1 - since
    in_reach = (F.col("user_id") == F.col("active_user")) & (base + DAYS > since + 1) & (base <= since + rules.reach)
    return (
        users.join(words, in_reach, "left")
        .groupBy(*users.columns)
        .agg(F.min(F.when((left > 0) & (first <= rules.reach), first)).cast("int").alias("first_return_day"))
        .withColumn("tenure", F.datediff(F.date_add(cut, ago), F.col("register_date")))
        .select(*columns)
    )


#: What :func:`_facts` adds to users.
FACTS = ("first_return_day", "early_sessions", "first_late_day")


def _facts(model: Model, rules: Rules, users: DataFrame) -> DataFrame:
    days = user_day(model).withColumnRenamed("user_id", "active_user")
    offset = F.datediff("activity_date", "register_date")

    return (
        users.join(
            days,
            (F.col("user_id") == F.col("active_user"))
            & (F.col("activity_date") >= F.col("register_date"))
            & (F.col("activity_date") <= F.date_add("register_date", rules.reach)),
            "left",
        )
        .groupBy(*users.columns)
        .agg(
            F.min(F.when(offset > 0, offset)).alias("first_return_day"),
            F.coalesce(
                F.sum(F.when(offset <= rules.activation_days, F.col("sessions"))), F.lit(0)
            ).alias("early_sessions"),
            F.min(F.when(offset > rules.activation_days, offset)).alias("first_late_day"),
        )
    )


def users_with_revenue(model: Model, *dims: str) -> DataFrame:
    """All users with ``pay_cnt`` and ``cents``, NULL where nothing was paid."""
    revenue = user_revenue(model).select("user_id", "pay_cnt", "cents")
    return model.users.select("user_id", *dims).join(revenue, "user_id", "left")


def materialize(model: Model, path: str | None = None, rules: Rules = Rules()) -> Model:
    """Write users and all rollups as parquet and attach them to the model.

    Use it when many metrics run on one model: activity and payments are then read once.
    ``user_facts`` is stored for ``rules``; with others it is computed from the daily rollup.
    The caller owns the folder; without a path it is a new one in the shared folder.
    """
    base = path or scratch_path(model.spark, "rollups")

    def kept(name: str, df: DataFrame) -> DataFrame:
        df.write.mode("overwrite").parquet(f"{base}/{name}")
        return model.spark.read.schema(df.schema).parquet(f"{base}/{name}")

    model = replace(model, users=kept("users", model.tables()["users"]))
    model = replace(model, user_day=kept("user_day", user_day(model)))
    model = replace(model, day_words=kept("day_words", day_words(model)))
    last = active_days(model).agg(F.max("activity_date").alias("activity_date"))
    model = replace(
        model,
        last_day=kept("last_day", last),
        day_users=kept("day_users", _day_users(model.user_day, kept("user_numbers", _user_numbers(model.user_day)))),
        user_revenue=kept("user_revenue", user_revenue(model)),
        paid_months=kept("paid_months", paid_months(model)),
    )
    return replace(model, facts=kept("facts", _facts(model, rules, model.users)), facts_rules=rules)


def materialize_bucketed(model: Model, database: str, buckets: int) -> Model:
    """As :func:`materialize`, into catalog tables bucketed and sorted by ``user_id``.

    ``users`` is bucketed as well, so that joins and aggregations on ``user_id`` need no
    shuffle afterwards. The tables hold at most one row per user and day, so a very
    active user cannot make one bucket much larger than the others.
    """
    frames = {
        "users": model.tables()["users"],
        "user_day": user_day(model),
        "user_revenue": user_revenue(model),
    }
    for name, df in frames.items():
        (
            df.repartition(buckets, "user_id")
            .write.mode("overwrite").format("parquet")
            .bucketBy(buckets, "user_id").sortBy("user_id")
            .saveAsTable(f"{database}.{name}")
        )
    read = model.spark.table
    return replace(
        model,
        users=read(f"{database}.users"),
        user_day=read(f"{database}.user_day"),
        user_revenue=read(f"{database}.user_revenue"),
    )
