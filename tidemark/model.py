"""The input frames of every metric, and the adjustable constants."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark import schema


@dataclass(frozen=True)
class Model:
    """Three input tables, plus optional materialised rollups of them.

    The second group of fields is about storage; metrics give the same rows without it, from
    plans that read more. ``activity_time`` names a stored timestamp column of ``activity`` whose
    date is ``activity_date``, ``activity_month`` a partition column with its month: limits on days
    are put on these, so that they reach the scan. ``payments`` are rows of ``subscription`` before
    they are restricted to the users in ``payers``, so that they can be summed before that join;
    ``success`` is the condition for a successful payment on a stored column.

    ``last_day`` has days in ``activity_date`` of which the latest is today; a written model has one for each month.

    The third group holds what :mod:`tidemark.plans.rollups` would otherwise compute per query;
    attach it with :func:`tidemark.plans.rollups.materialize`.
    """

    users: DataFrame
    activity: DataFrame
    subscription: DataFrame

    activity_time: str | None = None
    activity_month: str | None = None
    payments: DataFrame | None = None
    payers: DataFrame | None = None
    success: str | None = None

    user_day: DataFrame | None = None
    user_revenue: DataFrame | None = None
    paid_months: DataFrame | None = None
    last_day: DataFrame | None = None
    day_users: DataFrame | None = None
    day_words: DataFrame | None = None
    facts: DataFrame | None = None
    facts_rules: Rules | None = None

    @property
    def spark(self) -> SparkSession:
        return self.users.sparkSession

    def tables(self) -> dict[str, DataFrame]:
        """The tables with just the columns of their schemas."""
        frames = {"users": self.users, "activity": self.activity, "subscription": self.subscription}
        return {name: df.select(*schema.TABLES[name].fieldNames()) for name, df in frames.items()}


@dataclass(frozen=True)
class Rules:
    """Windows and thresholds, in days; the defaults are the standard definitions."""

    periods: tuple[int, ...] = (1, 7, 30)
    activation_days: int = 7
    activation_events: int = 3
    retention_days: int = 30
    maturity_days: int = 30
    channels: tuple[str, ...] = schema.CHANNELS
    plans: tuple[str, ...] = schema.PLANS

    @property
    def longest_period(self) -> int:
        return max(self.periods)

    @property
    def reach(self) -> int:
        """Last day after registration that any per-user fact looks at."""
        return max(self.longest_period, self.activation_days, self.retention_days)
