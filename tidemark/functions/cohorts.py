"""Predicates and labels on user columns."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.schema import FREE_PLAN


def is_paid(plan: str = "plan_type") -> Column:
    """On a paid plan now; NULL for an unknown plan."""
    return F.col(plan) != FREE_PLAN


def tier(plan: str = "plan_type") -> Column:
    """``Free`` or ``Paid``; an unknown plan counts as ``Paid``."""
    return F.when(F.col(plan) == FREE_PLAN, "Free").otherwise("Paid")


def slug(value: str) -> str:
    """Column name for a domain value: ``Social Media`` becomes ``social_media``."""
    return value.lower().replace(" ", "_")
