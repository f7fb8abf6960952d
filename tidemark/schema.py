"""Fixed schemas and value domains of the three input tables."""

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

USERS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("register_date", T.DateType()),
    T.StructField("country", T.StringType()),
    T.StructField("device_type", T.StringType()),
    T.StructField("acquisition_channel", T.StringType()),
    T.StructField("plan_type", T.StringType()),
    T.StructField("company_size", T.StringType()),
])

ACTIVITY = T.StructType([
    T.StructField("activity_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("activity_date", T.DateType()),
    T.StructField("session_duration", T.IntegerType()),
    T.StructField("pages_viewed", T.IntegerType()),
    T.StructField("feature_used", T.StringType()),
])

SUBSCRIPTION = T.StructType([
    T.StructField("subscription_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("payment_date", T.DateType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("subscription_type", T.StringType()),
    T.StructField("payment_status", T.StringType()),
])

TABLES = {"users": USERS, "activity": ACTIVITY, "subscription": SUBSCRIPTION}

PRIMARY_KEYS = {
    "users": "user_id",
    "activity": "activity_id",
    "subscription": "subscription_id",
}

# The domains of the input columns, in their natural order.
CHANNELS = ("Organic", "Social Media", "Google Ads", "Email")
PLANS = ("Free", "Basic", "Pro", "Enterprise")
COMPANY_SIZES = ("1-10", "11-50", "51-200", "201-1000", "1000+")
FREE_PLAN = "Free"
MONTHLY, ANNUAL = "Monthly", "Annual"
SUCCESS, FAILED, REFUNDED = "Success", "Failed", "Refunded"


def size_order(size: Column) -> Column:
    """1-based position of a company size in :data:`COMPANY_SIZES`, NULL if unknown."""
    return F.nullif(F.array_position(F.array(*map(F.lit, COMPANY_SIZES)), size), F.lit(0)).cast("int")
