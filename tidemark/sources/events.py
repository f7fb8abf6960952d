"""A raw event log seen as users and activity, at the grain of days."""

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.model import Model, Rules
from tidemark.schema import SUBSCRIPTION, USERS

# The log covers a month in which users are active almost daily.
RULES = Rules(periods=(1, 3, 7), activation_days=3, activation_events=9,
              retention_days=7, maturity_days=7)


def events_model(spark: SparkSession, folder: str) -> Model:
    """Users register with their first ``signup`` event; profile columns are unknown."""
    columns = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string"
    events = (
        spark.read.schema(columns)
        .parquet(f"{folder}/events.parquet")
        .withColumn("day", F.to_date("ts"))
    )
    unknown = [
        F.lit(None).cast("string").alias(name)
        for name in USERS.fieldNames()
        if name not in ("user_id", "register_date")
    ]
    users = (
        events.where(F.col("event_type") == "signup")
        .groupBy("user_id")
        .agg(F.min("day").alias("register_date"))
        .select("user_id", "register_date", *unknown)
    )
    activity = events.select(
        F.col("event_id").alias("activity_id"),
        "user_id",
        F.col("day").alias("activity_date"),
        F.lit(None).cast("int").alias("session_duration"),
        F.lit(None).cast("int").alias("pages_viewed"),
        F.lit(None).cast("string").alias("feature_used"),
        F.col("ts").alias("stored_time"),
    )
    return Model(
        users, activity, spark.createDataFrame([], SUBSCRIPTION), activity_time="stored_time"
    )
