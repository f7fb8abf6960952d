"""Checks on the input tables: keys, references, sizes, coverage."""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.functions.cohorts import is_paid
from tidemark.model import Model
from tidemark.plans.rollups import of_payers, payment_rows
from tidemark.schema import FAILED, PRIMARY_KEYS, REFUNDED, SUCCESS


def key_violations(df: DataFrame, table_name: str, key: str) -> DataFrame:
    """Number of distinct key values used more than once, and of rows without a key."""
    uses = df.groupBy(F.col(key).alias("key_value")).agg(F.count("*").alias("uses"))
    missing = F.col("key_value").isNull()
    return uses.agg(
        F.count_if((F.col("uses") > 1) & ~missing).alias("dup_keys"),
        F.coalesce(F.sum(F.when(missing, F.col("uses"))), F.lit(0)).alias("null_keys"),
    ).select(
        F.lit(table_name).alias("table_name"), F.lit(key).alias("pk"), "dup_keys", "null_keys"
    )


def pk_violations(model: Model) -> DataFrame:
    checks = [key_violations(df, name, PRIMARY_KEYS[name]) for name, df in model.tables().items()]
    return reduce(DataFrame.unionByName, checks)


def offending_keys(df: DataFrame, table_name: str, key: str) -> DataFrame:
    """(table_name, key_value, uses) of each key that is missing (null) or used more than once: what :func:`key_violations` counts."""
    uses = df.groupBy(F.col(key).cast("string").alias("key_value")).agg(F.count("*").alias("uses"))
    return uses.where((F.col("uses") > 1) | F.col("key_value").isNull()).select(F.lit(table_name).alias("table_name"), "key_value", "uses")


def integrity_report(model: Model) -> DataFrame:
    """(table_name, problem, key_value, uses): keys that are missing or used twice, and unknown users with their number of rows."""
    tables = model.tables()
    keys = [
        offending_keys(df, name, PRIMARY_KEYS[name]).withColumn("problem", F.when(F.col("key_value").isNull(), "missing key").otherwise("repeated key"))
        for name, df in tables.items()
    ]
    users = tables["users"].select("user_id")
    unknown = [
        tables[name].groupBy("user_id").agg(F.count("*").alias("uses")).join(users, "user_id", "left_anti").select(
            F.lit(name).alias("table_name"), F.col("user_id").cast("string").alias("key_value"), "uses", F.lit("unknown user").alias("problem")
        )
        for name in ("activity", "subscription")
    ]
    return reduce(DataFrame.unionByName, keys + unknown).select("table_name", "problem", "key_value", "uses")


def require_keys(model: Model) -> Model:
    """Return the model, or raise if a primary key is missing or used twice."""
    broken = pk_violations(model).where("dup_keys > 0 OR null_keys > 0").collect()
    if broken:
        raise ValueError("primary key violated: " + "; ".join(map(str, broken)))
    return model


def _orphans(fact: DataFrame, users: DataFrame, table_name: str) -> DataFrame:
    """Rows whose user is unknown; counted per user first, so no user is a hot join key."""
    per_user = fact.groupBy("user_id").agg(F.count("*").alias("n"))
    return (
        per_user.join(users.select("user_id"), "user_id", "left_anti")
        .agg(F.coalesce(F.sum("n"), F.lit(0)).alias("orphans"))
        .select(F.lit(table_name).alias("table_name"), "orphans")
    )


def orphan_activity(model: Model) -> DataFrame:
    return _orphans(model.activity, model.users, "activity")


def orphan_subscription(model: Model) -> DataFrame:
    return _orphans(model.subscription, model.users, "subscription")


def table_row_counts(model: Model) -> DataFrame:
    counts = [
        df.agg(F.count("*").alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, df in model.tables().items()
    ]
    return reduce(DataFrame.unionByName, counts)


def preview(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """First ``n`` rows by key."""
    return df.orderBy(F.col(key).asc_nulls_last()).limit(n)


def describe_table(df: DataFrame) -> DataFrame:
    """Column names and types."""
    rows = [(f.name, f.dataType.simpleString()) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "col_name string, data_type string")


def list_tables(model: Model) -> DataFrame:
    """Tables and views of the session's current database, by name."""
    spark = model.spark
    rows = [(t.name,) for t in spark.catalog.listTables()]
    return spark.createDataFrame(rows, "name string").orderBy("name")


def date_coverage(model: Model) -> DataFrame:
    activity = model.activity.agg(
        F.struct(
            F.min("activity_date").alias("first_activity"),
            F.max("activity_date").alias("last_activity"),
        ).alias("span")
    )
    return (
        model.users.agg(
            F.min("register_date").alias("first_register"),
            F.max("register_date").alias("last_register"),
        )
        .withColumn("span", activity.scalar())
        .select("first_register", "last_register", "span.*")
    )


def channel_conversion_check(model: Model) -> DataFrame:
    """Paid share per channel, best first."""
    paid = F.count_if(is_paid())
    return (
        model.users.groupBy("acquisition_channel")
        .agg(
            F.count("*").alias("total_users"),
            paid.alias("paid_users"),
            exact.percent(paid, F.count("*")).alias("conversion_pct"),
        )
        .orderBy(F.desc("conversion_pct"), "acquisition_channel")
    )


def payments_sanity(model: Model) -> DataFrame:
    status = F.col("payment_status")
    per_user = payment_rows(model).groupBy("user_id").agg(
        F.count("*").alias("total_records"),
        F.count_if(status == SUCCESS).alias("success"),
        F.count_if(status == FAILED).alias("failed"),
        F.count_if(status == REFUNDED).alias("refunded"),
        F.min("payment_date").alias("first_payment"),
        F.max("payment_date").alias("last_payment"),
        F.sum(F.when(status == SUCCESS, exact.cents(F.col("amount")))).alias("cents"),
    )
    counts = ("total_records", "success", "failed", "refunded")
    return of_payers(model, per_user).agg(
        *[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in counts],
        F.min("first_payment").alias("first_payment"),
        F.max("last_payment").alias("last_payment"),
        exact.money(F.sum("cents")).alias("total_revenue"),
    )
