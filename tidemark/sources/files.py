"""Readers and writers of the three input tables."""

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tidemark.functions.calendar import month_of
from tidemark.model import Model
from tidemark.operators.quality import require_keys
from tidemark.schema import ACTIVITY, PRIMARY_KEYS, SUBSCRIPTION, TABLES, USERS

#: (month, first_day, last_day) of a written model's activity.
ACTIVITY_DAYS = "activity_days"


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with a header line; columns are taken by position and must fit the schema."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("mode", "FAILFAST")
        .csv(path)
    )


@dataclass(frozen=True)
class CheckedLoad:
    """Rows of a CSV table that fit its schema; (file, line) of those that do not; and (file, loaded, rejected) per file."""

    rows: DataFrame
    rejected: DataFrame
    counts: DataFrame


_BAD_LINE = "bad_line"


def load_checked(spark: SparkSession, name: str, path: str, folder: str) -> CheckedLoad:
    """Load a CSV table and put aside the lines that do not fit its schema, instead of failing at the first one.

    The files are parsed once: rows and rejected lines are written below ``folder``, which the caller owns, and read from there.
    All columns are parsed, whichever are asked for later, so what is rejected does not depend on the query.
    """
    schema = TABLES[name]
    lines = (
        spark.read.schema(StructType([*schema.fields, StructField(_BAD_LINE, StringType())]))
        .option("header", True)
        .option("encoding", "UTF-8")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _BAD_LINE)
        .option("columnPruning", False)
        .csv(path)
    )
    sorted_out = lines.select("*", F.col("_metadata.file_path").alias("file"), F.col(_BAD_LINE).isNotNull().alias("rejected"))
    sorted_out.write.mode("overwrite").partitionBy("rejected").parquet(folder)
    read = spark.read.schema(sorted_out.schema).parquet(folder)
    counts = read.groupBy("file").agg(F.count_if(~F.col("rejected")).alias("loaded"), F.count_if("rejected").alias("rejected"))
    return CheckedLoad(
        read.where(~F.col("rejected")).select(*schema.fieldNames()),
        read.where("rejected").select("file", F.col(_BAD_LINE).alias("line")),
        counts,
    )


def load_users(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, USERS)


def load_activity(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, ACTIVITY)


def load_subscription(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, SUBSCRIPTION)


def load_csv_model(spark: SparkSession, folder: str, check_keys: bool = True) -> Model:
    """The three CSV files of a folder; raises if a primary key is not unique."""
    model = Model(
        load_users(spark, f"{folder}/users.csv"),
        load_activity(spark, f"{folder}/activity.csv"),
        load_subscription(spark, f"{folder}/subscription.csv"),
    )
    return require_keys(model) if check_keys else model


def write_csv_table(model: Model, name: str, folder: str) -> None:
    columns = TABLES[name].fieldNames()
    model.tables()[name].select(*columns).write.mode("overwrite").option("header", True).csv(
        f"{folder}/{name}.csv"
    )


def write_csv_model(model: Model, folder: str) -> None:
    """Write the three tables as CSV folders that :func:`load_csv_model` reads back."""
    for name in TABLES:
        write_csv_table(model, name, folder)


def write_parquet_model(model: Model, folder: str) -> None:
    """Write the tables as parquet, the fact tables in folders per month.

    Rows are range-partitioned by month and key first: a folder gets few files, and a
    month that holds much of the data is still written by many tasks. The first and last day of
    each month with activity go to a table of their own.
    """
    model.users.write.mode("overwrite").parquet(f"{folder}/users")
    for name, day in (("activity", "activity_date"), ("subscription", "payment_date")):
        (
            model.tables()[name]
            .withColumn("month", month_of(day))
            .repartitionByRange("month", PRIMARY_KEYS[name])
            .write.mode("overwrite").partitionBy("month").parquet(f"{folder}/{name}")
        )
    days = model.spark.read.parquet(f"{folder}/activity").groupBy("month").agg(
        F.min("activity_date").alias("first_day"), F.max("activity_date").alias("last_day")
    )
    days.coalesce(1).write.mode("overwrite").parquet(f"{folder}/{ACTIVITY_DAYS}")


def load_parquet_model(spark: SparkSession, folder: str) -> Model:
    """The written tables; limits on days open only the folders of their months, and today is read from the table of days."""
    read = spark.read
    days = read.parquet(f"{folder}/{ACTIVITY_DAYS}")
    return Model(
        read.parquet(f"{folder}/users"),
        read.parquet(f"{folder}/activity"),
        read.parquet(f"{folder}/subscription").drop("month"),
        activity_month="month",
        last_day=days.select(F.col("last_day").alias("activity_date")),
    )


def register_tables(model: Model) -> None:
    for name, df in model.tables().items():
        df.createOrReplaceTempView(name)
