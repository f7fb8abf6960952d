"""A stored model that grows by batches of new rows: only the months that a batch touches are read and written.

A store is a folder. Raw rows of a batch go to a folder of their own. Rollups that merge by month (active days, payments per user
and month, users by month of registration) are kept in one folder per month; a batch reads those of its months, merges its own
rollups into them and writes them anew. Which folders count is said by the record, a small table that every batch writes again
under the next version. Until then readers see the state before the batch, and a batch that failed leaves nothing behind but
folders that no record names. A record also has the first and last day of each month, so that today is known without a scan.

One batch at a time may be added to a store.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import exact
from tidemark.model import Model
from tidemark.plans.rollups import of_payers, paid_months, successful, user_day
from tidemark.schema import PRIMARY_KEYS, TABLES

_RECORD = "version int, unit string, kind string, month date, folder string, first_day date, last_day date"
#: Raw tables and the day that puts a row into its month.
_RAW = {"activity": "activity_date", "subscription": "payment_date"}


def _payments(model: Model, unit: str) -> DataFrame:
    """Successful payments per user and month of payment, also of unknown day: what revenue per user is the sum of."""
    rows = successful(model).groupBy("user_id", F.trunc("payment_date", unit).alias("month")).agg(
        F.count("*").alias("pay_cnt"),
        F.sum(exact.cents(F.col("amount"))).alias("cents"),
        F.min("payment_date").alias("first_payment"),
        F.max("payment_date").alias("last_payment"),
    )
    return of_payers(model, rows)


def _payment_sums(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy("user_id", *by).agg(
        F.sum("pay_cnt").alias("pay_cnt"), F.sum("cents").alias("cents"),
        F.min("first_payment").alias("first_payment"), F.max("last_payment").alias("last_payment"),
    )


def _summed(*keys: str) -> Callable[[DataFrame, DataFrame], DataFrame]:
    def merge(old: DataFrame, new: DataFrame) -> DataFrame:
        rows = old.unionByName(new)
        return rows.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in rows.columns if c not in keys])

    return merge


def _replaced(old: DataFrame, new: DataFrame) -> DataFrame:
    """New rows take the place of old ones of the same user."""
    return old.join(new.select("user_id"), "user_id", "left_anti").unionByName(new)


@dataclass(frozen=True)
class _Rollup:
    make: Callable[[Model, str], DataFrame]
    merge: Callable[[DataFrame, DataFrame], DataFrame]
    day: str | None = None


_ROLLUPS = {
    "users": _Rollup(lambda m, unit: m.tables()["users"].withColumn("month", F.trunc("register_date", unit)), _replaced),
    "user_day": _Rollup(
        lambda m, unit: user_day(m).withColumn("month", F.trunc("activity_date", unit)),
        _summed("user_id", "activity_date", "month"), "activity_date",
    ),
    "paid_months": _Rollup(
        lambda m, unit: paid_months(m).withColumn("month", F.trunc("start_month", unit)), _summed("user_id", "start_month", "month")
    ),
    "payments": _Rollup(_payments, lambda old, new: _payment_sums(old.unionByName(new), "month")),
}


def record(spark: SparkSession, base: str) -> list:
    """Rows (version, unit, kind, month, folder, first_day, last_day) of the latest version; none if there is no store yet.

    As many as the calendar has months, and batches."""
    try:
        rows = spark.read.schema(_RECORD).parquet(f"{base}/record")
    except AnalysisException:
        return []
    latest = rows.agg(F.max("version")).scalar()
    return rows.where(F.col("version") == latest).collect()


def _read(spark: SparkSession, base: str, kind: str, folders: Iterable[str], schema: T.StructType) -> DataFrame:
    """Rows of the folders of one kind, with the month from their names."""
    folders = sorted(folders)
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", f"{base}/{kind}").parquet(*folders).select(*schema.fieldNames())


def _folder(month: date | None) -> str:
    return f"month={month if month is not None else '__HIVE_DEFAULT_PARTITION__'}"


def _write(df: DataFrame, path: str, key: str = "user_id") -> None:
    """One folder per month. Ranges of (month, key) make few files of a small month and let many tasks write a large one."""
    df.repartitionByRange("month", key).write.mode("overwrite").partitionBy("month").parquet(path)


def add_batch(base: str, batch: Model, unit: str = "month") -> Model:
    """Add the rows of a batch to the store in the folder (made if there is none), and return the stored model.

    ``batch`` has new rows only: users that are new, or known ones with new values but the same register_date, and activity and
    payments that were not added before. A batch without rows changes nothing. ``unit`` is the span of a folder, month, quarter
    or year, and the same for all batches: thin logs do better with fewer folders.
    """
    spark = batch.spark
    known = record(spark, base)
    if any(r.unit != unit for r in known):
        raise ValueError(f"the store in {base} has folders per {known[0].unit}")
    version = 1 + max((r.version for r in known), default=0)
    raw = {}
    for name, day in _RAW.items():
        path = f"{base}/{name}/batch={version}"
        _write(batch.tables()[name].withColumn("month", F.trunc(day, unit)), path, PRIMARY_KEYS[name])
        raw[name] = path
    rows = {
        name: _read(spark, base, name, [path], _raw_schema(batch, name)).drop("month") for name, path in raw.items()
    }
    written = Model(batch.tables()["users"], rows["activity"], rows["subscription"])
    now = {(r.kind, r.month, r.folder if r.kind in _RAW else None): r for r in known}
    for kind, rollup in _ROLLUPS.items():
        new = rollup.make(written, unit)
        months = {r.month for r in new.select("month").distinct().collect()}
        if not months:
            continue
        old = _read(spark, base, kind, [now[kind, m, None].folder for m in months if (kind, m, None) in now], new.schema)
        path = f"{base}/{kind}/version={version}"
        _write(rollup.merge(old, new), path)
        bounds = {}
        if rollup.day:
            days = spark.read.parquet(path).groupBy("month").agg(F.min(rollup.day).alias("a"), F.max(rollup.day).alias("b"))
            bounds = {r.month: (r.a, r.b) for r in days.collect()}
        for month in months:
            now[kind, month, None] = (kind, month, f"{path}/{_folder(month)}", *bounds.get(month, (None, None)))
    for name, path in raw.items():
        now[name, None, path] = (name, None, path, None, None)
    entries = [(version, unit, *(r if not hasattr(r, "folder") else (r.kind, r.month, r.folder, r.first_day, r.last_day))) for r in now.values()]
    spark.createDataFrame(entries, _RECORD).coalesce(1).write.mode("append").parquet(f"{base}/record")
    return load_store(spark, base, _schemas(batch, unit))


def _raw_schema(batch: Model, name: str) -> T.StructType:
    return T.StructType([*batch.tables()[name].schema.fields, T.StructField("month", T.DateType())])


def _schemas(model: Model, unit: str) -> dict[str, T.StructType]:
    out = {kind: rollup.make(model, unit).schema for kind, rollup in _ROLLUPS.items()}
    return out | {name: _raw_schema(model, name) for name in _RAW}


def load_store(spark: SparkSession, base: str, schemas: dict[str, T.StructType] | None = None) -> Model:
    """The stored model, with its rollups attached. Without schemas, columns have the types of :mod:`tidemark.schema`."""
    rows = record(spark, base)
    if not rows:
        raise ValueError(f"there is no store in {base}")
    if schemas is None:
        empty = {name: spark.createDataFrame([], schema) for name, schema in TABLES.items()}
        schemas = _schemas(Model(**empty), rows[0].unit)
    read = {k: _read(spark, base, k, [r.folder for r in rows if r.kind == k], s) for k, s in schemas.items()}
    days = [(r.last_day,) for r in rows if r.kind == "user_day"]
    return Model(
        read["users"].drop("month"),
        read["activity"] if rows[0].unit == "month" else read["activity"].drop("month"),
        read["subscription"].drop("month"),
        activity_month="month" if rows[0].unit == "month" else None,
        user_day=read["user_day"].drop("month"),
        paid_months=read["paid_months"].drop("month"),
        user_revenue=_payment_sums(read["payments"]),
        last_day=spark.createDataFrame(days, "activity_date date"),
    )
