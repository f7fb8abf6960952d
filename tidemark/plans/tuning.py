"""Session settings that the size and skew of the input call for. Call :func:`tune` once per session."""

from pyspark.sql import DataFrame, SparkSession

from tidemark.model import Model
from tidemark.plans.rollups import active_days, payment_rows

BYTES_PER_PARTITION = 128 * 1024 * 1024
_UNKNOWN_SIZE = 2**62  # Spark reports about this much, or more, for relations it cannot size


def input_bytes(model: Model) -> int:
    """Bytes of the columns that metrics read from the larger fact table, by Spark's estimate for the pruned plan.

    Raises for a relation that Spark cannot size: pass the number of partitions to :func:`tune` then.
    """

    def size(df: DataFrame) -> int:
        known = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
        if known >= _UNKNOWN_SIZE:
            raise ValueError("Spark does not know the size of this table")
        return known

    payments = payment_rows(model).select("user_id", "payment_date", "amount")
    return max(size(active_days(model)), size(payments))


def partitions_for(size: int, at_least: int) -> int:
    return max(at_least, -(-size // BYTES_PER_PARTITION))


def tune(spark: SparkSession, partitions: int | None = None) -> None:
    """Let AQE split skewed joins, and start shuffles with so many partitions; it merges small ones afterwards.

    ``partitions_for(input_bytes(model), at_least)`` suggests a number.
    """
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    if partitions is not None:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.initialPartitionNum", str(partitions))
