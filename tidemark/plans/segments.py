"""Long-format segment tables from one pass over the rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def long_segments(
    fine: DataFrame, dims: dict[str, str], sums: list[str], by: list[str] | None = None, overall: bool = True
) -> DataFrame:
    """Roll ``fine`` up to (``segment_type``, ``segment``): overall and one set per dimension.

    ``fine`` must already be counted per combination of the dimension columns; only those
    few rows are repeated per segment type, never the user-level rows. ``overall`` leaves
    the rows of all users out if it is False. Without ``by`` there is always an overall row, also when ``fine`` is empty. A NULL dimension value
    stays a segment of its own.
    """
    by = by or []

    def label(kind, value):
        return F.struct(F.lit(kind).alias("segment_type"), value.alias("segment"))

    labels = [label("overall", F.lit("all"))] if overall else []
    labels += [label(kind, F.col(column).cast("string")) for kind, column in dims.items()]
    rows = fine.select(*by, *sums, F.inline(F.array(*labels)))
    if not by and overall:
        nothing = fine.sparkSession.range(1).select(
            *[F.lit(0).cast("bigint").alias(name) for name in sums],
            F.lit("overall").alias("segment_type"),
            F.lit("all").alias("segment"),
        )
        rows = rows.unionByName(nothing)
    return rows.groupBy(*by, "segment_type", "segment").agg(
        *[F.sum(name).alias(name) for name in sums]
    )
