"""Sums per tile of ``ntile`` over all rows, by multiple selection of the rows at which tiles end.

No rank per row and no running sum over all values is needed: the few cut rows are looked for in histograms of leading bits.

1. Rows are counted per leading bits of the value, which makes a few thousand counts. They name, for each cut, the group
   that holds it and how many of its rows lie before the cut.
2. Only rows of such groups are counted, per value and leading bits (or characters) of the key. That names the cell of each cut.
3. Whether a row lies before, in or after a cut's cell follows from its own value and key. Rows are summed by that; only rows of
   a cut's cell are put in order.

What passes from one step to the next is a handful of rows in a scalar subquery, so nothing runs before the action.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_LEADING = 10
_EARLIER = (Window.unboundedPreceding, -1)
# What null values and keys count as, so that they come last.
_LEAST_VALUE, _LEAST_GROUP, _LAST_NUMBER, _LAST_TEXT = -(1 << 63), -(1 << 20), (1 << 63) - 1, "\U0010ffff"


def _coarse(value: Column, text: bool) -> Column:
    """A group that rises with the value: of text the beginning, of a whole number its length and leading bits; null stays null."""
    if text:
        return F.left(value, F.lit(_LEADING))
    size = F.abs(value)
    length = F.length(F.bin(size))
    # lengths up to _LEADING keep the value itself
    top = F.call_function("shiftright", size, F.greatest(length - _LEADING, F.lit(0)))
    key = length * (1 << _LEADING) + top
    return F.when(value < 0, -key).when(value >= 0, key)


def tile_end(last: int, tiles: int, total: str = "total") -> Column:
    """Rank of the last row of tile number ``last`` of ``ntile(tiles)``: the first ``total % tiles`` have one row more."""
    n = F.col(total)
    return F.floor(n / tiles) * last + F.least(n % tiles, F.lit(last))


def _groups_of_cuts(rows: DataFrame, lasts: Sequence[int], tiles: int) -> Column:
    """[(cut, group, rest)]: the group in which each cut lies, and at which of its rows."""
    line = Window.orderBy(F.desc("_g")).rowsBetween(*_EARLIER)
    sizes = rows.groupBy("_g").agg(F.sum("_n").alias("n")).withColumns({
        "before": F.coalesce(F.sum("n").over(line), F.lit(0)), "total": F.sum("n").over(Window.partitionBy()),
    })
    ends = [
        F.struct(F.lit(cut).alias("cut"), F.col("_g"), (tile_end(last, tiles) - F.col("before")).alias("rest"))
        for cut, last in enumerate(lasts)
    ]
    here = F.filter(F.array(*ends), lambda c: (c["rest"] > 0) & (c["rest"] <= F.col("n")))
    return sizes.select(F.inline(here)).agg(F.collect_list(F.struct("cut", "_g", "rest")).alias("cuts")).scalar()


def _cells_of_cuts(rows: DataFrame, groups: Column) -> Column:
    """[(v, k, place)]: value and leading bits of the key of each cut, and at which of the rows with these it lies."""
    here = F.filter("_cuts", lambda c: c["_g"] == F.col("_g"))
    cells = rows.withColumn("_cuts", groups).select("_v", "_k", "_n", F.inline(here).alias("cut", "_cut_g", "rest"))
    cells = cells.groupBy("cut", "rest", "_v", "_k").agg(F.sum("_n").alias("n"))
    line = Window.partitionBy("cut").orderBy(F.desc("_v"), F.asc("_k")).rowsBetween(*_EARLIER)
    place = F.col("rest") - F.coalesce(F.sum("n").over(line), F.lit(0))
    cells = cells.withColumn("place", place).where((F.col("place") > 0) & (F.col("place") <= F.col("n")))
    return cells.agg(F.collect_list(F.struct("_v", "_k", "place")).alias("cells")).scalar()


def tile_sums(
    rows: DataFrame, value: str, key: str, lasts: Sequence[int], tiles: int, **sums: Column
) -> DataFrame:
    """(part, n, one column per sum): how many rows each part has, and sums over them.

    Rows are ordered by the whole number ``value``, the largest first, then by ``key``, which is unique; nulls come last. They
    are dealt to tiles like ``ntile(tiles)``; part i holds the tiles after ``lasts[i - 1]`` up to ``lasts[i]``, the last of all.
    A part without rows is absent.
    """
    text = dict(rows.dtypes)[key] == "string"
    rows = rows.select(
        F.coalesce(F.col(value), F.lit(_LEAST_VALUE)).alias("_v"),
        F.coalesce(_coarse(F.col(value), False), F.lit(_LEAST_GROUP)).alias("_g"),
        F.coalesce(_coarse(F.col(key), text), F.lit(_LAST_TEXT if text else _LAST_NUMBER)).alias("_k"),
        F.col(key).alias("_key"), F.lit(1).cast("bigint").alias("_n"), *[c.alias(name) for name, c in sums.items()],
    )
    cuts = lasts[:-1]
    if not cuts:
        return rows.groupBy(F.lit(0).alias("part")).agg(F.sum("_n").alias("n"), *[F.sum(c).alias(c) for c in sums])
    found = _cells_of_cuts(rows, _groups_of_cuts(rows, cuts, tiles))

    v, k = F.col("_v"), F.col("_k")
    passed = F.filter("_cells", lambda c: (v < c["_v"]) | ((v == c["_v"]) & (k > c["_k"])))
    around = F.filter("_cells", lambda c: (v == c["_v"]) & (k == c["_k"]))
    spot = F.struct(
        (len(cuts) - F.size("_cells") + F.size(passed)).alias("part"),
        F.array_sort(F.transform(around, lambda c: c["place"])).alias("places"),
    )
    totals = ["_n", *sums]
    placed = rows.withColumn("_cells", found).select("_key", *totals, spot.alias("_spot"))
    lone = F.when(F.size("_spot.places") > 0, F.col("_key"))
    few = placed.groupBy("_spot", lone.alias("_key")).agg(*[F.sum(c).alias(c) for c in totals])
    rank = F.row_number().over(Window.partitionBy("_spot").orderBy(F.asc_nulls_last("_key")))
    few = few.withColumn("_rank", rank)
    part = F.col("_spot.part") + F.size(F.filter("_spot.places", lambda p: p < F.col("_rank")))
    return few.groupBy(part.alias("part")).agg(F.sum("_n").alias("n"), *[F.sum(c).alias(c) for c in sums])
