"""Integer rounding and the closed form of ntile."""

from fractions import Fraction

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions import exact
from tidemark.functions.calendar import month_gap
from tidemark.plans.ranking import tile_sums


def half_up(n: int, d: int, scale: int) -> int | None:
    if d == 0:
        return None
    size = int(Fraction(2 * scale * abs(n) + d, 2 * d))
    return -size if n < 0 else size


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(-10**14, 10**14), st.integers(0, 10**12)), min_size=50, max_size=200))
def test_half_up(spark, pairs):
    df = spark.createDataFrame(pairs, "n bigint, d bigint")
    n, den = F.col("n"), F.col("d")
    got = df.select("n", "d", exact.half_up(n, den, 1).alias("one")).collect()
    for row in got:
        assert row.one == half_up(row.n, row.d, 1)


def test_percent_of_large_totals_does_not_overflow(spark):
    total = 9 * 10**18
    df = spark.createDataFrame([(total // 3, total)], "n bigint, d bigint")
    assert df.select(exact.percent(F.col("n"), F.col("d"))).first()[0] == 33.33


def test_ties_round_away_from_zero(spark):
    df = spark.createDataFrame([(1, 8), (-1, 8), (1005, 1000)], "n bigint, d bigint")
    got = [r[0] for r in df.select(exact.average(F.col("n"), F.col("d"))).collect()]
    assert got == [0.13, -0.13, 1.01]


def test_month_gap_counts_month_boundaries(spark):
    df = spark.sql("SELECT date'2024-01-31' AS a, date'2024-02-01' AS b, date'2025-01-01' AS c")
    got = df.select(month_gap(F.col("a"), F.col("b")), month_gap(F.col("a"), F.col("c"))).first()
    assert tuple(got) == (1, 12)


def test_first_return_day_from_words_is_that_from_days(spark):
    from tests.data import random_rows, to_model
    from tidemark.model import Rules
    from tidemark.plans.rollups import user_facts, user_returns

    for seed, messy, reach in ((1, False, 30), (2, True, 400), (3, True, 63)):
        model, rules = to_model(spark, random_rows(seed, messy=messy)), Rules(retention_days=reach)
        columns = ["user_id", "register_date", "first_return_day", "tenure"]
        days, words = (f(model, rules).select(*columns).collect() for f in (user_facts, user_returns))
        assert sorted(map(str, days)) == sorted(map(str, words))
        mature = [f(model, rules, mature_days=20).select(*columns).collect() for f in (user_facts, user_returns)]
        assert sorted(map(str, mature[0])) == sorted(map(str, mature[1]))


def tiles_by_window(df, lasts, tiles):
    """What tile_sums gives, from ntile."""
    everything = Window.orderBy(F.desc_nulls_last("value"), F.asc_nulls_last("user_id"))
    part = sum((F.col("tile") > last).cast("int") for last in lasts[:-1]) + F.lit(0)
    rows = df.withColumn("tile", F.ntile(tiles).over(everything)).groupBy(part.alias("part"))
    return rows.agg(F.count("*").alias("n"), F.sum("value").alias("total"), F.sum("weight").alias("w"))


def same_tiles(df, lasts=(1, 5, 10), tiles=10):
    got = tile_sums(df, "value", "user_id", lasts, tiles, total=F.col("value"), w=F.col("weight"))
    def key(r): return tuple(r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(map(tuple, tiles_by_window(df, lasts, tiles).collect()), key=key)


def test_tile_sums_match_ntile(spark):
    for n in (0, 1, 9, 101, 1500):
        # a third of the rows share one value; others are negative, very large or null
        value = F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 11 == 1, None).otherwise(
            (F.hash("id") % 50) * F.when(F.col("id") % 5 == 0, 10**12 + 1).otherwise(1)
        )
        df = spark.range(n).select(
            F.col("id").alias("user_id"), value.cast("bigint").alias("value"), (F.hash("id") % 1000).cast("bigint").alias("weight")
        )
        same_tiles(df)
        same_tiles(df.withColumn("user_id", F.concat(F.lit("user_name_"), F.lpad(F.col("user_id").cast("string"), 6, "0"))))


def test_tiles_that_end_among_equal_values(spark):
    for n in (2, 3000):
        df = spark.range(n).select(
            F.when(F.col("id") > 0, F.col("id")).alias("user_id"), F.lit(5).cast("bigint").alias("value"),
            (F.hash("id") % 1000).cast("bigint").alias("weight"),
        )
        same_tiles(df)
        same_tiles(df.withColumn("value", F.lit(None).cast("bigint")), (1, 10, 20, 50, 100), 100)
        same_tiles(df, (10,), 10)


def test_tiles_of_many_values_with_the_same_leading_bits(spark):
    df = spark.range(5000).select(
        F.col("id").alias("user_id"), (F.lit(1 << 40) + F.hash("id") % 997).alias("value"), F.lit(1).cast("bigint").alias("weight")
    )
    same_tiles(df)
    same_tiles(df, tuple(range(1, 101)), 100)
