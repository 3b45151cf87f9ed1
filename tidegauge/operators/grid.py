"""Irregular readings onto a regular grid of periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Holes of more periods than this stay empty.
MAX_GAP_PERIODS = 5


def period_start(letter: Column, date: Column) -> Column:
    """First day of the day, week (Monday), month or quarter; weekend days of a B grid are null."""
    return (
        F.when(letter == "D", date)
        .when((letter == "B") & (F.weekday(date) < 5), date)
        .when(letter == "W", F.to_date(F.date_trunc("week", date)))
        .when(letter == "M", F.trunc(date, "month"))
        .when(letter == "Q", F.trunc(date, "quarter"))
    )


def regular_grid(readings: DataFrame, max_gap_periods: int = MAX_GAP_PERIODS) -> DataFrame:
    """Gapless series from readings(series_key, period, day, value).

    period is D (every day), B (Monday to Friday), W, M or Q and constant in a
    series. Result: series_key, period, period_start, value, status, gap_periods,
    one row for every period between the first and the last that has a figure.
    status is observed (value: the latest reading of the period; of readings of
    one day the greatest), interpolated (linear in time at the first day of the
    period between the last reading before and the first after the hole), or gap
    (the hole has more than max_gap_periods periods; value null).

    Null values, days and keys, weekends on a B grid and series of no known
    period give no row. Readings are reduced to one row per period before the
    shuffle, so the sort of a series is bounded by the calendar, not by its rows.
    """
    start = period_start(F.col("period"), F.col("day"))
    first, last = F.struct("day", "value"), F.struct("day", "value")
    usable = readings.select("series_key", "period", "day", F.col("value").cast("double").alias("value")).where(
        F.col("series_key").isNotNull() & F.col("value").isNotNull() & ~F.isnan("value") & F.col("day").isNotNull()
    )
    seen = (
        usable.withColumn("period_start", start)
        .where(F.col("period_start").isNotNull())
        .groupBy("series_key", "period", "period_start")
        .agg(F.min(first).alias("first"), F.max(last).alias("last"))
    )
    # Merged with the sorted grid, each hole has the readings on its two sides as neighbours.
    following = F.lead(F.struct("period_start", "first")).over(
        Window.partitionBy("series_key", "period").orderBy("period_start")
    )
    near = seen.withColumn("after", following).selectExpr(
        "series_key", "period", "period_start", "last", "after",
        "case period when 'W' then date_add(period_start, 7) when 'M' then add_months(period_start, 1)"
        " when 'Q' then add_months(period_start, 3) else date_add(period_start, 1) end as lo",
        "case period when 'W' then date_sub(after.period_start, 7) when 'M' then add_months(after.period_start, -1)"
        " when 'Q' then add_months(after.period_start, -3) else date_sub(after.period_start, 1) end as hi",
    )
    absent = F.expr(
        "case when hi is null or lo > hi then array() else case period when 'W' then sequence(lo, hi, interval 7 days)"
        " when 'M' then sequence(lo, hi, interval 1 month) when 'Q' then sequence(lo, hi, interval 3 months)"
        " when 'B' then filter(sequence(lo, hi, interval 1 day), d -> weekday(d) < 5)"
        " else sequence(lo, hi, interval 1 day) end end"
    )
    placed = near.withColumn("absent", absent).select(
        "series_key", "period", "last", "after", F.size("absent").alias("hole"),
        F.posexplode(F.concat(F.array("period_start"), "absent")).alias("n", "period_start"),
    )
    share = F.datediff("period_start", F.col("last.day")) / F.datediff(F.col("after.first.day"), F.col("last.day"))
    drawn = F.col("last.value") + (F.col("after.first.value") - F.col("last.value")) * share
    seen_here, short = F.col("n") == 0, F.col("hole") <= max_gap_periods
    return placed.select(
        "series_key",
        "period",
        "period_start",
        F.when(seen_here, F.col("last.value")).when(short, drawn).alias("value"),
        F.when(seen_here, "observed").when(short, "interpolated").otherwise("gap").alias("status"),
        F.when(seen_here, 0).otherwise(F.col("hole")).alias("gap_periods"),
    )
