"""Reading the input tables and the few derived columns that several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def day(column: str | Column) -> Column:
    """Calendar date of a timestamp with or without zone."""
    return F.to_date(F.col(column) if isinstance(column, str) else column)


def period_letter(frequency: Column) -> Column:
    """D, W, M or Q from any spelling; B counts as D; anything else is null."""
    letter = F.upper(F.substring(F.trim(frequency), 1, 1))
    return F.when(letter == "B", "D").when(letter.isin("D", "W", "M", "Q"), letter)


def with_known_day(panel: DataFrame, meta: DataFrame) -> DataFrame:
    """Add obs_day and known_day to vintage rows.

    A row is known from the day of realtime_start or, where that is null, from
    its observation day plus the indicator's release lag; without a lag it is
    never known (null). The metadata side is left to the optimizer, which
    broadcasts it only while its size is under the session's threshold.
    """
    lag = meta.select(
        F.col("indicator_id").alias("__lag_id"),
        F.col("release_lag_days").cast("int").alias("__lag"),
    ).dropDuplicates(["__lag_id"])
    known = F.coalesce(day("realtime_start"), F.date_add(day("obs_date"), F.col("__lag")))
    return (
        panel.join(lag, F.col("indicator_id") == F.col("__lag_id"), "left")
        .withColumn("obs_day", day("obs_date"))
        .withColumn("known_day", known)
        .drop("__lag_id", "__lag")
    )
