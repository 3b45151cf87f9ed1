"""Landed files as long series(id, obs_date, value) and frames; every reader is lazy and has a fixed schema."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegauge.functions import scalar
from tidegauge.operators.series import dedupe_last


def chart_csv(spark: SparkSession, path: str, registry: DataFrame | None = None) -> DataFrame:
    """Chart exports with columns time and close, one series a file named by its id.

    Unreadable dates and figures are null and left out; of a repeated day the last
    line counts. registry(file_id, id, scale) renames and rescales; files that it
    doesn't name are left out.
    """
    raw = spark.read.option("header", True).csv(path).select("time", "close", "_metadata.file_name", "_metadata.file_block_start")
    order = F.struct("file_block_start", F.monotonically_increasing_id())
    rows = raw.select(
        F.regexp_replace("file_name", r"\.csv$", "").alias("id"), F.to_date(F.expr("try_cast(time as timestamp)")).alias("obs_date"),
        F.expr("try_cast(close as double)").alias("value"), order.alias("line"),
    ).where("obs_date is not null and value is not null")
    out = dedupe_last(rows, ["id", "obs_date"], "line", ["value"])
    if registry is None:
        return out
    known = registry.select(F.col("file_id"), F.col("id").alias("new_id"), F.coalesce("scale", F.lit(1.0)).alias("scale"))
    return out.join(known, out.id == known.file_id).select(F.col("new_id").alias("id"), "obs_date", (F.col("value") * F.col("scale")).alias("value"))


def series_json(spark: SparkSession, path: str) -> DataFrame:
    """JSON documents of indicator_id, frequency and data, a map of day to figure."""
    schema = "indicator_id string, frequency string, data map<string,double>"
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    return rows.select(F.col("indicator_id").alias("id"), "frequency", F.explode("data").alias("d", "value")).select(
        "id", "frequency", F.expr("try_cast(d as date)").alias("obs_date"), "value"
    ).where("obs_date is not null")


def positions_json(spark: SparkSession, path: str, day_field: str, sides: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Weekly positions: obs_date and for each (name, long field, short field) long, short and net.

    Figures are text; unreadable ones are null. Of a repeated week the last record counts, in order of file name and place.
    """
    fields = [day_field, *[f for _, a, b in sides for f in (a, b)]]
    schema = T.StructType([T.StructField(f, T.StringType()) for f in dict.fromkeys(fields)])
    rows = spark.read.schema(schema).option("multiLine", True).json(path)
    number = lambda f: F.expr(f"try_cast(`{f}` as double)")
    out = rows.select(
        F.to_date(F.expr(f"try_cast(`{day_field}` as timestamp)")).alias("obs_date"),
        F.struct("_metadata.file_name", F.monotonically_increasing_id()).alias("line"),
        *[c for n, a, b in sides for c in (number(a).alias(f"{n}_long"), number(b).alias(f"{n}_short"), (number(a) - number(b)).alias(f"{n}_net"))],
    ).where("obs_date is not null")
    return dedupe_last(out, ["obs_date"], "line", [c for c in out.columns if c not in ("obs_date", "line")])


def wide_quarters(frame: DataFrame, ids: Sequence[str]) -> DataFrame:
    """Columns named like 2003-Q2 unpivoted to ids, obs_date, value; unreadable figures are left out."""
    quarters = [c for c in frame.columns if c not in ids and len(c) in (6, 7) and c[:4].isdigit() and c[-2] in "Qq" and c[-1] in "1234"]
    long = frame.select(*ids, *[F.expr(f"try_cast(`{c}` as double)").alias(c) for c in quarters]).unpivot(list(ids), quarters, "quarter", "value")
    return long.select(*ids, scalar.quarter_date(F.col("quarter")).alias("obs_date"), "value").where("value is not null")


def positional(spark: SparkSession, path: str, columns: dict[int, str], skip: int = 0, missing: Sequence[str] = (".", "NA", "#N/A", "-999.99")) -> DataFrame:
    """Named text columns of a CSV by position, without the first skip lines of each file; missing marks become null."""
    width = max(columns) + 1
    schema = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(width)])
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("f"), F.monotonically_increasing_id().alias("i"))
    if skip:
        # Only the few first lines of each file are numbered; the rest pass by.
        first = lines.groupBy("f").agg(F.min("i").alias("lo"))
        lines = lines.join(first, "f").where(F.col("i") >= F.col("lo") + skip)
    parsed = lines.select(F.from_csv("value", schema.simpleString()[7:-1].replace(":", " "), {"mode": "PERMISSIVE"}).alias("r"))
    clean = lambda c: F.when(~F.trim(c).isin(*missing), F.trim(c))
    return parsed.select(*[clean(F.col(f"r.c{i}")).alias(n) for i, n in columns.items()])


def either_date(text: Column, formats: Sequence[str]) -> Column:
    """The first format that reads the text; else null."""
    return F.coalesce(*[F.to_date(F.try_to_timestamp(text, F.lit(f))) for f in formats])


def long_series(frame: DataFrame, date: Column, figures: dict[str, str], scale: float = 1.0, month_end: bool = False) -> DataFrame:
    """Columns as series: figures maps column to id; rows with no readable date or figure are left out, later lines win."""
    at = F.last_day(date) if month_end else date
    rows = frame.select(
        at.alias("obs_date"), F.monotonically_increasing_id().alias("line"),
        *[(F.expr(f"try_cast(`{c}` as double)") * scale).alias(i) for c, i in figures.items()],
    ).where("obs_date is not null")
    long = rows.unpivot(["obs_date", "line"], list(figures.values()), "id", "value").where("value is not null")
    return dedupe_last(long, ["id", "obs_date"], "line", ["value"])


def known_labels(labels: DataFrame) -> DataFrame:
    """id, obs_date, value with trailing nulls left out: after its last figure a label isn't determined."""
    last = F.max(F.when(F.col("value").isNotNull(), F.col("obs_date"))).over(Window.partitionBy("id"))
    return labels.withColumn("last", last).where(F.col("obs_date") <= F.col("last")).drop("last")


def turning_points(spark: SparkSession, path: str) -> DataFrame:
    """Cycle calendar CSV as rows month, kind, announced; an announcement not after its month raises."""
    schema = "peak_date string, peak_announcement_date date, trough_date string, trough_announcement_date date, source_url string, notes string"
    wide = spark.read.option("header", True).schema(schema).csv(path)
    rows = wide.selectExpr(
        "stack(2, 'peak', peak_date, peak_announcement_date, 'trough', trough_date, trough_announcement_date) as (kind, month, announced)"
    ).where("month is not null").select(F.to_date(F.concat("month", F.lit("-01"))).alias("month"), "kind", "announced")
    late = F.col("announced") > F.last_day("month")
    return rows.withColumn("announced", F.when(late, F.col("announced")).otherwise(F.raise_error(F.concat(F.lit("announced too early: "), F.col("month").cast("string"))).cast("date")))


def reserves(frame: DataFrame, area: str = "World", code: str = "series_code", place: str = "area") -> DataFrame:
    """id (currency), obs_date, value of a wide table of reserves by currency: one area's rows, the currency from the series code."""
    currency = F.regexp_extract(F.col(code), r"_([A-Z]{3})(?:_|$)", 1)
    own = frame.where(F.col(place) == area).withColumn("id", currency).where("id <> ''")
    return wide_quarters(own, ["id"]).groupBy("id", "obs_date").agg(F.max("value").alias("value"))


def closes(frame: DataFrame, day: str, names: Sequence[str] = ("Close", "close", "Adj Close")) -> DataFrame:
    """id, obs_date, value from market data with one level of columns (Close) or two (Close|TICKER), by the first name that fits."""
    for name in names:
        if name in frame.columns:
            return frame.select(F.lit(name).alias("id"), F.to_date(day).alias("obs_date"), F.col(f"`{name}`").cast("double").alias("value")).where("obs_date is not null and value is not null")
        pairs = [c for c in frame.columns if c.startswith(f"{name}|")]
        if pairs:
            long = frame.select(F.to_date(day).alias("obs_date"), *[F.col(f"`{c}`").cast("double").alias(c.partition("|")[2]) for c in pairs])
            return long.unpivot("obs_date", [c.partition("|")[2] for c in pairs], "id", "value").where("obs_date is not null and value is not null").select("id", "obs_date", "value")
    raise ValueError(f"no column of {list(names)}")


@dataclass
class Loaded:
    """What every loader gives: long series(id, obs_date, value), what is known of each id, and what couldn't be had."""

    series: DataFrame
    metadata: dict[str, dict]
    failed: dict[str, str]


def load_all(spark: SparkSession, loaders: Mapping[str, Callable[[], DataFrame]], metadata: Mapping[str, dict] | None = None) -> Loaded:
    """The series of all loaders under their names; one that fails is named in failed and leaves the others alone.

    Each loader gives obs_date and value. A loader's schema and its first row are
    asked for at once, so that a missing or unreadable file fails here; one without
    any row fails as empty.
    """
    parts, failed = [], {}
    for name, load in loaders.items():
        try:
            part = load().select(F.lit(name).alias("id"), "obs_date", F.col("value").cast("double").alias("value"))
            if part.isEmpty():
                raise ValueError("empty")
            parts.append(part)
        except Exception as e:  # whatever one source does, the others must come
            failed[name] = f"{type(e).__name__}: {str(e).splitlines()[0]}"
    schema = "id string, obs_date date, value double"
    whole = reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)
    return Loaded(whole, {n: dict((metadata or {}).get(n, {})) for n in loaders if n not in failed}, failed)


def chart_files(spark: SparkSession, folder: str, registry: Mapping[str, dict]) -> Loaded:
    """All registered chart exports of a folder, by one listing: registry maps file_id to id, scale and further metadata.

    Files without an entry are skipped and named in failed, as are entries without a
    file; every id is tagged as of tier 5, charts being the last resort.
    """
    from tidegauge.sources.store import _fs

    fs, p = _fs(spark, folder)
    there = {s.getPath().getName()[:-4] for s in fs.listStatus(p) if s.getPath().getName().endswith(".csv")}
    rows = [(f, m["id"], float(m.get("scale", 1.0))) for f, m in registry.items() if f in there]
    failed = {f: "not registered" for f in there - registry.keys()} | {registry[f]["id"]: "no file" for f in registry.keys() - there}
    known = spark.createDataFrame(rows, "file_id string, id string, scale double")
    series = chart_csv(spark, f"{folder}/*.csv", known)
    return Loaded(series, {i: {**registry[f], "tier": 5} for f, i, _ in rows}, failed)
