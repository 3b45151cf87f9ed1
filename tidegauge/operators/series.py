"""Operators on long series(id, day, value): as-of alignment, calendars, preparation and trailing features."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from datetime import date

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidegauge.functions import scalar


def dedupe_last(rows: DataFrame, keys: Sequence[str], order_by: str, columns: Sequence[str]) -> DataFrame:
    """The row of the highest order_by per key; combines before the shuffle."""
    body = F.struct(*[F.col(c) for c in columns])
    return rows.groupBy(*keys).agg(F.max_by(body, order_by).alias("b")).select(*keys, *[F.col(f"b.{c}") for c in columns])


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, since: str, payload: Sequence[str]) -> DataFrame:
    """Each left row with the payload of the right row of its keys with the greatest since not after at.

    The found row counts as it is, null values included; without one the payload
    is null. Of right rows with equal keys and since the greatest payload counts.
    Both sides are sorted together once per key, without any join.
    """
    own = [c for c in left.columns if c not in keys]
    carried = F.struct(F.col(since).alias("since"), *[F.col(c) for c in payload])
    a = left.select(*keys, F.col(at).alias("__t"), F.lit(1).alias("__side"), F.struct(*[F.col(c) for c in own]).alias("__own"))
    b = right.where(F.col(since).isNotNull()).groupBy(*keys, F.col(since).alias("__t")).agg(F.max(carried).alias("__found"))
    both = a.withColumn("__found", F.lit(None).cast(dict(b.dtypes)["__found"])).unionByName(
        b.select(*keys, "__t", F.lit(0).alias("__side"), F.lit(None).cast(dict(a.dtypes)["__own"]).alias("__own"), "__found")
    )
    order = Window.partitionBy(*keys).orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    return (
        both.withColumn("__found", F.last("__found", ignorenulls=True).over(order)).where("__side = 1")
        .select(*keys, *[F.col(f"__own.{c}").alias(c) for c in own], *[F.col(f"__found.{c}").alias(c) for c in ["since", *payload]])
    )


def business_days(bounds: DataFrame, lo: str, hi: str) -> DataFrame:
    """Each row with every Monday to Friday from lo to hi as day."""
    return bounds.withColumn("day", F.explode(F.expr(f"sequence({lo}, {hi}, interval 1 day)"))).where(F.weekday("day") < 5)


def forward_fill(series: DataFrame) -> DataFrame:
    """id, day, value on business days from the first to the last reading; a null reading holds until the next one."""
    bounds = series.groupBy("id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    grid = business_days(bounds, "lo", "hi").select("id", "day")
    return asof_join(grid, series.withColumn("reading", F.col("day")), ["id"], "day", "reading", ["value"]).select("id", "day", "value")


def month_end_last(series: DataFrame) -> DataFrame:
    """id, month_end, day, value: the last reading of each month that isn't null."""
    return (
        series.where("value is not null").groupBy("id", F.last_day("day").alias("month_end"))
        .agg(F.max(F.struct("day", "value")).alias("b")).select("id", "month_end", "b.day", "b.value")
    )


def quartile_flags(series: DataFrame, k: float = 5.0) -> DataFrame:
    """id, day, value, is_outlier: beyond k interquartile ranges of the series; with under four readings or none spread, none.

    The quartiles are the exact linearly interpolated ones, from counts of
    distinct values, so that a series of very many rows combines before the shuffle.
    """
    q = (
        series.where("value is not null").groupBy("id", "value").agg(F.count("*").alias("c")).groupBy("id")
        .agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.75)), F.col("c")).alias("q"), F.sum("c").alias("n"))
    )
    spread = F.col("q")[1] - F.col("q")[0]
    beyond = (F.col("value") < F.col("q")[0] - k * spread) | (F.col("value") > F.col("q")[1] + k * spread)
    return series.join(q, "id", "left").select(
        "id", "day", "value", F.coalesce((F.col("n") >= 4) & (spread > 0) & beyond, F.lit(False)).alias("is_outlier")
    )


def fill_gaps(series: DataFrame, longest: int = 5) -> DataFrame:
    """id, day, value, run: null runs of at most longest rows between two values are filled linearly by position.

    run is the length of the null run that a row belongs to, 0 for a value.
    Longer, leading and trailing runs stay null.
    """
    by_day = Window.partitionBy("id").orderBy("day")
    ahead = by_day.rowsBetween(Window.unboundedPreceding, 0)
    back = Window.partitionBy("id").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, 0)
    numbered = series.withColumn("n", F.row_number().over(by_day))
    mark = F.when(F.col("value").isNotNull(), F.struct("n", "value"))
    near = numbered.withColumn("a", F.last(mark, ignorenulls=True).over(ahead)).withColumn("b", F.last(mark, ignorenulls=True).over(back))
    inside = F.col("a.n").isNotNull() & F.col("b.n").isNotNull()
    whole = F.count("*").over(Window.partitionBy("id"))
    run = F.when(F.col("value").isNotNull(), 0).otherwise(F.coalesce("b.n", whole + 1) - F.coalesce("a.n", F.lit(0)) - 1)
    drawn = F.col("a.value") + (F.col("b.value") - F.col("a.value")) * (F.col("n") - F.col("a.n")) / F.nullif(F.col("b.n") - F.col("a.n"), F.lit(0))
    near = near.withColumn("run", run.cast("int"))
    return near.select(
        "id", "day", F.when(F.col("value").isNotNull(), F.col("value")).when(inside & (F.col("run") <= longest), drawn).alias("value"), "run"
    )


def _rows(n: int):
    return Window.partitionBy("id").orderBy("day").rowsBetween(-(n - 1), 0)


def trailing_z(value: Column, rows: int, least: int = 2) -> Column:
    """z-score within the trailing rows, sample deviation; null with fewer than least rows or a deviation of 1e-12 or less."""
    w = _rows(rows)
    return F.when((F.count(value).over(w) >= least) & (F.stddev_samp(value).over(w) > 1e-12), (value - F.avg(value).over(w)) / F.stddev_samp(value).over(w))


def trailing_rank(series: DataFrame, rows: int, least: int = 1) -> DataFrame:
    """id, day, share: the share of an id's trailing rows that are at most the row's own value, itself and ties included.

    Null with fewer than least rows; rows without id or value are left out. A pass
    over each id's rows in order of day, which keeps rows - 1 values between batches.
    """
    slim = series.where("id is not null and value is not null").select("id", "day", F.col("value").cast("double").alias("value"))

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, tail = None, np.zeros(0)
        for batch in batches:
            n, ids, v = batch.num_rows, batch.column(0), batch.column(2).to_numpy()
            if not n:
                continue
            starts = np.r_[0, 1 + np.flatnonzero(pc.not_equal(ids.slice(1), ids.slice(0, n - 1)).to_numpy(zero_copy_only=False))].astype(int)
            share, count = np.zeros(n), np.zeros(n, int)
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), n]):
                own, name = v[a:b], ids[a].as_py()
                before = tail if name == last else np.zeros(0)
                held = np.concatenate([before, own])
                window = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.full(rows - 1, np.nan), held]), rows)[len(before) :]
                count[a:b] = np.minimum(np.arange(len(before), len(held)) + 1, rows)
                share[a:b] = (window <= own[:, None]).sum(axis=1) / count[a:b]
                last, tail = name, held[-(rows - 1) :] if rows > 1 else np.zeros(0)
            yield pa.RecordBatch.from_arrays([ids, batch.column(1), pa.array(share, mask=count < least)], ["id", "day", "share"])

    kinds = dict(slim.dtypes)
    return slim.repartition("id").sortWithinPartitions("id", "day").mapInArrow(ranked, f"id {kinds['id']}, day {kinds['day']}, share double")


def drawdown(value: Column, rows: int) -> Column:
    """Change from the greatest value of the trailing rows."""
    return value / F.max(value).over(_rows(rows)) - 1.0


def lagged_change(series: DataFrame, days: int) -> DataFrame:
    """id, day, value, before: the reading in force so many calendar days earlier."""
    asked = series.withColumn("earlier", F.date_sub("day", days))
    held = series.select("id", F.col("day").alias("held_on"), F.col("value").alias("before"))
    return asof_join(asked, held, ["id"], "earlier", "held_on", ["before"]).select("id", "day", "value", "before")


def forward_returns(series: DataFrame, months: int) -> DataFrame:
    """id, month_end, forward: return from each month end to so many months later; see forward_returns_at."""
    return forward_returns_at(series, (months,)).drop("months")


def forward_returns_at(series: DataFrame, months: Sequence[int]) -> DataFrame:
    """id, months, month_end, forward: return from each month end to each so many months later, all in one sort.

    Both legs are as-of readings of the month-end series, and months are added to
    the date before the look-up: from a 28 February the target of a leap year is
    the 28th, for which January's reading is in force. Starts whose target lies
    after the last raw day have no row.
    """
    monthly = month_end_last(series)
    last = series.where("value is not null").groupBy("id").agg(F.max("day").alias("last_day"))
    each = monthly.join(last, "id").withColumn("months", F.explode(F.array(*[F.lit(m) for m in months])))
    asked = each.withColumn("target", F.expr("add_months(month_end, months)")).where("target <= last_day")
    ends = monthly.select("id", F.col("month_end").alias("end_of"), F.col("value").alias("later"))
    found = asof_join(asked.select("id", "months", "month_end", "value", "target"), ends, ["id"], "target", "end_of", ["later"])
    return found.where("value <> 0 and later is not null").select("id", "months", "month_end", (F.col("later") / F.col("value") - 1.0).alias("forward"))


def hac_regression(pairs: DataFrame, keys: Sequence[str], lags: int) -> DataFrame:
    """Least squares of y on x per group with Newey-West errors of so many lags.

    pairs has keys, position (the order), x and y; pairs with a null are left out
    before lags are counted by row. Bartlett weights, no small-sample correction.
    Result: keys, n, slope, intercept, r2, adj_r2, slope_se, intercept_se, p_slope,
    p_intercept (two-sided, normal; null without an error), resid_se (sample deviation
    of the residuals). Groups of fewer than three pairs or of constant x have no row.
    """
    usable = pairs.where("x is not null and y is not null")
    fit = usable.groupBy(*keys).agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.avg("x").alias("mx"), F.regr_sxx("y", "x").alias("sxx"),
    ).where("n >= 3 and sxx > 0")
    by = Window.partitionBy(*keys).orderBy("position")
    scored = usable.join(fit, list(keys)).withColumn("u", F.expr("y - intercept - slope * x")).withColumns(
        {"z": F.expr("(x - mx) * u / sxx"), "c": F.expr("u / n - mx * (x - mx) * u / sxx")}
    )
    scored = scored.withColumns({f"{v}{lag}": F.lag(v, lag).over(by) for v in "zc" for lag in range(1, lags + 1)})

    def error(v: str) -> Column:
        total = F.sum(F.col(v) * F.col(v))
        for lag in range(1, lags + 1):
            total = total + 2.0 * (1.0 - lag / (lags + 1.0)) * F.coalesce(F.sum(F.col(v) * F.col(f"{v}{lag}")), F.lit(0.0))
        return F.sqrt(F.greatest(total, F.lit(0.0)))

    fitted = scored.groupBy(*keys).agg(
        *[F.first(c).alias(c) for c in ("n", "slope", "intercept", "r2")],
        error("z").alias("slope_se"), error("c").alias("intercept_se"), F.stddev_samp("u").alias("resid_se"),
    )
    return fitted.select(
        *keys, "n", "slope", "intercept", "r2", _adjusted(), "slope_se", "intercept_se",
        _p_value("slope").alias("p_slope"), _p_value("intercept").alias("p_intercept"), "resid_se",
    )


def _adjusted() -> Column:
    return (1 - (1 - F.col("r2")) * (F.col("n") - 1) / (F.col("n") - 2)).alias("adj_r2")


def _p_value(of: str) -> Column:
    return F.when(F.col(f"{of}_se") > 0, scalar.normal_tail(F.col(of) / F.col(f"{of}_se")))


def hac_by_lags(pairs: DataFrame, keys: Sequence[str], lags: str, longest: int = 2_000) -> DataFrame:
    """hac_regression where the column lags holds each group's number of lags, which may be in the hundreds.

    Each group's residuals are one array, so pairs must be at a bounded step (months):
    a group of more than longest pairs raises. The lag sums run over those arrays.
    """
    usable = pairs.where("x is not null and y is not null")
    fit = usable.groupBy(*keys, lags).agg(
        F.count("*").alias("n"), F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"),
        F.regr_r2("y", "x").alias("r2"), F.avg("x").alias("mx"), F.regr_sxx("y", "x").alias("sxx"),
        F.array_sort(F.collect_list(F.struct("position", "x", "y"))).alias("rows"),
    ).where("n >= 3 and sxx > 0")
    bounded = F.when(F.col("n") <= longest, F.col("rows")).otherwise(F.raise_error(F.lit(f"more than {longest} pairs in a group")).cast(dict(fit.dtypes)["rows"]))
    scored = fit.withColumn("rows", bounded).withColumn(
        "u", F.transform("rows", lambda r: r["y"] - F.col("intercept") - F.col("slope") * r["x"])
    ).withColumn("d", F.transform("rows", lambda r: (r["x"] - F.col("mx")) / F.col("sxx")))
    shape = ", ".join(f"{k} {dict(scored.dtypes)[k]}" for k in keys)

    def errors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = []
            for u, d, mx, asked in zip(pdf["u"], pdf["d"], pdf["mx"], pdf[lags].astype(int)):
                u, d, most = np.asarray(u, float), np.asarray(d, float), min(asked, len(u) - 1)
                weights = 1.0 - np.arange(1, most + 1) / (asked + 1.0)
                pair = []
                for v in (d * u, u / len(u) - mx * d * u):
                    full = np.correlate(v, v, "full")[len(v) - 1 :]
                    pair.append(float(np.sqrt(max(0.0, full[0] + 2.0 * (weights * full[1 : most + 1]).sum()))))
                found.append((*pair, float(np.std(u, ddof=1))))
            out = pdf[[*keys, lags, "n", "slope", "intercept", "r2"]].copy()
            for i, name in enumerate(("slope_se", "intercept_se", "resid_se")):
                out[name] = [f[i] for f in found]
            yield out

    fitted = scored.select(*keys, lags, "n", "slope", "intercept", "r2", "mx", "u", "d").mapInPandas(
        errors, f"{shape}, {lags} int, n long, slope double, intercept double, r2 double, slope_se double, intercept_se double, resid_se double"
    )
    return fitted.select(
        *keys, lags, "n", "slope", "intercept", "r2", _adjusted(), "slope_se", "intercept_se",
        _p_value("slope").alias("p_slope"), _p_value("intercept").alias("p_intercept"), "resid_se",
    )


def month_grid(series: DataFrame) -> DataFrame:
    """id, month_end, value on every month end from the first reading's to the last's; a month without reading holds the one before."""
    m = month_end_last(series)
    b = m.groupBy("id").agg(F.min("month_end").alias("lo"), F.max("month_end").alias("hi"))
    grid = b.select("id", F.explode(F.expr("sequence(trunc(lo, 'month'), hi, interval 1 month)")).alias("m")).select("id", F.last_day("m").alias("month_end"))
    held = m.select("id", F.col("month_end").alias("held"), "value")
    return asof_join(grid, held, ["id"], "month_end", "held", ["value"]).select("id", "month_end", "value")


class SeriesRefused(Exception):
    """A series that preparation can't take: empty, all null, or beyond its unit's range."""


def prepared(series: DataFrame, order_by: str, limits: DataFrame | None = None, until: date | None = None, strict: bool = False) -> DataFrame:
    """The whole preparation of series(id, day, value, order_by) in one call: id, day, value, is_outlier.

    Of repeated days the last counts; outliers are flagged on what was read; null runs
    of at most five rows are filled; the result stands on Monday to Friday from the
    first reading to the last, or on to until, each day with the reading in force.
    Where series has a column processed, rows with true in it pass as they are, not
    flagged. limits(id, low, high) are the ranges of the series' units. With strict,
    a series of nulls only or one beyond its range raises SeriesRefused, and all its
    findings are named; else a series of nulls only has no rows, and the range is left
    to the reader.
    """
    done = None
    if "processed" in series.columns:
        done = series.where("processed").select("id", "day", "value", F.lit(False).alias("is_outlier"))
        series = series.where("not coalesce(processed, false)")
    clean = dedupe_last(series.where("id is not null and day is not null"), ["id", "day"], order_by, ["value"])
    if strict:
        found = clean.groupBy("id").agg(F.count("value").alias("n"), F.min("value").alias("least"), F.max("value").alias("greatest"))
        bad = F.col("n") == 0
        if limits is not None:
            found = found.join(limits, "id", "left")
            bad = bad | F.coalesce((F.col("least") < F.col("low")) | (F.col("greatest") > F.col("high")), F.lit(False))
        refused = found.where(bad).select("id", F.when(F.col("n") == 0, "only nulls").otherwise("out of range").alias("why")).limit(20).collect()
        if refused:
            raise SeriesRefused("; ".join(f"{r['id']}: {r['why']}" for r in refused))
    flags = quartile_flags(clean).select("id", F.col("day").alias("read"), "is_outlier")
    filled = fill_gaps(clean).select("id", F.col("day").alias("read"), "value")
    both = filled.join(flags, ["id", "read"])
    bounds = clean.groupBy("id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"), F.count("value").alias("c")).where("c > 0")
    end = F.col("hi") if until is None else F.greatest("hi", F.lit(until))
    grid = business_days(bounds.withColumn("end", end), "lo", "end").select("id", "day")
    out = asof_join(grid, both, ["id"], "day", "read", ["value", "is_outlier"]).select(
        "id", "day", "value", (F.col("is_outlier") & (F.col("since") == F.col("day"))).alias("is_outlier")
    )
    return out if done is None else out.unionByName(done)
