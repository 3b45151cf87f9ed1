"""Totals and averages over trailing calendar days, kept as versioned daily state.

A state has one row per entity and calendar day: entity, day, x (the day's own
amount, exact), n and odd (1 or 0: it has an amount; one that the exact type can't
hold), for each window of w days n{w}, odd{w} and total{w} (exact), and version.
advance adds days to it, correct recomputes the days that late or corrected
amounts touch, figures turns it into totals and averages.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Amounts are summed exactly in this type; expiring amounts then leave no residue.
EXACT = "decimal(28,8)"
WINDOWS = (7, 30)
_OWN = {"x": EXACT, "n": "int", "odd": "int"}
#: Which of a day's own columns each kind of total adds up.
_SOURCE = {"n": "n", "odd": "odd", "total": "x"}


def _totals(windows: Sequence[int]) -> dict[str, tuple[str, int, str]]:
    """Total columns of a state with the own column that each adds up, its window, and its type."""
    return {f"{c}{w}": (own, w, "decimal(38,8)" if own == "x" else "int") for w in windows for c, own in _SOURCE.items()}


def daily_amounts(rows: DataFrame, entity: str, day_column: str, value: str, order_by: str) -> DataFrame:
    """entity, day, amount: per entity and day the row with the highest order_by, if it isn't null."""
    return _usable(rows, entity, day_column, value, order_by).groupBy("entity", "day").agg(F.max_by("amount", "o").alias("amount")).where("amount is not null")


def _usable(rows: DataFrame, entity: str, day_column: str, value: str, order_by: str) -> DataFrame:
    return rows.select(
        F.col(entity).alias("entity"), F.col(day_column).alias("day"),
        F.col(value).cast("double").alias("amount"), F.col(order_by).alias("o"),
    ).where(F.col("entity").isNotNull() & F.col("day").isNotNull() & F.col("o").isNotNull())


def arrivals(rows: DataFrame, entity: str, day_column: str, value: str, order_by: str) -> tuple[DataFrame, DataFrame]:
    """Rows in order of ingestion as two lots of daily amounts: those in time, and the late and corrected ones.

    A day is in time if none after it came before it, in its entity; its amount is
    then the one it first came with. The second lot has the late days, and the days
    whose last amount isn't the first; a null amount there takes the day's amount
    away. Both are entity, day, amount with one row per entity and day.
    """
    after = Window.partitionBy("entity").orderBy(F.desc("day")).rowsBetween(Window.unboundedPreceding, -1)
    each = _usable(rows, entity, day_column, value, order_by).groupBy("entity", "day").agg(
        F.min_by("amount", "o").alias("first"), F.max_by("amount", "o").alias("last"), F.min("o").alias("came")
    )
    # First and last amount in one column, so that both lots have one plan up to the sort and share its shuffle.
    days = each.select("entity", "day", F.array("first", "last").alias("pair"), "came").withColumn(
        "late", F.coalesce(F.col("came") > F.min("came").over(after), F.lit(False))
    )
    first, last = F.col("pair")[0], F.col("pair")[1]
    in_time = days.where(~F.col("late") & first.isNotNull()).select("entity", "day", first.alias("amount"))
    known = F.when(~F.col("late"), first)
    return in_time, days.where(~known.eqNullSafe(last)).select("entity", "day", last.alias("amount"))


def _own(daily: DataFrame) -> DataFrame:
    exact = F.expr(f"try_cast(amount as {EXACT})")
    some = F.col("amount").isNotNull()
    return daily.select(
        "entity", "day", exact.alias("x"), some.cast("int").alias("n"), (some & exact.isNull()).cast("int").alias("odd")
    )


def _dense(rows: DataFrame, end: Column, extra: Sequence[str] = ()) -> DataFrame:
    """Every calendar day from each row's to the one before the next row's, the last row's up to end; own amounts only on the row's day."""
    by_day = Window.partitionBy("entity").orderBy("day")
    upto = F.coalesce(F.date_sub(F.lead("day").over(by_day), 1), end)
    return rows.withColumn("upto", upto).select(
        "entity", F.posexplode(F.expr("sequence(day, greatest(day, upto), interval 1 day)")).alias("k", "day"), *_OWN, *extra
    ).select("entity", "day", *[F.when(F.col("k") == 0, F.col(c)).alias(c) for c in [*_OWN, *extra]])


def _gain(own: str, w: int, by_day) -> Column:
    """What a window's total gains on a day: what arrives less what expires, w rows back on the dense grid."""
    return F.coalesce(F.col(own), F.lit(0)) - F.coalesce(F.lag(own, w).over(by_day), F.lit(0))


def _filled() -> list[Column]:
    return [F.col("x").cast(EXACT).alias("x"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("odd", F.lit(0)).alias("odd")]


def advance(
    state: DataFrame | None, daily: DataFrame, until: date | None = None, version: int = 0, windows: Sequence[int] = WINDOWS
) -> DataFrame:
    """State of the days that follow a state: yesterday's totals, plus today's arrivals, less the amounts that expire.

    daily(entity, day, amount) holds the arrivals, one row per entity and day; those
    on or before an entity's last day in state are left to correct. Each entity goes
    on from its last day in state to its last arrival, or on to until; one without
    state starts with its first arrival. Only the last max(windows) days of a state
    are read. Several days at once are one running sum of arrivals less expiries on
    top of yesterday's totals. Sums are exact to eight decimals; while an amount that
    the exact type can't hold (NaN, infinity, 1e20 and above) is in a window, odd is
    above zero. The sort per entity is bounded by the calendar.
    """
    totals = _totals(windows)
    by_day = Window.partitionBy("entity").orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, 0)
    rows = _own(daily.where("entity is not null and day is not null and amount is not null")).withColumn("held", F.lit(False))
    carried: list[str] = []
    if state is not None:
        last = state.groupBy("entity").agg(F.max("day").alias("last"))
        tail = state.join(last, "entity").where(F.col("day") > F.date_sub("last", max(windows)))
        rows = rows.join(last, "entity", "left").where("last is null or day > last").drop("last")
        rows = rows.withColumns({c: F.lit(None).cast(k) for c, (_, _, k) in totals.items()}).unionByName(
            tail.select("entity", "day", *_OWN, F.lit(True).alias("held"), *totals)
        )
        carried = list(totals)
    end = F.col("day") if until is None else F.greatest("day", F.lit(until))
    dense = _dense(rows, end, ["held", *carried]).withColumn("held", F.coalesce("held", F.lit(False)))
    gains = dense.withColumns({f"g_{c}": _gain(own, w, by_day) for c, (own, w, _) in totals.items()})

    def total(c: str, kind: str) -> Column:
        gained = F.sum(F.when(~F.col("held"), F.col(f"g_{c}")).otherwise(0)).over(so_far)
        yesterday = F.coalesce(F.last(c, ignorenulls=True).over(so_far), F.lit(0)) if carried else F.lit(0)
        return (yesterday + gained).cast(kind).alias(c)

    return gains.select("entity", "day", *_OWN, *[total(c, kind) for c, (_, _, kind) in totals.items()], "held").where("not held").select(
        "entity", "day", *_filled(), *totals, F.lit(version).alias("version")
    )


def correct(
    state: DataFrame, late: DataFrame, version: int, windows: Sequence[int] = WINDOWS, whole: bool = False
) -> DataFrame:
    """New versions of the state rows that late or corrected amounts touch; with whole, the other rows too, as they were.

    state has one version of each day (see latest). late(entity, day, amount) has
    one row per entity and day: the amount that the day has now, null for none. A
    row is touched if its longest window holds such a day, and only touched rows
    get the sums of their windows as they are now. Late days before an entity's
    first or after its last add rows for all days between; an entity without state
    gets its first. Days at either end that lose their amount stay. State and late
    days are sorted together once per entity, without a join; the sort is bounded
    by the calendar.
    """
    totals = _totals(windows)
    by_day = Window.partitionBy("entity").orderBy("day")
    so_far = by_day.rowsBetween(Window.unboundedPreceding, 0)
    now = {f"now_{c}": kind for c, kind in _OWN.items()} | {"changed": "int"}
    before = {**_OWN, **{c: kind for c, (_, _, kind) in totals.items()}, "version": "int"}
    changed = _own(late.where("entity is not null and day is not null")).select(
        "entity", "day", *[F.lit(None).cast(k).alias(c) for c, k in before.items()], *[F.col(c).alias(f"now_{c}") for c in _OWN], F.lit(1).alias("changed")
    )
    held = state.select("entity", "day", *before, *[F.lit(None).cast(k).alias(c) for c, k in now.items()])
    merged = held.unionByName(changed).groupBy("entity", "day").agg(*[F.max(c).alias(c) for c in [*before, *now]])
    # A late day without an amount starts no row.
    merged = merged.where("version is not null or now_n > 0")
    dense = _dense(merged, F.col("day"), [c for c in [*before, *now] if c not in _OWN])
    is_new = F.col("changed").isNotNull()
    after = dense.withColumns({c: F.when(is_new, F.col(f"now_{c}")).otherwise(F.col(c)) for c in _OWN})
    gains = after.withColumns({f"g_{c}": _gain(own, w, by_day) for c, (own, w, _) in totals.items()})
    touched = F.col("version").isNull() | (F.count("changed").over(by_day.rowsBetween(-(max(windows) - 1), 0)) > 0)
    rows = gains.select(
        "entity", "day", *_OWN, *totals, touched.alias("touched"), "version", *[F.sum(f"g_{c}").over(so_far).cast(k).alias(f"s_{c}") for c, (_, _, k) in totals.items()]
    ).select(
        "entity", "day", *_filled(), *[F.when(F.col("touched"), F.col(f"s_{c}")).otherwise(F.col(c)).alias(c) for c in totals],
        F.when(F.col("touched"), F.lit(version)).otherwise(F.col("version")).alias("version"), "touched",
    )
    return (rows if whole else rows.where("touched")).drop("touched")


def latest(state: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """The highest version of every entity and day."""
    columns = [c for c in state.columns if c not in ("entity", "day", "version")]
    return state.groupBy("entity", "day").agg(*[F.max_by(c, "version").alias(c) for c in columns], F.max("version").alias("version"))


def figures(state: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """entity, day, window_days, n, total, average, version; total is NaN while odd amounts are in the window, average null without any."""
    each = F.explode(F.array(*[
        F.struct(F.lit(w).alias("window_days"), F.col(f"n{w}").alias("n"), F.col(f"odd{w}").alias("odd"), F.col(f"total{w}").cast("double").alias("total"))
        for w in windows
    ]))
    run = state.select("entity", "day", each.alias("s"), "version").select("entity", "day", "s.*", "version")
    total = F.when(F.col("odd") > 0, F.lit(float("nan"))).when(F.col("n") == 0, 0.0).otherwise(F.col("total"))
    return run.select(
        "entity", "day", "window_days", "n", total.alias("total"), F.when(F.col("n") > 0, total / F.col("n")).alias("average"), "version",
    )


def maintained(rows: DataFrame, entity: str, day_column: str, value: str, order_by: str, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """State of all days of raw rows in order of ingestion: the amounts in time advance it, the late and corrected ones correct it.

    From each entity's first day with an amount to its last. Version 0 is how a day
    stood when it came, version 1 how it stands after the corrections.
    """
    in_time, late = arrivals(rows, entity, day_column, value, order_by)
    whole = correct(advance(None, in_time, windows=windows), late, 1, windows, whole=True)
    # A first or last day whose amount was taken away is no longer one.
    some, all_days = F.when(F.col("n") > 0, F.col("day")), Window.partitionBy("entity")
    return whole.withColumns({"lo": F.min(some).over(all_days), "hi": F.max(some).over(all_days)}).where("day between lo and hi").drop("lo", "hi")


def empty_windows(state: DataFrame, windows: Sequence[int] = WINDOWS) -> DataFrame:
    """entity, day, window_days of every window without an amount; reads no totals."""
    bare = F.filter(F.array(*[F.when(F.col(f"n{w}") == 0, F.lit(w)) for w in windows]), lambda w: w.isNotNull())
    return state.select("entity", "day", F.explode(bare).alias("window_days"))
