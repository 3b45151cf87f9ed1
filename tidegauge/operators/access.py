"""One way to a series: its latest view, or as it was known on a day; a view that can't be safe is refused."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.functions.scalar import published, vintage_end
from tidegauge.tables import with_known_day

#: Series of revised figures without a single dated release can't be known as of a day.
VIOLATION = "violation"


class NotKnowable(Exception):
    """An indicator has no view that is safe as of the asked day; base of all refusals."""


class UnknownIndicator(NotKnowable):
    """No such indicator in the metadata."""


class VintagesMissing(NotKnowable):
    """The indicator is revised, and the panel has no dated release of it."""


def basis(meta: DataFrame, panel: DataFrame) -> DataFrame:
    """indicator_id, basis, vintages: on what an indicator's view as of a day rests.

    vintage panel: dated releases. release lag: figures are final, and known so many
    days after their day. truncation: known on their day. violation: the indicator
    is revised, and there is no dated release.
    """
    dated = panel.where("realtime_start is not null").groupBy("indicator_id").agg(F.count("*").alias("vintages"))
    m = meta.select("indicator_id", "needs_vintage", "release_lag_days").join(dated, "indicator_id", "left")
    found = (
        F.when(F.col("needs_vintage") & (F.coalesce("vintages", F.lit(0)) > 0), "vintage panel").when(F.col("needs_vintage"), VIOLATION)
        .when(F.coalesce("release_lag_days", F.lit(0)) > 0, "release lag").otherwise("truncation")
    )
    return m.select("indicator_id", found.alias("basis"), F.coalesce("vintages", F.lit(0)).alias("vintages"))


def known_at(panel: DataFrame, meta: DataFrame, as_of: Sequence[date] | date, keys: Sequence[str] = ("indicator_id", "area_code")) -> DataFrame:
    """as_of, keys, obs_day, value, row_id, basis: every observation as it was known on each of the days.

    Of an observation's rows known on or before the day the latest known counts, of
    equal ones the highest row_id, its null value too. Indicators in violation have
    no rows. The days are a stated list: each row is read once and handed to the
    days on which it was known; rows of one observation and day combine before the
    shuffle.
    """
    days = sorted({as_of} if isinstance(as_of, date) else set(as_of))
    safe = basis(meta, panel).where(F.col("basis") != VIOLATION).select(F.col("indicator_id").alias("safe_id"), "basis")
    rows = with_known_day(panel, meta).where("obs_day is not null and known_day is not null")
    asked = F.explode(F.filter(F.array(*[F.lit(d) for d in days]), lambda d: d >= F.col("known_day"))).alias("as_of")
    seen = rows.select(*keys, "obs_day", "known_day", "row_id", "value", asked)
    order = F.struct("known_day", "row_id")
    found = seen.groupBy("as_of", *keys, "obs_day").agg(F.max_by(F.struct("value", "row_id"), order).alias("b"))
    return found.join(safe, found.indicator_id == safe.safe_id).select("as_of", *keys, "obs_day", "b.value", "b.row_id", "basis")


def visible(rows: DataFrame, day: str, lag_days: Column, as_of: date | Column) -> DataFrame:
    """Rows of final figures whose day and release lag have passed on as_of; their own days stay as they are."""
    bound = F.lit(as_of) if isinstance(as_of, date) else as_of
    return rows.where(F.date_add(F.col(day), F.coalesce(lag_days, F.lit(0)).cast("int")) <= bound)


@dataclass
class Context:
    """Access as of one day, for code that must not see later figures; without a day it can't be made."""

    panel: DataFrame
    meta: DataFrame
    as_of: date

    def __post_init__(self) -> None:
        if self.as_of is None:
            raise ValueError("a context needs its day")

    def load(self, indicator_id: str) -> DataFrame:
        return load(self.panel, self.meta, indicator_id, self.as_of)


def load(panel: DataFrame, meta: DataFrame, indicator_id: str, as_of: date | None = None) -> DataFrame:
    """area_code, obs_day, value, row_id, basis of one indicator as known on as_of, or, without it, its latest view.

    The latest view has basis latest: of every observation the row of the highest
    row_id; it isn't safe for tests on the past. An unknown indicator and one in
    violation raise a NotKnowable. The refusal is decided on the indicator's own rows.
    """
    own_meta, own = meta.where(F.col("indicator_id") == indicator_id), panel.where(F.col("indicator_id") == indicator_id)
    found = basis(own_meta, own).first()
    if found is None:
        raise UnknownIndicator(indicator_id)
    if as_of is None:
        rows = with_known_day(own, own_meta).where("obs_day is not null").groupBy("area_code", "obs_day")
        return rows.agg(F.max_by("value", "row_id").alias("value"), F.max("row_id").alias("row_id")).withColumn("basis", F.lit("latest"))
    if found["basis"] == VIOLATION:
        raise VintagesMissing(f"{indicator_id} as of {as_of}: revised, without a dated release")
    return known_at(own, own_meta, as_of).select("area_code", "obs_day", "value", "row_id", "basis")


def whole_vintage(vintages: DataFrame, as_of: Column, key: str = "vintage") -> DataFrame:
    """Rows of vintages(vintage, obs_day, ...) of the last vintage published by as_of, up to the end of its quarter.

    Keys are like 2020Q1; a vintage is published 14 days after its quarter ends, so
    one that isn't out yet is never read. Unreadable keys are left out.
    """
    out = vintages.where(published(F.col(key)) <= as_of)
    last = out.agg(F.max_by(key, vintage_end(F.col(key)))).scalar()
    return out.where((F.col(key) == last) & (F.col("obs_day") <= vintage_end(F.col(key))))


class UnitsDiffer(ValueError):
    """Series of different units meet where one unit is needed."""


def assert_same_unit(meta: DataFrame, ids: Sequence[str]) -> str | None:
    """The one unit of these indicators, null if they have none; more than one raises. The ids are a short stated list."""
    units = [r["unit"] for r in meta.where(F.col("indicator_id").isin(list(ids))).select("unit").distinct().limit(3).collect()]
    if len(units) > 1:
        raise UnitsDiffer(f"{list(ids)}: {sorted(map(str, units))}")
    return units[0] if units else None
