"""Queries p1 to p6 over the synthetic tables, with DuckDB statements for those that SQL expresses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegauge.operators import grid, rolling, spikes, units, validity
from tidegauge.session import spread
from tidegauge.tables import day, period_letter, table, with_known_day

OBSERVATION = ["indicator_id", "area_code", "obs_day"]


def _panel(spark: SparkSession, d: str) -> DataFrame:
    return with_known_day(table(spark, d, "vintage_panel"), table(spark, d, "indicator_meta"))


def p1_values(spark: SparkSession, d: str) -> DataFrame:
    requests = table(spark, d, "asof_requests").select(
        "request_id", "indicator_id", "area_code", day("obs_date").alias("obs_day"), day("as_of").alias("as_of_day")
    )
    return validity.join_as_of(
        requests, _panel(spark, d), OBSERVATION, "as_of_day", "known_day", "row_id", ["row_id", "value"]
    )


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_values(spark, d).select("request_id", "row_id")


def _readings(spark: SparkSession, d: str) -> DataFrame:
    frequency = table(spark, d, "indicator_meta").select("indicator_id", period_letter(F.col("frequency")).alias("period"))
    panel = table(spark, d, "vintage_panel").join(frequency, "indicator_id", "left").select(
        F.concat_ws("|", "indicator_id", "area_code").alias("series_key"), "period", day("obs_date").alias("day"), "value"
    )
    closes = _closes(spark, d).select(
        F.col("entity").alias("series_key"), F.lit("B").alias("period"), "day", F.col("amount").alias("value")
    )
    return panel.unionByName(closes)


def _closes(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_close").select("ticker", day("obs_date").alias("day"), "close", "row_id")
    return rolling.daily_amounts(rows, "ticker", "day", "close", "row_id")


def p2_grid(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(_readings(spark, d)).select(
        "series_key", F.date_format("period_start", "yyyy-MM-dd").alias("period_start"), "status", "gap_periods",
        F.round("value", 8).alias("value"),
    )


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return grid.regular_grid(_readings(spark, d)).where(F.col("status") != "observed").select(
        "series_key", F.date_format("period_start", "yyyy-MM-dd").alias("period_start")
    )


def p3_reasons(spark: SparkSession, d: str) -> DataFrame:
    return spikes.flag_readings(
        table(spark, d, "series_readings"), table(spark, d, "indicator_meta"), ["indicator_id", "area_code"],
        "row_id", "obs_ts", "value", ["indicator_id"], "expected_min", "expected_max",
    )


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return p3_reasons(spark, d).select("row_id")


def _records(spark: SparkSession, d: str) -> DataFrame:
    meta = table(spark, d, "indicator_meta").select(
        F.col("indicator_id").alias("m_id"), F.col("unit").alias("home"), "data_quality_suspect_periods"
    )
    within = F.filter(
        "data_quality_suspect_periods",
        lambda p: day("obs_date").between(F.to_date(p["start_date"]), F.to_date(p["end_date"])),
    )
    rows = spread(table(spark, d, "source_records").select("rec_id", "indicator_id", "area_code", "obs_date", "value_text", "unit_text", "note"))
    return rows.join(meta, rows.indicator_id == meta.m_id, "left").select(
        F.col("rec_id").alias("id"), F.concat_ws("|", "indicator_id", "area_code").alias("series"), "home",
        F.col("value_text").alias("text"), F.col("unit_text").alias("field"), "note",
        F.array_join(F.transform(within, lambda p: p["reason"]), "; ").alias("span"),
    )


def p4_values(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(_records(spark, d)).withColumnRenamed("id", "rec_id")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return units.common_units(_records(spark, d)).where("unit <> home").select(
        F.col("id").alias("rec_id"), F.col("unit").alias("unit_code")
    )


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    text = lambda c: F.date_format(c, "yyyy-MM-dd").alias(c)
    usable = _panel(spark, d).where(F.col("obs_day").isNotNull())
    return validity.history(usable, OBSERVATION, "known_day", "row_id", ["value"]).select(
        "indicator_id", "area_code", text("obs_day"), text("valid_from"), text("valid_to")
    )


def p5_history(spark: SparkSession, d: str) -> DataFrame:
    usable = _panel(spark, d).where(F.col("obs_day").isNotNull())
    return validity.history(usable, OBSERVATION, "known_day", "row_id", ["value"])


def _rolling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_close").select("ticker", day("obs_date").alias("day"), "close", "row_id")
    return rolling.maintained(rows, "ticker", "day", "close", "row_id")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return rolling.empty_windows(_rolling(spark, d)).select(
        F.col("entity").alias("ticker"), F.date_format("day", "yyyy-MM-dd").alias("obs_day"), "window_days"
    )


def _rounded(state: DataFrame) -> DataFrame:
    return rolling.figures(state).select(
        "entity", F.date_format("day", "yyyy-MM-dd").alias("obs_day"), "window_days", "n",
        F.round("total", 4).alias("total"), F.round("average", 8).alias("average"),
    )


def p6_rolling(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_rolling(spark, d))


def p6_panel_rolling(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "vintage_panel").where("value is not null").select(
        F.concat_ws("|", "indicator_id", "area_code").alias("series"), day("obs_date").alias("day"), "value", "row_id"
    )
    return _rounded(rolling.maintained(rows, "series", "day", "value", "row_id"))


def queries() -> dict:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_values, p2_found, p2_grid, p3_found, p3_reasons, p4_found, p4_values, p5_found, p5_history, p6_found, p6_rolling, p6_panel_rolling,
        )
    }


_KNOWN = """
known as (
  select p.row_id, p.indicator_id, p.area_code, p.obs_date::date as obs_day, p.value,
         coalesce(p.realtime_start::date, p.obs_date::date + m.release_lag_days) as known_day
  from vintage_panel p left join indicator_meta m using (indicator_id))"""

_ANSWERS = f"""
with {_KNOWN},
ranked as (
  select r.request_id, k.row_id, k.value,
         row_number() over (partition by r.request_id order by k.known_day desc, k.row_id desc) as n
  from asof_requests r join known k
    on k.indicator_id = r.indicator_id and k.area_code = r.area_code and k.obs_day = r.obs_date::date
   and k.known_day <= r.as_of::date)"""

_HISTORY = f"""
with {_KNOWN},
days as (
  select * from known where known_day is not null and obs_day is not null
  qualify row_number() over (partition by indicator_id, area_code, obs_day, known_day order by row_id desc) = 1),
marked as (
  select *, lag(value) over w is distinct from value or row_number() over w = 1 as fresh
  from days window w as (partition by indicator_id, area_code, obs_day order by known_day)),
versions as (
  select *, lead(known_day) over (partition by indicator_id, area_code, obs_day order by known_day) as following
  from marked where fresh)"""

_CLOSES = """
closes as (
  select ticker, obs_date::date as day, close from market_close
  qualify row_number() over (partition by ticker, obs_date::date order by row_id desc) = 1),
daily as (select ticker as entity, day, close as amount from closes where close is not null)"""

_PANEL_DAILY = """
daily as (
  select indicator_id || '|' || area_code as entity, obs_date::date as day, value as amount
  from vintage_panel where value is not null
  qualify row_number() over (partition by indicator_id, area_code, obs_date::date order by row_id desc) = 1)"""

_ROLLING = """
bounds as (select entity, min(day) as lo, max(day) as hi from daily group by entity),
days as (select entity, unnest(generate_series(lo, hi, interval 1 day))::date as day from bounds),
wide as (
  select d.entity, d.day, w.window_days, a.amount
  from days d cross join (values (7), (30)) w(window_days) left join daily a on a.entity = d.entity and a.day = d.day),
state as (
  select entity, day, window_days,
         case window_days when 7 then count(amount) over w7 else count(amount) over w30 end::int as n,
         case window_days when 7 then sum(amount) over w7 else sum(amount) over w30 end as total
  from wide
  window w7 as (partition by entity, window_days order by day range between interval 6 day preceding and current row),
         w30 as (partition by entity, window_days order by day range between interval 29 day preceding and current row))"""

_PERIODS = """
readings as (
  select p.indicator_id || '|' || p.area_code as series_key,
         case upper(m.frequency[1]) when 'B' then 'D' else upper(m.frequency[1]) end as period, p.obs_date::date as day, p.value
  from vintage_panel p join indicator_meta m using (indicator_id) where p.value is not null
  union all select entity, 'B', day, amount from daily),
placed as (
  select *, case period when 'W' then date_trunc('week', day)::date when 'M' then date_trunc('month', day)::date
    when 'Q' then date_trunc('quarter', day)::date else day end as period_start from readings),
seen as (
  select series_key, period, period_start, min({'d': day, 'v': value}) as f, max({'d': day, 'v': value}) as l
  from placed group by all),
bounds as (select series_key, period, min(period_start) as lo, max(period_start) as hi from seen group by all),
grid as (
  select series_key, period, unnest(case period when 'W' then generate_series(lo, hi, interval 7 day)
    when 'M' then generate_series(lo, hi, interval 1 month) when 'Q' then generate_series(lo, hi, interval 3 month)
    else generate_series(lo, hi, interval 1 day) end)::date as period_start from bounds),
days as (
  select g.*, s.f, s.l, row_number() over (partition by g.series_key, g.period order by g.period_start) as n
  from grid g left join seen s using (series_key, period, period_start)
  where g.period <> 'B' or isodow(g.period_start) < 6)"""

_GRID = f"""
with {_CLOSES}, {_PERIODS},
near as (
  select *, last_value(case when l is not null then {{'n': n, 'd': l.d, 'v': l.v}} end ignore nulls)
              over (partition by series_key, period order by period_start rows between unbounded preceding and 1 preceding) as b,
            first_value(case when f is not null then {{'n': n, 'd': f.d, 'v': f.v}} end ignore nulls)
              over (partition by series_key, period order by period_start rows between 1 following and unbounded following) as a
  from days),
counted as (select *, case when l is null then a.n - b.n - 1 else 0 end::int as gap_periods from near)
select series_key, strftime(period_start, '%Y-%m-%d') as period_start,
       case when l is not null then 'observed' when gap_periods <= {grid.MAX_GAP_PERIODS} then 'interpolated' else 'gap' end as status,
       gap_periods,
       round(case when l is not null then l.v when gap_periods <= {grid.MAX_GAP_PERIODS}
         then b.v + (a.v - b.v) * ((period_start - b.d)::double / (a.d - b.d)::double) end, 8) as value
from counted"""

_STATE = """
select entity, strftime(day, '%Y-%m-%d') as obs_day, window_days, n, round(coalesce(total, 0.0::double), 4) as total,
       round(total / n, 8) as average from state"""


def oracle_sql() -> dict:
    return {
        "p1_found": f"{_ANSWERS} select request_id, row_id from ranked where n = 1",
        "p1_values": f"""{_ANSWERS} select r.request_id, r.indicator_id, r.area_code, r.obs_date::date as obs_day,
            r.as_of::date as as_of_day, a.row_id, a.value from ranked a join asof_requests r using (request_id) where n = 1""",
        "p2_found": f"""with {_CLOSES}, {_PERIODS}
            select series_key, strftime(period_start, '%Y-%m-%d') as period_start from days where l is null""",
        "p2_grid": _GRID,
        "p5_found": f"""{_HISTORY} select indicator_id, area_code, strftime(obs_day, '%Y-%m-%d') as obs_day,
            strftime(known_day, '%Y-%m-%d') as valid_from,
            coalesce(strftime(following, '%Y-%m-%d'), '9999-12-31') as valid_to from versions""",
        "p5_history": f"""{_HISTORY} select indicator_id, area_code, obs_day, value, known_day as valid_from,
            coalesce(following, date '9999-12-31') as valid_to, following is null as is_current from versions""",
        "p6_found": f"""with {_CLOSES}, {_ROLLING} select entity as ticker, strftime(day, '%Y-%m-%d') as obs_day,
            window_days from state where n = 0""",
        "p6_rolling": f"with {_CLOSES}, {_ROLLING} {_STATE}",
        "p6_panel_rolling": f"with {_PANEL_DAILY}, {_ROLLING} {_STATE}",
    }
