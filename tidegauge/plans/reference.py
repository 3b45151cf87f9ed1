"""Point-in-time, preparation, feature, regression and audit queries over the synthetic tables, with DuckDB statements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import scalar
from tidegauge.operators import audit, regime, series, validity
from tidegauge.plans.problems import _ANSWERS, _CLOSES, _KNOWN, OBSERVATION, _closes, _panel, p1_values
from tidegauge.tables import day, period_letter, table

QUERIES: dict = {}
SQL: dict[str, str] = {}

#: Last day of each year for which snapshots are taken.
YEARS = range(2008, 2025)


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


def _series(spark: SparkSession, d: str) -> DataFrame:
    return _closes(spark, d).select(F.col("entity").alias("id"), "day", F.col("amount").alias("value"))


def _with_nulls(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "market_close").select(F.col("ticker").alias("id"), day("obs_date").alias("day"), F.col("close").alias("value"), "row_id")
    return series.dedupe_last(rows, ["id", "day"], "row_id", ["value"])


_S = f"""with {_CLOSES}, s as (select entity as id, day, amount as value from daily)"""
_SN = """with n as (
  select ticker as id, obs_date::date as day, close as value from market_close
  qualify row_number() over (partition by ticker, obs_date::date order by row_id desc) = 1)"""


# Vintages and visibility


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = _panel(spark, d).where("obs_day is not null")
    versions = validity.latest_per_day(rows, OBSERVATION, "known_day", "row_id", ["row_id", "value"])
    until = F.lead("__start").over(Window.partitionBy(*OBSERVATION).orderBy("__start"))
    return versions.select(*OBSERVATION, F.col("__start").alias("known_day"), until.alias("until_day"), "row_id", "value")


_INTERVALS = f"""
with {_KNOWN}, days as (
  select * from known where known_day is not null and obs_day is not null
  qualify row_number() over (partition by indicator_id, area_code, obs_day, known_day order by row_id desc) = 1),
intervals as (
  select indicator_id, area_code, obs_day, known_day,
         lead(known_day) over (partition by indicator_id, area_code, obs_day order by known_day) as until_day, row_id, value
  from days)"""


@query(f"{_INTERVALS} select * from intervals")
def vintage_intervals(spark, d):
    return _intervals(spark, d)


_ANCHORS = f"anchors as (select make_date(y, 12, 31) as as_of from range({YEARS.start}, {YEARS.stop}) t(y))"


@query(f"""{_INTERVALS}, {_ANCHORS}
select as_of, indicator_id, area_code, count(*) as observations, count(value) as figures, max(obs_day) as last_obs_day,
       arg_max_null(value, obs_day) as last_value
from intervals join anchors on known_day <= as_of and (until_day is null or as_of < until_day) group by all""")
def pit_snapshot(spark, d):
    """Series as they stood at each year's end: a version names the year ends it covers, so no range join is needed."""
    i = _intervals(spark, d)
    first = F.greatest(F.year("known_day"), F.lit(YEARS.start))
    ends_before = F.when(F.col("until_day") > F.make_date(F.year("until_day"), F.lit(12), F.lit(31)), F.year("until_day")).otherwise(F.year("until_day") - 1)
    last = F.least(F.coalesce(ends_before, F.lit(YEARS.stop - 1)), F.lit(YEARS.stop - 1))
    covered = i.where(first <= last).withColumn("y", F.explode(F.sequence(first, last)))
    return covered.groupBy(F.make_date("y", F.lit(12), F.lit(31)).alias("as_of"), "indicator_id", "area_code").agg(
        F.count("*").alias("observations"), F.count("value").alias("figures"), F.max("obs_day").alias("last_obs_day"),
        F.max_by("value", "obs_day").alias("last_value"),
    )


@query(f"""{_ANSWERS} select r.request_id, a.row_id, a.value, a.row_id is not null as answered
from asof_requests r left join (select * from ranked where n = 1) a using (request_id)""")
def pit_point_lookup(spark, d):
    asked = table(spark, d, "asof_requests").select("request_id")
    return asked.join(p1_values(spark, d).select("request_id", "row_id", "value"), "request_id", "left").select(
        "request_id", "row_id", "value", F.col("row_id").isNotNull().alias("answered")
    )


@query(f"""with {_KNOWN} select indicator_id, area_code, obs_day, arg_max(value, {{'d': known_day, 'r': row_id}}) as value
from known where value is not null and obs_day is not null and known_day <= date '2015-12-31' group by all""")
def loader_vintage_last_nonnull(spark, d):
    rows = _panel(spark, d).where("value is not null and obs_day is not null and known_day <= date'2015-12-31'")
    return rows.groupBy(*OBSERVATION).agg(F.max_by("value", F.struct("known_day", "row_id")).alias("value"))


@query(f"""with {_KNOWN} select indicator_id, area_code, obs_day, arg_max_null(value, row_id) as value, max(row_id) as row_id
from known where obs_day is not null group by all""")
def latest_view(spark, d):
    rows = _panel(spark, d).where("obs_day is not null")
    return rows.groupBy(*OBSERVATION).agg(F.max_by("value", "row_id").alias("value"), F.max("row_id").alias("row_id"))


@query("""select r.indicator_id, r.area_code, count(*) as visible, max(r.obs_ts::date) as last_obs_day
from series_readings r join indicator_meta m using (indicator_id)
where r.obs_ts::date + m.release_lag_days <= date '2019-06-30' group by all""")
def release_lag_visibility(spark, d):
    lag = table(spark, d, "indicator_meta").select("indicator_id", "release_lag_days")
    seen = table(spark, d, "series_readings").withColumn("obs_day", day("obs_ts")).join(lag, "indicator_id")
    return seen.where(F.date_add("obs_day", F.col("release_lag_days")) <= F.lit("2019-06-30").cast("date")).groupBy("indicator_id", "area_code").agg(
        F.count("*").alias("visible"), F.max("obs_day").alias("last_obs_day")
    )


@query("""with v as (select indicator_id, count(*) as vintages from vintage_panel where realtime_start is not null group by all)
select m.indicator_id, case when needs_vintage and coalesce(vintages, 0) > 0 then 'vintage panel' when needs_vintage then 'violation'
  when coalesce(release_lag_days, 0) > 0 then 'release lag' else 'truncation' end as basis, coalesce(vintages, 0) as vintages
from indicator_meta m left join v using (indicator_id)""")
def pit_dispatch_basis(spark, d):
    v = table(spark, d, "vintage_panel").where("realtime_start is not null").groupBy("indicator_id").agg(F.count("*").alias("vintages"))
    m = table(spark, d, "indicator_meta").join(v, "indicator_id", "left").withColumn("vintages", F.coalesce("vintages", F.lit(0)))
    basis = (
        F.when(F.col("needs_vintage") & (F.col("vintages") > 0), "vintage panel").when(F.col("needs_vintage"), "violation")
        .when(F.coalesce("release_lag_days", F.lit(0)) > 0, "release lag").otherwise("truncation")
    )
    return m.select("indicator_id", basis.alias("basis"), "vintages")


@query(f"""with {_KNOWN}, {_ANCHORS},
releases as (select distinct indicator_id, known_day from known where known_day is not null and obs_day is not null),
latest as (select as_of, indicator_id, max(known_day) as known_day from releases join anchors on known_day <= as_of group by all)
select as_of, indicator_id, known_day, count(*) as rows_in_release, count(value) as figures
from latest join known using (indicator_id, known_day) where obs_day is not null group by all""")
def model_vintage_asof(spark, d):
    """The whole latest release of each indicator as of each year's end."""
    rows = _panel(spark, d).where("known_day is not null and obs_day is not null")
    size = rows.groupBy("indicator_id", "known_day").agg(F.count("*").alias("rows_in_release"), F.count("value").alias("figures"))
    asked = table(spark, d, "indicator_meta").select("indicator_id", F.explode(F.array(*[F.lit(f"{y}-12-31").cast("date") for y in YEARS])).alias("as_of"))
    found = series.asof_join(asked, size, ["indicator_id"], "as_of", "known_day", ["rows_in_release", "figures"])
    return found.where("since is not null").select("as_of", "indicator_id", F.col("since").alias("known_day"), "rows_in_release", "figures")


@query("""with p as (select indicator_id, unit, unnest(data_quality_suspect_periods) as p from indicator_meta)
select s.rec_id from source_records s where exists (select 1 from p where p.indicator_id = s.indicator_id
  and s.obs_date::date between p.p.start_date::date and p.p.end_date::date)""")
def suspect_period_semi(spark, d):
    meta = table(spark, d, "indicator_meta").select("indicator_id", "data_quality_suspect_periods")
    within = F.exists("data_quality_suspect_periods", lambda p: day("obs_date").between(F.to_date(p["start_date"]), F.to_date(p["end_date"])))
    return table(spark, d, "source_records").join(meta, "indicator_id").where(within).select("rec_id")


# Calendars and alignment


@query(f"""{_S}, b as (select id, min(day) as lo, max(day) as hi from s group by id),
g as (select id, unnest(generate_series(lo, hi, interval 1 day))::date as day from b)
select id, count(*) as business_days, min(day) as first_day, max(day) as last_day from g where isodow(day) < 6 group by id""")
def bday_calendar(spark, d):
    b = _series(spark, d).groupBy("id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    return series.business_days(b, "lo", "hi").groupBy("id").agg(
        F.count("*").alias("business_days"), F.min("day").alias("first_day"), F.max("day").alias("last_day")
    )


@query(f"""{_SN}, b as (select id, min(day) as lo, max(day) as hi from n group by id),
g as (select id, unnest(generate_series(lo, hi, interval 1 day))::date as day from b)
select g.id, g.day, n.value from g asof left join n on g.id = n.id and g.day >= n.day where isodow(g.day) < 6""")
def bday_ffill(spark, d):
    return series.forward_fill(_with_nulls(spark, d))


@query(f"""{_S}, o as (select indicator_id, area_code, obs_date::date as obs_day, arg_max_null(value, row_id) as value
  from vintage_panel where obs_date is not null group by all),
asked as (select * from (select distinct indicator_id, area_code from o) cross join (select distinct last_day(day) as month_end from s)),
f as (select * from o where value is not null)
select a.indicator_id, a.area_code, a.month_end, f.obs_day, f.value from asked a
asof left join f on a.indicator_id = f.indicator_id and a.area_code = f.area_code and a.month_end >= f.obs_day""")
def align_indicators(spark, d):
    """The figure in force of every indicator and area on each month end of the market, in the last version of each observation."""
    latest = latest_view(spark, d)
    # One value, bounded by the calendar.
    month_ends = _series(spark, d).agg(F.collect_set(F.last_day("day"))).scalar()
    asked = latest.select("indicator_id", "area_code").distinct().select("indicator_id", "area_code", F.explode(month_ends).alias("month_end"))
    held = latest.where("value is not null").select("indicator_id", "area_code", "obs_day", "value")
    found = series.asof_join(asked, held, ["indicator_id", "area_code"], "month_end", "obs_day", ["value"])
    return found.select("indicator_id", "area_code", "month_end", F.col("since").alias("obs_day"), "value")


# Preparation


@query("""select indicator_id, area_code, obs_date::date as obs_day, arg_max_null(value_text, rec_id) as value_text, max(rec_id) as rec_id
from source_records group by all""")
def dedupe_keep_last(spark, d):
    rows = table(spark, d, "source_records").select("indicator_id", "area_code", day("obs_date").alias("obs_day"), "value_text", "rec_id")
    return series.dedupe_last(rows, OBSERVATION, "rec_id", ["value_text", "rec_id"])


@query("""select r.indicator_id, r.area_code, count(*) as n, count(value) as figures, min(value) as least, max(value) as greatest,
  coalesce(sum((value < expected_min or value > expected_max)::int), 0)::bigint as beyond,
  case when count(value) = 0 then 'empty' when coalesce(bool_or(value < expected_min or value > expected_max), false) then 'out of range' else 'ok' end as outcome
from series_readings r left join indicator_meta m using (indicator_id) group by all""")
def ingest_checks(spark, d):
    limits = table(spark, d, "indicator_meta").select("indicator_id", "expected_min", "expected_max")
    beyond = (F.col("value") < F.col("expected_min")) | (F.col("value") > F.col("expected_max"))
    return table(spark, d, "series_readings").join(limits, "indicator_id", "left").groupBy("indicator_id", "area_code").agg(
        F.count("*").alias("n"), F.count("value").alias("figures"), F.min("value").alias("least"), F.max("value").alias("greatest"),
        F.coalesce(F.sum(beyond.cast("int")), F.lit(0)).alias("beyond"),
        F.when(F.count("value") == 0, "empty").when(F.coalesce(F.bool_or(beyond), F.lit(False)), "out of range").otherwise("ok").alias("outcome"),
    )


def _readings(spark, d) -> DataFrame:
    rows = table(spark, d, "series_readings").select(
        F.concat_ws("|", "indicator_id", "area_code").alias("id"), day("obs_ts").alias("day"), "value", "row_id"
    )
    return series.dedupe_last(rows, ["id", "day"], "row_id", ["value"])


_R = """with r as (
  select indicator_id || '|' || area_code as id, obs_ts::date as day, value from series_readings
  qualify row_number() over (partition by indicator_id, area_code, obs_ts::date order by row_id desc) = 1)"""


@query(f"""{_R}, q as (select id, quantile_cont(value, 0.25) as a, quantile_cont(value, 0.75) as b, count(value) as n from r group by id)
select id, day, value, coalesce(n >= 4 and b > a and (value < a - 5 * (b - a) or value > b + 5 * (b - a)), false) as is_outlier from r join q using (id)""")
def iqr_flags(spark, d):
    return series.quartile_flags(_readings(spark, d))


_GAPS = f"""{_R}, k as (select *, row_number() over (partition by id order by day) as n, count(*) over (partition by id) as total from r),
near as (select *, max(case when value is not null then {{'n': n, 'v': value}} end) over (partition by id order by day rows between unbounded preceding and current row) as a,
  min(case when value is not null then {{'n': n, 'v': value}} end) over (partition by id order by day rows between current row and unbounded following) as b from k),
f as (select id, day, value, a, b, n, case when value is not null then 0 else coalesce(b.n, total + 1) - coalesce(a.n, 0) - 1 end::int as run from near)"""


@query(f"""{_GAPS} select id, day, round(case when value is not null then value when a.n is not null and b.n is not null and run <= 5
  then a.v + (b.v - a.v) * (n - a.n) / (b.n - a.n) end, 6) as value, run from f""")
def gap_interpolate(spark, d):
    return series.fill_gaps(_readings(spark, d)).withColumn("value", F.round("value", 6))


@query(f"""{_GAPS} select id, run, count(*) / run as runs from f where run > 0 group by id, run""")
def null_runs(spark, d):
    runs = series.fill_gaps(_readings(spark, d)).where("run > 0")
    return runs.groupBy("id", "run").agg((F.count("*") / F.col("run")).alias("runs"))


@query("""with u(unit, factor) as (values ('USD', 1e-6), ('K_USD', 1e-3), ('M_USD', 1.0), ('B_USD', 1e3), ('T_USD', 1e6))
select p.row_id, round(p.value * u.factor::double, 6) as m_usd from vintage_panel p join indicator_meta m using (indicator_id) join u using (unit)""")
def unit_convert(spark, d):
    factor = F.create_map(*[x for u, f in {"USD": 1e-6, "K_USD": 1e-3, "M_USD": 1.0, "B_USD": 1e3, "T_USD": 1e6}.items() for x in (F.lit(u), F.lit(f))])
    meta = table(spark, d, "indicator_meta").select("indicator_id", factor[F.col("unit")].alias("factor")).where("factor is not null")
    return table(spark, d, "vintage_panel").join(meta, "indicator_id").select("row_id", F.round(F.col("value") * F.col("factor"), 6).alias("m_usd"))


# Trailing features


@query(f"""{_S}, l as (select id, arg_max(value, day) as latest from s group by id)
select id, latest, avg((value <= latest)::int)::double as share from s join l using (id) group by all""")
def pct_rank_last(spark, d):
    s = _series(spark, d)
    latest = s.groupBy("id").agg(F.max_by("value", "day").alias("latest"))
    return s.join(latest, "id").groupBy("id", "latest").agg(F.avg((F.col("value") <= F.col("latest")).cast("double")).alias("share"))


@query(f"""{_S} select id, round((arg_max(value, day) - avg(value)) / nullif(stddev_samp(value), 0), 6) as z, round(median(value), 6) as middle,
  count(*) as n from s group by id""")
def zscore_full(spark, d):
    return _series(spark, d).groupBy("id").agg(
        F.round((F.max_by("value", "day") - F.avg("value")) / F.nullif(F.stddev_samp("value"), F.lit(0.0)), 6).alias("z"),
        F.round(F.median("value"), 6).alias("middle"), F.count("*").alias("n"),
    )


_M = f"""{_S}, m as (select id, last_day(day) as month_end, arg_max(day, day) as last_day, arg_max(value, day) as value from s group by id, last_day(day))"""


@query(f"{_M} select id, month_end, last_day as day, value from m")
def month_end_last(spark, d):
    return series.month_end_last(_series(spark, d))


@query(f"""{_S} select id, date_trunc('month', day)::date as month_start, round(avg(value), 9) as mean, count(*) as n from s group by all""")
def month_start_mean(spark, d):
    return _series(spark, d).groupBy("id", F.trunc("day", "month").alias("month_start")).agg(F.round(F.avg("value"), 9).alias("mean"), F.count("*").alias("n"))


def _trailing_sql(rows: int, expression: str, name: str) -> str:
    return f"""{_S} select id, day, {expression} as {name} from s
window w as (partition by id order by day rows between {rows - 1} preceding and current row)"""


_Z = "round(case when count(value) over w >= {least} and stddev_samp(value) over w > 1e-12 then (value - avg(value) over w) / stddev_samp(value) over w end, 5)"


@query(_trailing_sql(24, _Z.format(least=24), "z"))
def trailing_z24(spark, d):
    return _series(spark, d).select("id", "day", F.round(series.trailing_z(F.col("value"), 24, 24), 5).alias("z"))


@query(_trailing_sql(60, _Z.format(least=60), "z"))
def trailing_z60(spark, d):
    return _series(spark, d).select("id", "day", F.round(series.trailing_z(F.col("value"), 60, 60), 5).alias("z"))


@query(f"""{_S}, h as (select id, day, value, list(value) over (partition by id order by day rows between 251 preceding and current row) as held from s)
select id, day, case when len(held) >= 60 then len(list_filter(held, lambda x: x <= value)) / len(held) end as share from h""")
def trailing_pctile252(spark, d):
    return series.trailing_rank(_series(spark, d), 252, 60)


@query(_trailing_sql(252, "round(value / max(value) over w - 1, 8)", "drawdown"))
def drawdown252(spark, d):
    return _series(spark, d).select("id", "day", F.round(series.drawdown(F.col("value"), 252), 8).alias("drawdown"))


@query(f"""{_S} select a.id, a.day, round(a.value - b.value, 6) as change from s a asof left join s b on a.id = b.id and a.day - 30 >= b.day""")
def delta_30d(spark, d):
    return series.lagged_change(_series(spark, d), 30).select("id", "day", F.round(F.col("value") - F.col("before"), 6).alias("change"))


@query(f"""{_S}, x as (select id, day, value, (day - interval 12 month)::date as earlier from s)
select a.id, a.day, round((a.value / nullif(b.value, 0) - 1) * 100, 6) as yoy from x a asof left join s b on a.id = b.id and a.earlier >= b.day""")
def yoy_date(spark, d):
    s = _series(spark, d)
    held = s.select("id", F.col("day").alias("held_on"), F.col("value").alias("before"))
    found = series.asof_join(s.withColumn("earlier", F.add_months("day", -12)), held, ["id"], "earlier", "held_on", ["before"])
    return found.select("id", "day", F.round((F.col("value") / F.nullif("before", F.lit(0.0)) - 1) * 100, 6).alias("yoy"))


_GRIDM = f"""{_M}, b as (select id, min(month_end) as lo, max(month_end) as hi from m group by id),
g as (select id, last_day(unnest(generate_series(date_trunc('month', lo), hi, interval 1 month))::date) as month_end from b),
padded as (select g.id, g.month_end, m.value from g asof left join m on g.id = m.id and g.month_end >= m.month_end)"""


@query(f"""{_GRIDM} select id, month_end, round((value / nullif(lag(value, 12) over (partition by id order by month_end), 0) - 1) * 100, 6) as yoy from padded""")
def yoy_rows(spark, d):
    """Change over twelve rows of a gapless month grid, empty months padded first."""
    m = series.month_end_last(_series(spark, d))
    b = m.groupBy("id").agg(F.min("month_end").alias("lo"), F.max("month_end").alias("hi"))
    grid = b.select("id", F.explode(F.expr("sequence(trunc(lo, 'month'), hi, interval 1 month)")).alias("m")).select("id", F.last_day("m").alias("month_end"))
    held = m.select("id", F.col("month_end").alias("held"), "value")
    padded = series.asof_join(grid, held, ["id"], "month_end", "held", ["value"])
    before = F.lag("value", 12).over(Window.partitionBy("id").orderBy("month_end"))
    return padded.select("id", "month_end", F.round((F.col("value") / F.nullif(before, F.lit(0.0)) - 1) * 100, 6).alias("yoy"))


@query(f"""{_S} select id, day, round(avg(value) over (partition by id order by day range between interval 365 days preceding and current row), 9) as mean from s""")
def trailing_year_mean(spark, d):
    w = Window.partitionBy("id").orderBy(F.unix_date("day")).rangeBetween(-365, 0)
    return _series(spark, d).select("id", "day", F.round(F.avg("value").over(w), 9).alias("mean"))


_FEATURES = f"""{_S}, f as (select id, day, value,
  case when count(value) over w60 >= 60 and stddev_samp(value) over w60 > 1e-12 then (value - avg(value) over w60) / stddev_samp(value) over w60 end as z,
  value / max(value) over w60 - 1 as fall, value / nullif(lag(value, 20) over (partition by id order by day), 0) - 1 as move
  from s window w60 as (partition by id order by day rows between 59 preceding and current row))"""


def _features(spark, d) -> DataFrame:
    before = F.lag("value", 20).over(Window.partitionBy("id").orderBy("day"))
    return _series(spark, d).select(
        "id", "day", "value", series.trailing_z(F.col("value"), 60, 60).alias("z"), series.drawdown(F.col("value"), 60).alias("fall"),
        (F.col("value") / F.nullif(before, F.lit(0.0)) - 1).alias("move"),
    )


@query(f"""{_FEATURES}, c as (select id, day, 1 / (1 + exp(-z)) as a, least(1, greatest(0, (-fall - 0.02) / 0.08)) as b, 1 / (1 + exp(move / 0.05)) as c from f),
p as (select id, day, unnest([{{'n': 'heat', 'x': a, 'w': 0.5}}, {{'n': 'fall', 'x': b, 'w': 0.3}}, {{'n': 'move', 'x': c, 'w': 0.2}}]) as p from c)
select id, day, count(p.x) as active, round(least(1, greatest(0, sum(p.w * p.x) / sum(case when p.x is not null then p.w end)))::double, 6) as score from p
group by id, day having count(p.x) > 0""")
def composite_score(spark, d):
    """Weighted mean of normalised components; the weights of absent ones go to the others in proportion."""
    f = _features(spark, d)
    parts = [
        ("heat", scalar.sigmoid(F.col("z")), 0.5),
        ("fall", F.when(F.col("fall").isNotNull(), scalar.ramp(-F.col("fall"), 0.02, 0.1)), 0.3),
        ("move", scalar.sigmoid(-F.col("move") / 0.05), 0.2),
    ]
    weighed = sum((F.coalesce(x * w, F.lit(0.0)) for _, x, w in parts), F.lit(0.0))
    weight = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(0.0) for _, x, w in parts), F.lit(0.0))
    active = sum((x.isNotNull().cast("long") for _, x, _ in parts), F.lit(0))
    return f.select("id", "day", active.alias("active"), F.round(scalar.clip(weighed / F.nullif(weight, F.lit(0.0)), 0.0, 1.0), 6).alias("score")).where("active > 0")


@query(f"""{_FEATURES}, h as (select id, day, 
  coalesce((fall > -0.02)::int, 0) + coalesce((z between -1 and 1)::int, 0) + coalesce((abs(move) < 0.03)::int, 0) as calm,
  coalesce((z > 1)::int, 0) + coalesce((move > 0.03)::int, 0) + coalesce((fall > -0.005)::int, 0) as heated,
  coalesce((z < -1)::int, 0) + coalesce((move < -0.03)::int, 0) + coalesce((fall < -0.05)::int, 0) as strained from f)
select id, day, case when greatest(strained, heated, calm) < 2 then 'indeterminate' when strained >= heated and strained >= calm then 'strained'
  when heated >= calm then 'heated' else 'calm' end as label from h""")
def rule_vote(spark, d):
    """Three-valued rules per label, two true ones at least, ties by order."""
    z, move, fall = F.col("z"), F.col("move"), F.col("fall")
    rules = {
        "strained": [z < -1, move < -0.03, fall < -0.05], "heated": [z > 1, move > 0.03, fall > -0.005],
        "calm": [fall > -0.02, z.between(-1, 1), F.abs(move) < 0.03],
    }
    return _features(spark, d).select("id", "day", regime.vote(rules).alias("label"))


# Turning points


_POINTS = "points(month, kind, announced) as (values " + ", ".join(f"(date '{m}', '{k}', date '{a}')" for m, k, a in regime.TURNING_POINTS) + ")"
_ASKED = "asked as (select distinct date_trunc('month', obs_date)::date as month, (obs_date::date + 400) as as_of from vintage_panel where obs_date is not null)"


def _asked(spark, d) -> DataFrame:
    return table(spark, d, "vintage_panel").where("obs_date is not null").select(
        F.trunc(day("obs_date"), "month").alias("month"), F.date_add(day("obs_date"), 400).alias("as_of")
    ).distinct()


@query(f"""with {_POINTS}, {_ASKED}, l as (select a.month, a.as_of, max({{'m': p.month, 'k': p.kind}}) as p
  from asked a join points p on p.announced <= a.as_of and p.month <= a.month group by all)
select month, as_of, case when p.m = month then case p.k when 'peak' then 'expansion' else 'recession' end
  else case p.k when 'peak' then 'recession' else 'expansion' end end as state from l""")
def turning_point_state(spark, d):
    return _asked(spark, d).select("month", "as_of", regime.state_at(F.col("month"), F.col("as_of")).alias("state")).where("state is not null")


@query(f"""with {_POINTS}, {_ASKED} select a.month, a.as_of, arg_max(p.month, p.month) as point, arg_max(p.kind, p.month) as kind
from asked a join points p on p.announced <= a.as_of group by all""")
def last_known_label(spark, d):
    point = regime.last_point(F.col("as_of"))
    return _asked(spark, d).select("month", "as_of", point["month"].alias("point"), point["kind"].alias("kind")).where("point is not null")


@query()
def hmm_decode(spark, d):
    """States of each ticker's months by a model fitted on the months of all tickers."""
    f = _features(spark, d).where("move is not null and fall is not null")
    months = f.groupBy(F.col("id").alias("ticker"), F.last_day("day").alias("month_end")).agg(F.avg("move").alias("move"), F.avg("fall").alias("fall"))
    features = ["move", "fall"]
    return regime.decode(months, "ticker", "month_end", features, regime.fit_markov_all(months, "ticker", "month_end", features, rounds=50))


# Regressions and signals


def _forward_sql(h: int) -> str:
    return f"""{_M}, e as (select id, max(day) as last_raw from s group by id),
a as (select m.id, m.month_end, m.value, (m.month_end + interval {h} month)::date as target from m join e using (id)
  where (m.month_end + interval {h} month)::date <= last_raw),
fwd as (select a.id, a.month_end, b.value / a.value - 1 as forward from a asof join m b on a.id = b.id and a.target >= b.month_end where a.value <> 0)"""


@query(f"{_forward_sql(12)} select id, month_end, round(forward, 8) as forward from fwd")
def forward_return(spark, d):
    return series.forward_returns(_series(spark, d), 12).withColumn("forward", F.round("forward", 8))


def _pairs(spark, d, months: int) -> DataFrame:
    s = _series(spark, d)
    move = series.lagged_change(s, 90).select("id", "day", (F.col("value") / F.nullif("before", F.lit(0.0)) - 1).alias("x"))
    at_end = series.month_end_last(move.withColumnRenamed("x", "value")).select("id", "month_end", F.col("value").alias("x"))
    return series.forward_returns(s, months).join(at_end, ["id", "month_end"], "left").select(
        "id", F.col("month_end").alias("position"), "x", F.col("forward").alias("y")
    )


def _hac_sql(h: int) -> str:
    lags = range(1, h)
    z = "".join(f", lag(z, {k}) over (partition by id order by month_end) as z{k}" for k in lags)
    of = lambda v: f"sum({v} * {v})" + "".join(f" + {2 * (1 - k / h)!r} * coalesce(sum({v} * {v}{k}), 0)" for k in lags)
    z += "".join(f", lag(c, {k}) over (partition by id order by month_end) as c{k}" for k in lags)
    return f"""{_forward_sql(h)}, mv as (select a.id, a.day, a.value / nullif(b.value, 0) - 1 as x from s a asof left join s b on a.id = b.id and a.day - 90 >= b.day),
xm as (select id, last_day(day) as month_end, arg_max(x, day) as x from mv where x is not null group by all),
pairs as (select fwd.id, fwd.month_end, x, forward as y from fwd join xm using (id, month_end)),
fit as (select id, count(*) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, regr_r2(y, x) as r2, avg(x) as mx, regr_sxx(y, x) as sxx
  from pairs group by id having count(*) >= 3 and regr_sxx(y, x) > 0),
u as (select p.*, f.* exclude (id), y - intercept - slope * x as u, (x - mx) * (y - intercept - slope * x) / sxx as z,
  (1.0::double / n - mx * (x - mx) / sxx) * (y - intercept - slope * x) as c from pairs p join fit f using (id)),
zz as (select *{z} from u),
hac as (select id, first(n) as n, first(slope) as slope, first(intercept) as intercept, first(r2) as r2,
  sqrt(greatest({of('z')}, 0)) as slope_se, sqrt(greatest({of('c')}, 0)) as intercept_se, stddev_samp(u) as resid_se from zz group by id)"""


def _hac_columns() -> list[Column]:
    return [F.round(c, 6).alias(c) for c in ("slope", "intercept", "r2", "adj_r2", "slope_se", "intercept_se", "p_slope", "resid_se")]


_TAIL = f"t * exp(-slope * slope / slope_se / slope_se / 2 + ({' + t * ('.join(repr(c) for c in scalar.TAIL_COEFFICIENTS)}{')' * (len(scalar.TAIL_COEFFICIENTS) - 1)}))"


@query(_hac_sql(3) + f""", p as (select *, case when slope_se > 0 then 1 / (1 + 0.5 * abs(slope / slope_se) / sqrt(2)) end as t from hac)
select id, n, round(slope, 6) as slope, round(intercept, 6) as intercept, round(r2, 6) as r2, round(1 - (1 - r2) * (n - 1) / (n - 2), 6) as adj_r2,
  round(slope_se, 6) as slope_se, round(intercept_se, 6) as intercept_se, round({_TAIL}, 6) as p_slope, round(resid_se, 6) as resid_se from p""")
def hac_se(spark, d):
    return series.hac_regression(_pairs(spark, d, 3), ["id"], 2).select("id", "n", *_hac_columns())


_PANEL = " union all ".join(
    f"select * from ({_hac_sql(h)} select t.id, {h} as months, coalesce(c.n, 0) as n_nominal, r2 from (select distinct id from s) t left join hac using (id)"
    f" left join (select id, count(*) as n from pairs group by id) c using (id))" for h in (1, 3, 6)
)


def _panel_r2(spark, d) -> DataFrame:
    """All horizons from one frame of pairs."""
    s = _series(spark, d)
    ids = s.select("id", F.explode(F.array(*[F.lit(h) for h in (1, 3, 6)])).alias("months")).distinct()
    move = series.lagged_change(s, 90).select("id", "day", (F.col("value") / F.nullif("before", F.lit(0.0)) - 1).alias("value"))
    at_end = series.month_end_last(move).select("id", "month_end", F.col("value").alias("x"))
    forward = series.forward_returns_at(s, (1, 3, 6)).join(at_end, ["id", "month_end"])
    pairs = forward.where("x is not null and forward is not null").select(
        "id", "months", (F.col("months") - 1).alias("lags"), F.col("month_end").alias("position"), "x", F.col("forward").alias("y")
    )
    n = pairs.groupBy("id", "months").agg(F.count("*").alias("c"))
    fit = series.hac_by_lags(pairs, ["id", "months"], "lags").select("id", "months", "r2")
    rows = ids.join(n, ["id", "months"], "left").join(fit, ["id", "months"], "left").withColumn("n_nominal", F.coalesce("c", F.lit(0)))
    of = F.col("n_nominal")
    verdict = F.when(of < 2, "NO_OVERLAP").when(F.floor(of / F.col("months")) < 5, "UNDERPOWERED").otherwise("FULL")
    return rows.select("id", "months", "n_nominal", "r2", verdict.alias("verdict"))


_VERDICT = "case when n_nominal < 2 then 'NO_OVERLAP' when n_nominal // months < 5 then 'UNDERPOWERED' else 'FULL' end"


@query(f"select id, months, n_nominal, round(r2, 6) as r2, {_VERDICT} as verdict from ({_PANEL})")
def r2_panel(spark, d):
    return _panel_r2(spark, d).withColumn("r2", F.round("r2", 6))


@query(f"""select months, count(*) filter (v = 'FULL') as "FULL", count(*) filter (v = 'NO_OVERLAP') as "NO_OVERLAP",
  count(*) filter (v = 'UNDERPOWERED') as "UNDERPOWERED" from (select months, {_VERDICT} as v from ({_PANEL})) group by months""")
def verdict_pivot(spark, d):
    return _panel_r2(spark, d).groupBy("months").pivot("verdict", ["FULL", "NO_OVERLAP", "UNDERPOWERED"]).count().na.fill(0)


@query("""with x as (select indicator_id, outlier_flag as signal, value > expected_max or value < expected_min as label
  from series_readings join indicator_meta using (indicator_id) where value is not null and outlier_flag is not null),
c as (select indicator_id, count(*) filter (signal and coalesce(label, false)) as tp, count(*) filter (signal and not coalesce(label, false)) as fp,
  count(*) filter (not signal and coalesce(label, false)) as fn, count(*) filter (not signal and not coalesce(label, false)) as tn from x group by all),
n as (select *, (tp + fn)::double as n, tp::double as k, 1.959963984540054::double as z from c)
select indicator_id, tp, fp, fn, tn, round(k / nullif(n, 0), 8) as sensitivity, round(tn / nullif(fp + tn, 0), 8) as specificity,
  round(tp / nullif(tp + fp, 0), 8) as precision,
  round(case when n = 0 then 0 else greatest(0, (k / n + z * z / (2 * n) - z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)) end, 8) as sensitivity_low,
  round(case when n = 0 then 1 else least(1, (k / n + z * z / (2 * n) + z * sqrt(k / n * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n)) end, 8) as sensitivity_high,
  round((k + 1) / (n + 2), 8) as posterior_mean from n""")
def confusion_profile(spark, d):
    limits = table(spark, d, "indicator_meta").select("indicator_id", "expected_min", "expected_max")
    x = table(spark, d, "series_readings").where("value is not null and outlier_flag is not null").join(limits, "indicator_id")
    label = F.coalesce((F.col("value") > F.col("expected_max")) | (F.col("value") < F.col("expected_min")), F.lit(False))
    signal = F.col("outlier_flag")
    c = x.groupBy("indicator_id").agg(
        F.count_if(signal & label).alias("tp"), F.count_if(signal & ~label).alias("fp"),
        F.count_if(~signal & label).alias("fn"), F.count_if(~signal & ~label).alias("tn"),
    )
    n = (F.col("tp") + F.col("fn")).cast("double")
    low, high = scalar.wilson(F.col("tp").cast("double"), n)
    share = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 8)
    return c.select(
        "indicator_id", "tp", "fp", "fn", "tn", share(F.col("tp"), n).alias("sensitivity"),
        share(F.col("tn"), F.col("fp") + F.col("tn")).alias("specificity"), share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        F.round(low, 8).alias("sensitivity_low"), F.round(high, 8).alias("sensitivity_high"),
        F.round(scalar.beta_posterior_mean(F.col("tp"), n, 0.5, 2), 8).alias("posterior_mean"),
    )


@query("""with p as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, 3 + l_quantity / 50 as b0, -l_discount * 10 as b1, l_tax * 10 as b2,
  l_quantity / 25 as b3, 1 + l_linenumber / 4 as t1, case when l_linenumber % 3 = 0 then 5.0::double end as t2 from lineitem),
y as (select *, """ + ", ".join(f"""(1 - exp(-{t} / t1)) / ({t} / t1) as f{n}, exp(-{t} / t1) as e{n}, (1 - exp(-{t} / t2)) / ({t} / t2) - exp(-{t} / t2) as h{n}""" for n, t in ((1, 1.5), (2, 1.75))) + """ from p),
z as (select *, b0 + b1 * f1 + b2 * (f1 - e1) + coalesce(b3 * h1, 0) as z1, b0 + b1 * f2 + b2 * (f2 - e2) + coalesce(b3 * h2, 0) as z2 from y)
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round(z1, 8) as spot, round((z2 * 1.75 - z1 * 1.5) / 0.25, 6) as forward from z""")
def svensson_forward(spark, d):
    l = table(spark, d, "lineitem")  # noqa: E741
    t2 = F.when(F.col("l_linenumber") % 3 == 0, F.lit(5.0))
    curve = lambda tau: scalar.svensson_yield(
        tau, 3 + F.col("l_quantity") / 50, -F.col("l_discount") * 10, F.col("l_tax") * 10, F.col("l_quantity") / 25, 1 + F.col("l_linenumber") / 4, t2
    )
    return l.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(curve(1.5), 8).alias("spot"), F.round(scalar.forward_rate(1.5, 0.25, curve), 6).alias("forward")
    )


@query("""select l_returnflag, measure, round(sum(figure), 2) as total, count(*) as n from (
  select l_returnflag, unnest(['l_quantity', 'l_extendedprice', 'l_discount', 'l_tax']) as measure,
         unnest([l_quantity, l_extendedprice, l_discount, l_tax]) as figure from lineitem) group by all""")
def unpivot_wide(spark, d):
    wide = table(spark, d, "lineitem").select("l_returnflag", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    long = wide.unpivot("l_returnflag", ["l_quantity", "l_extendedprice", "l_discount", "l_tax"], "measure", "figure")
    return long.groupBy("l_returnflag", "measure").agg(F.round(F.sum("figure"), 2).alias("total"), F.count("*").alias("n"))


@query("""with here as (select distinct indicator_id from vintage_panel), there as (select distinct indicator_id from series_readings union select distinct indicator_id from source_records)
select m.indicator_id, h.indicator_id is not null as in_panel, t.indicator_id is not null as elsewhere
from indicator_meta m left join here h using (indicator_id) left join there t using (indicator_id)""")
def set_completeness(spark, d):
    ids = lambda t: table(spark, d, t).select("indicator_id").distinct()
    here = ids("vintage_panel").withColumn("h", F.lit(True))
    there = ids("series_readings").union(ids("source_records")).distinct().withColumn("t", F.lit(True))
    return table(spark, d, "indicator_meta").select("indicator_id").join(here, "indicator_id", "left").join(there, "indicator_id", "left").select(
        "indicator_id", F.col("h").isNotNull().alias("in_panel"), F.col("t").isNotNull().alias("elsewhere")
    )


@query(f"""{_S} select id, count(*) as n, min(day) as first_day, max(day) as last_day, arg_max(value, day) as last_value,
  list_transform(list(value order by day desc)[1:5], lambda x: round(x, 4)) as tail from s group by id""")
def series_summary(spark, d):
    """First and last day and the last five values of each series."""
    s = _series(spark, d)
    w = Window.partitionBy("id").orderBy(F.desc("day"))
    tail = s.withColumn("k", F.row_number().over(w)).where("k <= 5").groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("k", "value"))), lambda x: F.round(x["value"], 4)).alias("tail")
    )
    whole = s.groupBy("id").agg(F.count("*").alias("n"), F.min("day").alias("first_day"), F.max("day").alias("last_day"), F.max_by("value", "day").alias("last_value"))
    return whole.join(tail, "id").select("id", "n", "first_day", "last_day", "last_value", "tail")


@query("""select 'vintage_panel' as gate, 'row_id unique' as check_name, count(*) = count(distinct row_id) as passed, count(*) as rows_checked from vintage_panel
union all select 'vintage_panel', 'indicator known', bool_and(m.indicator_id is not null), count(*) from vintage_panel v left join indicator_meta m using (indicator_id)
union all select 'vintage_panel', 'end after start', coalesce(bool_and(realtime_end >= realtime_start), true), count(*) from vintage_panel
union all select 'market_close', 'close positive', coalesce(bool_and(close > 0), true), count(*) from market_close
union all select 'indicator_meta', 'range in order', coalesce(bool_and(expected_min <= expected_max), true), count(*) from indicator_meta""")
def gate_report(spark, d):
    panel, closes, meta = (table(spark, d, t) for t in ("vintage_panel", "market_close", "indicator_meta"))
    known = meta.select("indicator_id", F.lit(True).alias("known"))
    return audit.report([
        audit.unique(panel, "vintage_panel", "row_id"),
        audit.always(panel.join(known, "indicator_id", "left"), "vintage_panel", "indicator known", F.col("known").isNotNull()),
        audit.always(panel, "vintage_panel", "end after start", F.col("realtime_end") >= F.col("realtime_start")),
        audit.always(closes, "market_close", "close positive", F.col("close") > 0),
        audit.always(meta, "indicator_meta", "range in order", F.col("expected_min") <= F.col("expected_max")),
    ])


@query("""select s.indicator_id, s.area_code, count(*) as n, string_agg(distinct feed, ',' order by feed) as feeds,
  case when count(distinct feed) = 1 then min(feed) else 'mixed:' || string_agg(distinct feed, ',' order by feed) end as label from source_records s group by all""")
def source_label(spark, d):
    feeds = F.array_join(F.array_sort(F.collect_set("feed")), ",")
    return table(spark, d, "source_records").groupBy("indicator_id", "area_code").agg(
        F.count("*").alias("n"), feeds.alias("feeds"),
        F.when(F.count_distinct("feed") == 1, F.min("feed")).otherwise(F.concat(F.lit("mixed:"), feeds)).alias("label"),
    )


@query(f"""{_M}, market as (select month_end, avg(value) as mean from m group by month_end)
select id, month_end, round(value / nullif(mean, 0), 8) as ratio from m join market using (month_end)""")
def ratio_market(spark, d):
    """Ratio of every ticker's month ends to the mean month end of all tickers of that month."""
    m = series.month_end_last(_series(spark, d))
    market = m.groupBy("month_end").agg(F.avg("value").alias("mean"))
    return m.join(market, "month_end").select("id", "month_end", F.round(F.col("value") / F.nullif("mean", F.lit(0.0)), 8).alias("ratio"))


@query("""select indicator_id, case upper(frequency[1]) when 'B' then 'D' else upper(frequency[1]) end as period, unit, lower(source) as source from indicator_meta""")
def normalised_metadata(spark, d):
    return table(spark, d, "indicator_meta").select("indicator_id", period_letter(F.col("frequency")).alias("period"), "unit", F.lower("source").alias("source"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
