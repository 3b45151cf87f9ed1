"""Visibility, prepared series, calendar policies, regressions and signal statistics over the synthetic tables, with DuckDB statements."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.functions import scalar
from tidegauge.operators import access, intervals, regime, series
from tidegauge.plans.problems import _KNOWN
from tidegauge.plans.reference import _GRIDM, _M, _POINTS, _TAIL, _series, latest_view
from tidegauge.tables import day, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# Visibility

#: Days on which every indicator is asked for.
AS_OF = [datetime.date(2012, 6, 30), datetime.date(2018, 6, 30), datetime.date(2024, 6, 30)]
_DAYS = "asked(as_of) as (values " + ", ".join(f"(date '{d}')" for d in AS_OF) + ")"
_BASIS = """dated as (select indicator_id, count(*) as vintages from vintage_panel where realtime_start is not null group by all),
bases as (select m.indicator_id, case when needs_vintage and coalesce(vintages, 0) > 0 then 'vintage panel' when needs_vintage then 'violation'
  when coalesce(release_lag_days, 0) > 0 then 'release lag' else 'truncation' end as basis from indicator_meta m left join dated using (indicator_id))"""


@query(f"""with {_KNOWN}, {_DAYS}, {_BASIS}
select as_of, indicator_id, area_code, obs_day, value, row_id, basis
from asked join known on known_day <= as_of join bases using (indicator_id) where obs_day is not null and basis <> 'violation'
qualify row_number() over (partition by as_of, indicator_id, area_code, obs_day order by known_day desc, row_id desc) = 1""")
def state_as_of(spark: SparkSession, d: str) -> DataFrame:
    """Every observation of every indicator as it was known on each of the asked days, and on what that rests."""
    return access.known_at(table(spark, d, "vintage_panel"), table(spark, d, "indicator_meta"), AS_OF)


@query("""select r.row_id, r.indicator_id, r.area_code, r.obs_ts::date as obs_day, r.value, r.obs_ts::date + coalesce(m.release_lag_days, 0) as visible_from
from series_readings r join indicator_meta m using (indicator_id) where r.obs_ts::date + coalesce(m.release_lag_days, 0) <= date '2018-06-30'""")
def visible_readings(spark, d):
    """Readings out by the asked day, on their own days, with the day they came out."""
    lag = table(spark, d, "indicator_meta").select("indicator_id", "release_lag_days")
    rows = table(spark, d, "series_readings").withColumn("obs_day", day("obs_ts")).join(lag, "indicator_id")
    seen = access.visible(rows, "obs_day", F.col("release_lag_days"), AS_OF[1])
    out = F.date_add("obs_day", F.coalesce("release_lag_days", F.lit(0)).cast("int"))
    return seen.select("row_id", "indicator_id", "area_code", "obs_day", "value", out.alias("visible_from"))


_VINTAGE_KEYS = """v as (select indicator_id, area_code, obs_date::date as obs_day, value, row_id,
  year(realtime_start) || 'Q' || quarter(realtime_start) as vintage from vintage_panel where realtime_start is not null and obs_date is not null),
ends as (select *, last_day(make_date(vintage[1:4]::int, vintage[6:6]::int * 3, 1)) as vintage_end from v)"""


@query(f"""with {_VINTAGE_KEYS}, {_DAYS}, out as (select as_of, e.* from asked join ends e on vintage_end + 14 <= as_of),
last as (select as_of, indicator_id, arg_max(vintage, vintage_end) as vintage from out group by all)
select as_of, indicator_id, vintage, (any_value(vintage_end) + 14)::date as published, count(*) as rows_held, count(value) as figures, max(obs_day) as last_obs_day
from out join last using (as_of, indicator_id, vintage) where obs_day <= vintage_end group by all""")
def quarter_vintages(spark, d):
    """Per indicator and asked day the last quarter's vintage that was out, cut at its quarter's end."""
    key = F.concat(F.year("realtime_start"), F.lit("Q"), F.quarter("realtime_start"))
    v = table(spark, d, "vintage_panel").where("realtime_start is not null and obs_date is not null").select(
        "indicator_id", day("obs_date").alias("obs_day"), "value", key.alias("vintage")
    )
    end = scalar.vintage_end(F.col("vintage"))
    held = v.where(F.col("obs_day") <= end).groupBy("indicator_id", "vintage").agg(
        F.count("*").alias("rows_held"), F.count("value").alias("figures"), F.max("obs_day").alias("last_obs_day")
    )
    # One row for each indicator and quarter is left to look the vintages up in.
    keys = v.select("indicator_id", "vintage").distinct().withColumn("published", scalar.published(F.col("vintage")))
    asked = F.explode(F.filter(F.array(*[F.lit(x) for x in AS_OF]), lambda x: x >= F.col("published"))).alias("as_of")
    last = keys.select("indicator_id", "vintage", "published", asked).groupBy("as_of", "indicator_id").agg(
        F.max_by("vintage", "published").alias("vintage"), F.max("published").alias("published")
    )
    return last.join(held, ["indicator_id", "vintage"]).select("as_of", "indicator_id", "vintage", "published", "rows_held", "figures", "last_obs_day")


# Preparation


_CLEAN = """with r as (
  select indicator_id || '|' || area_code as id, obs_ts::date as day, value from series_readings where obs_ts is not null and indicator_id || area_code is not null
  qualify row_number() over (partition by indicator_id, area_code, obs_ts::date order by row_id desc) = 1),
q as (select id, quantile_cont(value, 0.25) as lo, quantile_cont(value, 0.75) as hi, count(value) as c from r group by id),
k as (select r.*, row_number() over (partition by id order by day) as n from r),
near as (select *, max(case when value is not null then {'n': n, 'v': value} end) over (partition by id order by day rows between unbounded preceding and current row) as a,
  min(case when value is not null then {'n': n, 'v': value} end) over (partition by id order by day rows between current row and unbounded following) as b from k),
f as (select near.id, day, case when value is not null then value when a.n is not null and b.n is not null and b.n - a.n - 1 <= 5
    then a.v + (b.v - a.v) * (n - a.n) / (b.n - a.n) end as value,
  coalesce(q.c >= 4 and hi > lo and (value < lo - 5 * (hi - lo) or value > hi + 5 * (hi - lo)), false) as is_outlier from near join q using (id) where q.c > 0),
w as (select id, min(day) as lo, max(day) as hi from f group by id),
g as (select id, unnest(generate_series(lo, hi, interval 1 day))::date as day from w),
p as (select g.id, g.day, f.value, f.is_outlier and f.day = g.day as is_outlier from g asof join f on g.id = f.id and g.day >= f.day where isodow(g.day) < 6)"""


def _prepared(spark, d) -> DataFrame:
    rows = table(spark, d, "series_readings").select(
        F.when(F.col("indicator_id").isNotNull() & F.col("area_code").isNotNull(), F.concat_ws("|", "indicator_id", "area_code")).alias("id"),
        day("obs_ts").alias("day"), "value", "row_id",
    )
    return series.prepared(rows, "row_id")


@query(f"{_CLEAN} select id, day, round(value, 6) as value, is_outlier from p")
def prepared_series(spark, d):
    """Each series deduplicated, flagged, filled and aligned to business days in one call."""
    return _prepared(spark, d).withColumn("value", F.round("value", 6))


def _z_sql(rows: int, least: int, sign: str = "-") -> str:
    z = f"case when count(value) over w >= {least} and stddev_samp(value) over w > 1e-12 then (value - avg(value) over w) / stddev_samp(value) over w end"
    return f"round(1 / (1 + exp({sign}({z}))), 6)"


def _over(rows: int) -> str:
    return f"window w as (partition by id order by {{}} rows between {rows - 1} preceding and current row)"


@query(f"""{_GRIDM} select id, month_end, {_z_sql(24, 24)} as score from padded {_over(24).format('month_end')}""")
def month_z24_score(spark, d):
    """Normalised score of a month end within the trailing 24 month ends of a gapless grid."""
    m = series.month_grid(_series(spark, d)).withColumnRenamed("month_end", "day")
    return m.select("id", F.col("day").alias("month_end"), F.round(scalar.sigmoid(series.trailing_z(F.col("value"), 24, 24)), 6).alias("score"))


@query(f"""{_GRIDM}, market as (select month_end, avg(value) as mean from m group by month_end),
gap as (select p.id, p.month_end, p.value / nullif(market.mean, 0) - 1 as value from padded p join market using (month_end)),
n as (select *, row_number() over (partition by id order by month_end) as k from gap where value is not null)
select id, month_end, case when k >= 61 then {_z_sql(60, 60, '')} end as score from n {_over(60).format('month_end')}""")
def month_gap_z60_score(spark, d):
    """Inverted score of a ticker's gap to the market within 60 month ends; it takes 61 months of history."""
    s = _series(spark, d)
    grid = series.month_grid(s)
    market = series.month_end_last(s).groupBy("month_end").agg(F.avg("value").alias("mean"))
    gap = grid.join(market, "month_end").select("id", F.col("month_end").alias("day"), (F.col("value") / F.nullif("mean", F.lit(0.0)) - 1).alias("value")).where("value is not null")
    k = F.row_number().over(Window.partitionBy("id").orderBy("day"))
    score = scalar.sigmoid(-series.trailing_z(F.col("value"), 60, 60))
    return gap.select("id", F.col("day").alias("month_end"), F.round(F.when(k >= 61, score), 6).alias("score"))


@query(f"""{_CLEAN}, s as (select * from p where value is not null) select id, day, {_z_sql(252, 60)} as score from s {_over(252).format('day')}""")
def aligned_z252_score(spark, d):
    """Score within the trailing 252 aligned days of a prepared series, from 60 on."""
    s = _prepared(spark, d).where("value is not null")
    return s.select("id", "day", F.round(scalar.sigmoid(series.trailing_z(F.col("value"), 252, 60)), 6).alias("score"))


_LATEST = """o as (select indicator_id || '|' || area_code as id, obs_date::date as day, arg_max_null(value, row_id) as value from vintage_panel
  where obs_date is not null and indicator_id || area_code is not null group by all),
s as (select * from o where value is not null)"""


def _observations(spark, d) -> DataFrame:
    rows = latest_view(spark, d).where("value is not null and indicator_id is not null and area_code is not null")
    return rows.select(F.concat_ws("|", "indicator_id", "area_code").alias("id"), F.col("obs_day").alias("day"), "value")


@query(f"""with {_LATEST} select id, day, round(sum(value) over w, 6) / count(*) over w as mean, count(*) over w as n from s
window w as (partition by id order by day range between interval 1826 days preceding and current row)""")
def trailing_5y_mean(spark, d):
    """Mean of an indicator's observations of the five years (1826 days) up to each."""
    w = Window.partitionBy("id").orderBy(F.unix_date("day")).rangeBetween(-1826, 0)
    return _observations(spark, d).select("id", "day", (F.round(F.sum("value").over(w), 6) / F.count("*").over(w)).alias("mean"), F.count("*").over(w).alias("n"))


@query(f"""with {_LATEST} select id, make_date(year(day), 12, 31) as year_end, arg_max(value, day) as value, round(median(value), 8) as middle, count(*) as n from s group by all""")
def year_end_last(spark, d):
    """Last figure and median of each year."""
    end = F.make_date(F.year("day"), F.lit(12), F.lit(31)).alias("year_end")
    return _observations(spark, d).groupBy("id", end).agg(
        F.max_by("value", "day").alias("value"), F.round(F.median("value"), 8).alias("middle"), F.count("*").alias("n")
    )


@query(f"""{_GRIDM}, x as (select id, month_end, (value / nullif(lag(value, 12) over (partition by id order by month_end), 0) - 1) * 100 as yoy from padded)
select id, extract(year from month_end)::int as year, round(median(yoy), 6) as middle, min(round(yoy, 6)) as least, max(round(yoy, 6)) as greatest from x where yoy is not null group by all""")
def yoy_by_year(spark, d):
    """Median and extremes of the yearly change, by year."""
    before = F.lag("value", 12).over(Window.partitionBy("id").orderBy("month_end"))
    x = series.month_grid(_series(spark, d)).select("id", "month_end", ((F.col("value") / F.nullif(before, F.lit(0.0)) - 1) * 100).alias("yoy")).where("yoy is not null")
    return x.groupBy("id", F.year("month_end").alias("year")).agg(
        F.round(F.median("yoy"), 6).alias("middle"), F.min(F.round("yoy", 6)).alias("least"), F.max(F.round("yoy", 6)).alias("greatest")
    )


# Joins of series


_THREE = f"""{_M}, market as (select month_end, avg(value) as mean, median(value) as middle from m group by month_end)"""


def _market(s: DataFrame) -> DataFrame:
    return series.month_end_last(s).groupBy("month_end").agg(F.avg("value").alias("mean"), F.median("value").alias("middle"))


@query(f"""{_THREE}, x as (select id, month_end, value / nullif(mean, 0) as ratio, value / nullif(middle, 0) as other from m join market using (month_end)),
y as (select indicator_id || '|' || area_code as id, last_day(obs_date::date) as month_end, arg_max(value, row_id) as figure from vintage_panel
  where value is not null and obs_date is not null and indicator_id || area_code is not null group by all),
z as (select month_end, avg(figure) as level from y group by all)
select x.id, x.month_end, round(ratio, 8) as ratio, round(other, 8) as other, round(level, 7) as level from x join z using (month_end)""")
def inner_three(spark, d):
    """Month ends that a ticker, the market and the indicators all have."""
    s = _series(spark, d)
    y = table(spark, d, "vintage_panel").where("value is not null and obs_date is not null and indicator_id is not null and area_code is not null").groupBy(
        "indicator_id", "area_code", F.last_day(day("obs_date")).alias("month_end")
    ).agg(F.max_by("value", "row_id").alias("figure")).groupBy("month_end").agg(F.avg("figure").alias("level"))
    x = series.month_end_last(s).join(_market(s), "month_end").join(y, "month_end")
    over = lambda c: F.round(F.col("value") / F.nullif(c, F.lit(0.0)), 8)
    return x.select("id", "month_end", over("mean").alias("ratio"), over("middle").alias("other"), F.round("level", 7).alias("level"))


@query(f"""{_THREE}, x as (select id, month_end, value / nullif(mean, 0) as ratio from m join market using (month_end)),
w as (select id, month_end, ratio, count(ratio) over t as n, avg(ratio) over t as mean from x
  window t as (partition by id order by month_end range between interval 1826 days preceding and current row))
select id, month_end, n, round(case when n >= 4 then mean end, 8) as usual, round(case when n >= 4 then ratio / nullif(mean, 0) - 1 end, 8) as above from w""")
def ratio_5y_mean(spark, d):
    """Ratio to the market against its own mean over five years of common month ends, from four on."""
    s = _series(spark, d)
    x = series.month_end_last(s).join(_market(s), "month_end").select("id", "month_end", (F.col("value") / F.nullif("mean", F.lit(0.0))).alias("ratio"))
    w = Window.partitionBy("id").orderBy(F.unix_date("month_end")).rangeBetween(-1826, 0)
    y = x.select("id", "month_end", "ratio", F.count("ratio").over(w).alias("n"), F.avg("ratio").over(w).alias("m"))
    enough = F.col("n") >= 4
    return y.select(
        "id", "month_end", "n", F.round(F.when(enough, F.col("m")), 8).alias("usual"),
        F.round(F.when(enough, F.col("ratio") / F.nullif("m", F.lit(0.0)) - 1), 8).alias("above"),
    )


@query(f"""{_M}, y as (select id, make_date(year(month_end), 12, 31) as year_end, arg_max(value, month_end) as v from m group by all),
t as (select year_end, avg(v) as v from y group by all),
a as (select id, year_end, v / nullif(lag(v) over (partition by id order by year_end), 0) - 1 as move, lag(year_end) over (partition by id order by year_end) as before from y),
b as (select year_end, v / nullif(lag(v) over (order by year_end), 0) - 1 as move, lag(year_end) over (order by year_end) as before from t)
select id, count(*) as years, round(median((a.move - b.move) * 100), 6) as median_diff, round(max(abs(a.move - b.move) * 100), 6) as greatest_diff
from a join b using (year_end) where a.move is not null and b.move is not null and year(a.before) + 1 = year(year_end) and year(b.before) + 1 = year(year_end) group by id""")
def cross_source_yoy(spark, d):
    """Yearly changes of each series against those of a second source, here the mean of all: median and greatest difference in points."""
    y = series.month_end_last(_series(spark, d)).groupBy("id", F.year("month_end").alias("year")).agg(F.max_by("value", "month_end").alias("v"))
    second = y.groupBy("year").agg(F.avg("v").alias("w"))
    both = y.join(second, "year")
    # The change needs the year before itself, looked up by its number.
    earlier = both.select("id", (F.col("year") + 1).alias("year"), F.col("v").alias("v0"), F.col("w").alias("w0"))
    diff = (F.col("v") / F.nullif("v0", F.lit(0.0)) - F.col("w") / F.nullif("w0", F.lit(0.0))) * 100
    return both.join(earlier, ["id", "year"]).select("id", diff.alias("diff")).where("diff is not null").groupBy("id").agg(
        F.count("*").alias("years"), F.round(F.median("diff"), 6).alias("median_diff"), F.round(F.max(F.abs("diff")), 6).alias("greatest_diff")
    )


# Turning points


@query(f"""with {_POINTS} select p.kind, p.month, p.announced, q.announced as other
from (select distinct date_trunc('month', obs_date)::date as asked from vintage_panel) a join points p on p.month = a.asked
left join points q on q.month = a.asked and q.kind <> p.kind""")
def announcement_lookup(spark, d):
    """Announcement of the turning point of exactly an observed month."""
    asked = table(spark, d, "vintage_panel").select(F.trunc(day("obs_date"), "month").alias("month")).distinct()
    kinds = asked.select("month", F.explode(F.array(F.lit("peak"), F.lit("trough"))).alias("kind"))
    told = kinds.select("kind", "month", regime.announcement_of(F.col("month"), F.col("kind")).alias("announced")).where("announced is not null")
    other = F.when(F.col("kind") == "peak", "trough").otherwise("peak")
    return told.withColumn("other", regime.announcement_of(F.col("month"), other))


_LABEL = """case when x.i % 3 = 0 then null else (x.i % 5 = 0)::int end"""


@query(f"""with {_POINTS}, o as (select l_orderkey, l_linenumber, l_partkey as i, date '1974-01-01' + (l_partkey * 7 % 18000)::int as query_day,
  case l_linenumber % 3 when 0 then null else date '1981-01-01' + (l_suppkey * 41 % 14000)::int end as as_of, l_linenumber % 2 = 0 as real_time from lineitem),
x as (select *, case when i % 4 = 0 then null else date '2015-06-01' end as label_until from o),
k as (select x.*, {_LABEL} as label, (select max({{'m': p.month, 'k': p.kind}}) from points p where p.announced <= x.as_of and p.month <= date_trunc('month', x.query_day)) as p,
  (select count(*) from points p where p.announced <= x.as_of) as told from x),
s as (select *, case when p.m = date_trunc('month', query_day) then case p.k when 'peak' then 'expansion' else 'recession' end
  when p.k = 'peak' then 'recession' when p.k = 'trough' then 'expansion' end as known, query_day < date '{regime.BOUNDARY}' as early from k),
r as (select *, case when as_of is not null and early and real_time then 'training only'
  when (as_of is null or early) and (label_until is null or query_day > label_until) then 'past the last label'
  when (as_of is null or early) and label is null then 'no label'
  when not (as_of is null or early) and told = 0 then 'nothing announced' when not (as_of is null or early) and known is null then 'before the first known point' end as refused from s)
select l_orderkey, l_linenumber, i as part, refused, case when refused is null then case when as_of is null or early then case label when 1 then 'recession' else 'expansion' end else known end end as state,
  case when refused is null then case when early and as_of is not null then 'label, training only' when as_of is null then 'label' else 'calendar' end end as source from r""")
def state_policies(spark, d):
    """State of a month under the latest, the training and the announced policy; the asked months come from lineitem's numbers."""
    l = table(spark, d, "lineitem")  # noqa: E741
    i = F.col("l_partkey")
    base = lambda text, n: F.date_add(F.lit(text).cast("date"), n.cast("int"))
    query_day = base("1974-01-01", i * 7 % 18000)
    as_of = F.when(F.col("l_linenumber") % 3 != 0, base("1981-01-01", F.col("l_suppkey") * 41 % 14000))
    until = F.when(i % 4 != 0, F.lit("2015-06-01").cast("date"))
    label = F.when(i % 3 != 0, (i % 5 == 0).cast("int"))
    asked = l.select("l_orderkey", "l_linenumber", i.alias("part"), query_day.alias("q"), as_of.alias("a"), (F.col("l_linenumber") % 2 == 0).alias("real"), label.alias("label"), until.alias("until"))
    found = regime.state_by_policy(F.col("q"), F.col("a"), F.col("real"), F.col("label"), F.col("until"))
    return asked.select("l_orderkey", "l_linenumber", "part", found.alias("s")).select("l_orderkey", "l_linenumber", "part", "s.refused", "s.state", "s.source")


@query("""with x as (select indicator_id, area_code, obs_ts::date as day, bool_or(coalesce(outlier_flag, false)) as label from series_readings where obs_ts is not null group by all),
y as (select *, lag(label) over (partition by indicator_id, area_code order by day) as before from x)
select indicator_id, area_code, count(*) as days, count(*) filter (label) as labelled, count(*) filter (label and not before) as onsets from y group by all""")
def label_transitions(spark, d):
    """How often a label goes from off to on in each series."""
    x = table(spark, d, "series_readings").where("obs_ts is not null").groupBy("indicator_id", "area_code", day("obs_ts").alias("day")).agg(
        F.bool_or(F.coalesce("outlier_flag", F.lit(False))).alias("label")
    )
    before = F.lag("label").over(Window.partitionBy("indicator_id", "area_code").orderBy("day"))
    return x.withColumn("onset", F.col("label") & ~before).groupBy("indicator_id", "area_code").agg(
        F.count("*").alias("days"), F.count_if("label").alias("labelled"), F.count_if(F.coalesce("onset", F.lit(False))).alias("onsets")
    )


@query(f"""with {_POINTS}, falls as (select month as peak, lead(month) over (order by month) as trough, kind from points)
select row_id, (exists (select 1 from falls where kind = 'peak' and date_trunc('month', obs_date) > peak and date_trunc('month', obs_date) <= trough))::int as label from vintage_panel""")
def labels_on_observations(spark, d):
    """Every observation with the label of its month from a table of labelled months, absent ones 0."""
    labels = regime.recession_months(spark)
    p = table(spark, d, "vintage_panel").select("row_id", F.trunc(day("obs_date"), "month").alias("month"))
    return p.join(labels, "month", "left").select("row_id", F.coalesce("label", F.lit(0)).alias("label"))


# Regressions and signals

#: Months of the horizons of the panel.
HORIZONS = (12, 36, 60, 120)
_CELLS = f"""{_M}, market as (select month_end, avg(value) as market_mean, median(value) as market_median from m group by month_end),
targets as (unpivot market on market_mean, market_median into name target value level),
h(months) as (values {', '.join(f'({h})' for h in HORIZONS)}),
last as (select max(day) as day from s),
a as (select t.*, h.months, (t.month_end + to_months(h.months))::date as later from targets t, h, last where (t.month_end + to_months(h.months))::date <= last.day),
fwd as (select a.target, a.months, a.month_end, b.level / a.level - 1 as y from a asof join targets b on a.target = b.target and a.later >= b.month_end where a.level <> 0),
o as (select indicator_id, area_code, obs_date::date as obs_day, arg_max_null(value, row_id) as value from vintage_panel where obs_date is not null group by all),
f as (select * from o where value is not null),
asked as (select i.*, t.month_end from (select distinct indicator_id, area_code from o) i, (select distinct month_end from targets) t),
x as (select a.indicator_id, a.area_code, a.month_end, f.value as x from asked a asof join f
  on a.indicator_id = f.indicator_id and a.area_code = f.area_code and a.month_end >= f.obs_day),
pairs as (select indicator_id, area_code, target, months, month_end, x, y from x join fwd using (month_end)),
cells as (select i.indicator_id, i.area_code, t.target, h.months from (select distinct indicator_id, area_code from o) i, (select distinct target from targets) t, h),
fit as (select indicator_id, area_code, target, months, count(*) as n, regr_slope(y, x) as slope, regr_intercept(y, x) as intercept, regr_r2(y, x) as r2, avg(x) as mx, regr_sxx(y, x) as sxx
  from pairs group by all),
u as (select p.indicator_id, p.area_code, p.target, p.months, list(y - intercept - slope * x order by month_end) as u, list((x - mx) / sxx order by month_end) as d
  from pairs p join fit using (indicator_id, area_code, target, months) where n >= 3 and sxx > 0 group by all),
z as (select *, list_transform(list_zip(u, d), lambda p: p[1] * p[2]) as z from u),
e as (select *, sqrt(greatest(0, list_sum(list_transform(z, lambda v: v * v)) + coalesce(list_sum(list_transform(range(1, least(months, len(z))),
  lambda k: 2 * (1 - k / months) * list_dot_product(z[k + 1:], z[:len(z) - k]))), 0))) as slope_se from z)"""


@query(f"""{_CELLS}, c as (select c.*, coalesce(fit.n, 0) as n_nominal, fit.r2, fit.slope, fit.n, fit.sxx, e.slope_se from cells c
  left join fit using (indicator_id, area_code, target, months) left join e using (indicator_id, area_code, target, months)),
t as (select *, case when slope_se > 0 then 1 / (1 + 0.5 * abs(slope / slope_se) / sqrt(2)) end as t from c)
select indicator_id, area_code, target, months, n_nominal, (n_nominal // months)::int as n_effective,
  case when n_nominal < 2 then 'NO_OVERLAP' when n_nominal // months < 5 then 'UNDERPOWERED' else 'FULL' end as verdict,
  case when n_nominal < 2 then 'no overlap' when n_nominal < 3 then 'too few pairs' when not sxx > 0 then 'constant indicator' else 'fitted' end as reason,
  round(case when slope_se is not null then r2 end, 5) as r2, round(case when slope_se is not null then 1 - (1 - r2) * (n - 1) / (n - 2) end, 5) as adj_r2,
  round(case when slope_se is not null then {_TAIL} end, 5) as p_slope
from t""")
def r2_cells(spark, d):
    """Every indicator and area against both market targets at all horizons: fit, verdict, and why a cell has none."""
    s = _series(spark, d)
    market = series.month_end_last(s).groupBy("month_end").agg(F.avg("value").alias("market_mean"), F.median("value").alias("market_median"))
    targets = market.unpivot("month_end", ["market_mean", "market_median"], "target", "level")
    last_day = s.agg(F.max("day")).scalar()
    months = F.explode(F.array(*[F.lit(h) for h in HORIZONS])).alias("months")
    asked = targets.select("*", months).withColumn("later", F.expr("cast(add_months(month_end, months) as date)")).where(F.col("later") <= last_day)
    ends = targets.select("target", F.col("month_end").alias("end_of"), F.col("level").alias("at_end"))
    y = series.asof_join(asked, ends, ["target"], "later", "end_of", ["at_end"]).where("level <> 0").select(
        "target", "months", "month_end", (F.col("at_end") / F.col("level") - 1).alias("y")
    )
    latest = latest_view(spark, d)
    ids = latest.select("indicator_id", "area_code").distinct()
    # One value, bounded by the calendar.
    ends_of_market = market.agg(F.collect_set("month_end")).scalar()
    days = ids.select("indicator_id", "area_code", F.explode(ends_of_market).alias("month_end"))
    held = latest.where("value is not null").select("indicator_id", "area_code", "obs_day", "value")
    x = series.asof_join(days, held, ["indicator_id", "area_code"], "month_end", "obs_day", ["value"]).where("value is not null")
    keys = ["indicator_id", "area_code", "target"]
    pairs = x.join(y, "month_end").select(*keys, "months", (F.col("months") - 1).alias("lags"), F.col("month_end").alias("position"), F.col("value").alias("x"), "y")
    counted = pairs.groupBy(*keys, "months").agg(F.count("*").alias("n_nominal"), F.regr_sxx("y", "x").alias("sxx"))
    fitted = series.hac_by_lags(pairs, [*keys, "months"], "lags").drop("lags", "n")
    cells = ids.select("*", F.explode(F.array(F.lit("market_mean"), F.lit("market_median"))).alias("target")).select("*", months)
    rows = cells.join(counted, [*keys, "months"], "left").join(fitted, [*keys, "months"], "left").withColumn("n_nominal", F.coalesce("n_nominal", F.lit(0)))
    n = F.col("n_nominal")
    verdict = F.when(n < 2, "NO_OVERLAP").when(F.floor(n / F.col("months")) < 5, "UNDERPOWERED").otherwise("FULL")
    reason = F.when(n < 2, "no overlap").when(n < 3, "too few pairs").when(F.col("slope").isNull(), "constant indicator").otherwise("fitted")
    return rows.select(
        *keys, "months", "n_nominal", F.floor(n / F.col("months")).cast("int").alias("n_effective"), verdict.alias("verdict"), reason.alias("reason"),
        *[F.round(c, 5).alias(c) for c in ("r2", "adj_r2", "p_slope")],
    )


_COUNTS = """x as (select indicator_id, outlier_flag as signal, coalesce(value > expected_max or value < expected_min, false) as label
  from series_readings join indicator_meta using (indicator_id) where value is not null and outlier_flag is not null),
c as (select indicator_id, count(*) filter (signal and label) as tp, count(*) filter (signal and not label) as fp,
  count(*) filter (not signal and label) as fn, count(*) filter (not signal and not label) as tn from x group by all)"""


def _counts(spark, d) -> DataFrame:
    limits = table(spark, d, "indicator_meta").select("indicator_id", "expected_min", "expected_max")
    x = table(spark, d, "series_readings").where("value is not null and outlier_flag is not null").join(limits, "indicator_id")
    label = F.coalesce((F.col("value") > F.col("expected_max")) | (F.col("value") < F.col("expected_min")), F.lit(False))
    signal = F.col("outlier_flag")
    return x.groupBy("indicator_id").agg(
        F.count_if(signal & label).alias("tp"), F.count_if(signal & ~label).alias("fp"),
        F.count_if(~signal & label).alias("fn"), F.count_if(~signal & ~label).alias("tn"),
    )


@query(f"""with {_COUNTS}, s as (select *, tp / nullif(tp + fn, 0)::double as sens, tn / nullif(fp + tn, 0)::double as spec from c)
select indicator_id, tp, fp, fn, tn, round(sens / nullif(1 - spec, 0), 6) as lr_positive, round((1 - sens) / nullif(spec, 0), 6) as lr_negative,
  round(least(1, sqrt((tp + fn) / 30.0::double)), 8) as adequacy from s""")
def likelihood_ratios(spark, d):
    """What a signal and its absence say about the label, and whether the events suffice."""
    share = lambda a, b: F.try_divide(F.col(a).cast("double"), (F.col(a) + F.col(b)).cast("double"))
    s = _counts(spark, d).withColumns({"sens": share("tp", "fn"), "spec": share("tn", "fp")})
    return s.select(
        "indicator_id", "tp", "fp", "fn", "tn", F.round(F.try_divide("sens", 1 - F.col("spec")), 6).alias("lr_positive"),
        F.round(F.try_divide(1 - F.col("sens"), F.col("spec")), 6).alias("lr_negative"), F.round(scalar.sample_adequacy(F.col("tp") + F.col("fn"), 30), 8).alias("adequacy"),
    )


# Share below x under a beta posterior of whole parameters: at least a of a + b - 1 trials of probability x succeed.
_BELOW = """list_sum(list_transform(range(a, a + b), lambda j: exp(lgamma(a + b) - lgamma(j + 1) - lgamma(a + b - j) + j * ln(m) + (a + b - 1 - j) * ln(1 - m))))"""


@query(f"""with recursive {_COUNTS}, p as (select indicator_id, tp + 1 as a, fn + 1 as b from c),
q as (select p.*, t.tail, 0.0::double as lo, 1.0::double as hi, 0 as step from p, (values (0.025), (0.975)) t(tail)),
r as (select * from q union all select indicator_id, a, b, tail, case when s < tail then m else lo end, case when s < tail then hi else m end, step + 1
  from (select *, {_BELOW} as s from (select *, (lo + hi) / 2 as m from r where step < 40)))
select indicator_id, a, b, round(min(case when tail < 0.5 then (lo + hi) / 2 end), 6) as low, round(min(case when tail > 0.5 then (lo + hi) / 2 end), 6) as high
from r where step = 40 group by all""")
def beta_intervals(spark, d):
    """95 % posterior interval of the sensitivity under a flat prior."""
    c = _counts(spark, d).withColumns({"a": F.col("tp") + 1, "b": F.col("fn") + 1})
    i = intervals.beta_interval(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("indicator_id", "a", "b", i.alias("i")).select("indicator_id", "a", "b", F.round("i.low", 6).alias("low"), F.round("i.high", 6).alias("high"))


@query()
def ratio_posterior(spark, d):
    """Median and 95 % range of the likelihood ratio, drawn from the posteriors of both shares."""
    i = intervals.ratio_interval(F.col("tp"), F.col("tp") + F.col("fn"), F.col("fp"), F.col("fp") + F.col("tn"))
    return _counts(spark, d).select("indicator_id", i.alias("i")).select("indicator_id", "i.median", "i.low", "i.high")


# Sets, extents and units


@query("""select indicator_id, count(*) as in_both, min(area_code) as first_area
from (select indicator_id, area_code from vintage_panel intersect select indicator_id, area_code from asof_requests) group by all""")
def set_intersection(spark, d):
    """Series that are both held and asked for, by indicator."""
    ids = lambda t: table(spark, d, t).select("indicator_id", "area_code")
    return ids("vintage_panel").intersect(ids("asof_requests")).groupBy("indicator_id").agg(F.count("*").alias("in_both"), F.min("area_code").alias("first_area"))


@query("""select indicator_id, count(distinct realtime_start::date) as vintages, count(distinct obs_date::date) as observations, count(distinct area_code) as areas,
  min(realtime_start::date) as first_vintage, max(realtime_start::date) as last_vintage, min(obs_date::date) as first_obs, max(obs_date::date) as last_obs, count(*) as rows_held
from vintage_panel group by all""")
def panel_extents(spark, d):
    """Distinct counts and extents of the panel, by indicator; counted in two steps, so that no task holds a set."""
    p = table(spark, d, "vintage_panel").select("indicator_id", "area_code", day("realtime_start").alias("v"), day("obs_date").alias("o"))
    extents = p.groupBy("indicator_id").agg(
        F.min("v").alias("first_vintage"), F.max("v").alias("last_vintage"), F.min("o").alias("first_obs"), F.max("o").alias("last_obs"), F.count("*").alias("rows_held"),
    )
    out = extents
    for c, name in (("v", "vintages"), ("o", "observations"), ("area_code", "areas")):
        n = p.groupBy("indicator_id", c).agg(F.lit(1).alias("one")).groupBy("indicator_id").agg(F.count(c).alias(name))
        out = out.join(n, "indicator_id")
    return out


@query("""with u(unit, factor) as (values ('USD', 1e-9), ('K_USD', 1e-6), ('M_USD', 1e-3), ('B_USD', 1.0), ('T_USD', 1e3))
select p.row_id, round(p.value * u.factor::double, 6) as b_usd from vintage_panel p join indicator_meta m using (indicator_id) join u using (unit)""")
def in_billions(spark, d):
    """Money in billions; a unit that is no money would raise, so only money is asked for."""
    meta = table(spark, d, "indicator_meta").select("indicator_id", "unit").where(F.col("unit").isin(list(scalar.UNIT_FACTORS["money"])))
    rows = table(spark, d, "vintage_panel").join(meta, "indicator_id")
    return rows.select("row_id", F.round(scalar.in_unit(F.col("value"), F.col("unit"), "B_USD"), 6).alias("b_usd"))


@query("""select unit, count(*) as indicators, count(distinct source) as sources, bool_and(coalesce(expected_min, -1e308) <= coalesce(expected_max, 1e308)) as in_order,
  round(min(coalesce(nullif(release_lag_days, 0) / 10.0, 1))::double, 4) as least_cap from indicator_meta group by unit""")
def unit_groups(spark, d):
    """Indicators by unit, with the least of a group's caps, 1 where there is none."""
    cap = scalar.lowest_cap((F.nullif("release_lag_days", F.lit(0)) / 10.0).cast("double"))
    ordered = F.coalesce("expected_min", F.lit(-1e308)) <= F.coalesce("expected_max", F.lit(1e308))
    return table(spark, d, "indicator_meta").groupBy("unit").agg(
        F.count("*").alias("indicators"), F.count_distinct("source").alias("sources"), F.bool_and(ordered).alias("in_order"), F.round(F.min(cap), 4).alias("least_cap")
    )


@query(f"""{_M}, w as (select id, month_end, value, lead(value, 6) over (partition by id order by month_end) as later from m)
select id, month_end, round(case when later / value > 0 then pow(later / value, 2.0) - 1 end, 8) as yearly from w where later is not null and value <> 0""")
def annualised_half_years(spark, d):
    """Yearly rate of the return over the six month ends that follow."""
    m = series.month_end_last(_series(spark, d))
    later = F.lead("value", 6).over(Window.partitionBy("id").orderBy("month_end"))
    w = m.withColumn("later", later).where("later is not null and value <> 0")
    return w.select("id", "month_end", F.round(scalar.annualised(F.col("later") / F.col("value") - 1, 6), 8).alias("yearly"))


@query(f"""{_GRIDM}, y as (select id, month_end, (value / nullif(lag(value, 12) over (partition by id order by month_end), 0) - 1) * 100 as yoy from padded),
market as (select month_end, avg(yoy) as yoy from y where yoy is not null group by month_end)
select y.id, arg_max(y.month_end, y.month_end) as month_end, round(arg_max(y.yoy - market.yoy, y.month_end), 6) as real_change, round(median(y.yoy - market.yoy), 6) as usual
from y join market using (month_end) where y.yoy is not null group by y.id""")
def real_change(spark, d):
    """Last yearly change of each series less that of all, as a rate less inflation, and its long-term median."""
    before = F.lag("value", 12).over(Window.partitionBy("id").orderBy("month_end"))
    y = series.month_grid(_series(spark, d)).select("id", "month_end", ((F.col("value") / F.nullif(before, F.lit(0.0)) - 1) * 100).alias("yoy")).where("yoy is not null")
    market = y.groupBy("month_end").agg(F.avg("yoy").alias("all"))
    real = y.join(market, "month_end").select("id", "month_end", (F.col("yoy") - F.col("all")).alias("r"))
    return real.groupBy("id").agg(
        F.max("month_end").alias("month_end"), F.round(F.max_by("r", "month_end"), 6).alias("real_change"), F.round(F.median("r"), 6).alias("usual")
    )


@query("""with n as (select indicator_id, area_code, note, min(rec_id) as first_rec from source_records where note is not null group by all)
select indicator_id, area_code, list(note order by first_rec) as notes, count(*) as different from n group by all""")
def notes_in_order(spark, d):
    """Different notes of each series in order of their first record; repeats go before the lists are made."""
    n = table(spark, d, "source_records").where("note is not null").groupBy("indicator_id", "area_code", "note").agg(F.min("rec_id").alias("at"))
    held = F.transform(F.array_sort(F.collect_list(F.struct("at", "note"))), lambda x: x["note"])
    return n.groupBy("indicator_id", "area_code").agg(held.alias("notes"), F.count("*").alias("different"))


@query("""select indicator_id, unnest(['unit', 'source', 'first', 'lag', 'suspect']) as entry,
  unnest([unit, source, strftime(first_obs, '%Y-%m-%d'), release_lag_days::varchar, len(data_quality_suspect_periods)::varchar]) as value from indicator_meta""")
def metadata_entries(spark, d):
    """Metadata as one map to an indicator, merged from two, and flattened to entries."""
    m = table(spark, d, "indicator_meta")
    named = F.create_map(F.lit("unit"), F.col("unit"), F.lit("source"), F.col("source"), F.lit("first"), F.date_format("first_obs", "yyyy-MM-dd"))
    counted = F.create_map(F.lit("lag"), F.col("release_lag_days").cast("string"), F.lit("suspect"), F.when(F.col("data_quality_suspect_periods").isNotNull(), F.size("data_quality_suspect_periods").cast("string")))
    return m.select("indicator_id", F.explode(F.map_concat(named, counted)).alias("entry", "value"))


@query(f"""select row_id, (strftime(obs_date, '%Y-%m') || '-01')::date as month, obs_date::date >= date '{regime.BOUNDARY}' as dated,
  row_number() over (partition by indicator_id order by area_code nulls first, obs_date nulls first, row_id) as place,
  case when realtime_start is not null then dense_rank() over (partition by indicator_id order by year(realtime_start), quarter(realtime_start)) end as vintage_rank from vintage_panel""")
def stable_order(spark, d):
    """Each row's month, its place in a full order of its indicator's rows, and the rank of its quarter's vintage."""
    p = table(spark, d, "vintage_panel")
    order = Window.partitionBy("indicator_id").orderBy("area_code", "obs_date", "row_id")
    by_quarter = Window.partitionBy("indicator_id").orderBy(F.asc_nulls_last(F.year("realtime_start")), F.asc_nulls_last(F.quarter("realtime_start")))
    return p.select(
        "row_id", F.to_date(F.concat(F.date_format("obs_date", "yyyy-MM"), F.lit("-01"))).alias("month"), (day("obs_date") >= F.lit(regime.BOUNDARY).cast("date")).alias("dated"),
        F.row_number().over(order).alias("place"), F.when(F.col("realtime_start").isNotNull(), F.dense_rank().over(by_quarter)).alias("vintage_rank"),
    )


@query("""with u as (select s.indicator_id, s.area_code, count(distinct m.unit) as units, count(*) as n from series_readings s join indicator_meta m using (indicator_id) group by all)
select m.unit, count(*) as series, sum(u.n)::bigint as readings, bool_and(u.units <= 1) as one_unit from u join indicator_meta m using (indicator_id) group by m.unit""")
def unit_agreement(spark, d):
    """Series and readings by unit, and whether each series has one unit only."""
    m = table(spark, d, "indicator_meta").select("indicator_id", "unit")
    u = table(spark, d, "series_readings").join(m, "indicator_id").groupBy("indicator_id", "area_code").agg(F.count_distinct("unit").alias("units"), F.count("*").alias("n"))
    return u.join(m, "indicator_id").groupBy("unit").agg(F.count("*").alias("series"), F.sum("n").alias("readings"), F.bool_and(F.col("units") <= 1).alias("one_unit"))


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(SQL)
