from datetime import date as D
from datetime import datetime as T

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import scalar
from tidegauge.operators import access, intervals, regime, series


@pytest.fixture(scope="module")
def tables(spark):
    rows = [
        (1, "rev", "x", T(2020, 1, 31), 1.0, T(2020, 2, 10)), (2, "rev", "x", T(2020, 1, 31), None, T(2020, 3, 10)), (3, "rev", "x", T(2020, 1, 31), 3.0, T(2020, 3, 10)),
        (4, "lag", "x", T(2020, 1, 31), 4.0, None), (5, "now", "x", T(2020, 1, 31), 5.0, None), (6, "bad", "x", T(2020, 1, 31), 6.0, None), (7, "rev", "x", None, 7.0, T(2020, 2, 1)),
    ]
    panel = spark.createDataFrame(rows, "row_id long, indicator_id string, area_code string, obs_date timestamp_ntz, value double, realtime_start timestamp_ntz")
    meta = spark.createDataFrame([("rev", True, 30), ("lag", False, 20), ("now", False, 0), ("bad", True, 5), ("none", False, None)], "indicator_id string, needs_vintage boolean, release_lag_days int")
    return panel, meta


def test_views_as_of_a_day(tables):
    panel, meta = tables
    got = {(r.as_of, r.indicator_id): (r.value, r.row_id, r.basis) for r in access.known_at(panel, meta, [D(2020, 1, 31), D(2020, 2, 20), D(2020, 3, 10)]).collect()}
    assert got == {
        (D(2020, 1, 31), "now"): (5.0, 5, "truncation"), (D(2020, 2, 20), "now"): (5.0, 5, "truncation"), (D(2020, 3, 10), "now"): (5.0, 5, "truncation"),
        (D(2020, 2, 20), "lag"): (4.0, 4, "release lag"), (D(2020, 3, 10), "lag"): (4.0, 4, "release lag"),
        (D(2020, 2, 20), "rev"): (1.0, 1, "vintage panel"), (D(2020, 3, 10), "rev"): (3.0, 3, "vintage panel"),
    }
    assert access.load(panel, meta, "rev", D(2020, 2, 9)).count() == 0 and access.load(panel, meta, "rev", D(2020, 2, 10)).first().value == 1.0
    latest = access.load(panel, meta, "rev").first()
    assert (latest.value, latest.basis) == (3.0, "latest") and access.load(panel, meta, "bad").first().value == 6.0


def test_refusals(tables):
    panel, meta = tables
    with pytest.raises(access.VintagesMissing):
        access.load(panel, meta, "bad", D(2020, 3, 1))
    with pytest.raises(access.UnknownIndicator):
        access.load(panel, meta, "nowhere")
    with pytest.raises(ValueError):
        access.Context(panel, meta, None)
    assert access.Context(panel, meta, D(2020, 3, 1)).load("lag").count() == 1
    assert access.load(panel.limit(0), meta, "none", D(2020, 3, 1)).count() == 0


def test_whole_vintage(spark):
    rows = [("2019Q4", D(2019, 12, 1), 1.0), ("2020Q1", D(2019, 12, 1), 2.0), ("2020Q1", D(2020, 3, 31), 3.0), ("2020Q1", D(2020, 4, 1), 9.0), ("x", D(2020, 1, 1), 9.0)]
    v = spark.createDataFrame(rows, "vintage string, obs_day date, value double")
    at = lambda d: sorted(r.value for r in access.whole_vintage(v, F.lit(d).cast("date")).collect())
    assert at("2020-01-13") == [] and at("2020-01-14") == [1.0] and at("2020-04-13") == [1.0] and at("2020-04-14") == [2.0, 3.0]


def test_preparation_refuses_and_passes(spark):
    shape = "id string, day date, value double, n int, processed boolean"
    rows = [("a", D(2024, 1, 1), 1.0, 1, False), ("a", D(2024, 1, 1), 2.0, 2, None), ("a", D(2024, 1, 4), 5.0, 3, False), ("b", D(2024, 1, 6), 7.0, 4, True), ("c", D(2024, 1, 1), None, 5, False)]
    s = spark.createDataFrame(rows, shape)
    got = sorted((r.id, r.day.day, r.value, r.is_outlier) for r in series.prepared(s, "n", until=D(2024, 1, 8)).collect())
    assert got == [("a", 1, 2.0, False), ("a", 2, 2.0, False), ("a", 3, 2.0, False), ("a", 4, 5.0, False), ("a", 5, 5.0, False), ("a", 8, 5.0, False), ("b", 6, 7.0, False)]
    limits = spark.createDataFrame([("a", 0.0, 4.0)], "id string, low double, high double")
    with pytest.raises(series.SeriesRefused, match="a: out of range.*c: only nulls|c: only nulls.*a: out of range"):
        series.prepared(s, "n", limits, strict=True)
    assert series.prepared(s.limit(0), "n").count() == 0


def test_units_raise(spark):
    one = lambda v, u: spark.range(1).select(scalar.in_unit(F.lit(v).cast("double"), F.lit(u).cast("string"), "M_USD").alias("x")).first().x
    assert one(2.0, "B_USD") == 2000.0 and one(None, "pct") is None
    for unit in ("pct", None):
        with pytest.raises(Exception, match="can't convert"):
            one(1.0, unit)
    with pytest.raises(ValueError):
        scalar.in_unit(F.lit(1.0), F.lit("USD"), "miles")


def test_same_unit(spark):
    meta = spark.createDataFrame([("a", "pct"), ("b", "pct"), ("c", "USD")], "indicator_id string, unit string")
    assert access.assert_same_unit(meta, ["a", "b"]) == "pct" and access.assert_same_unit(meta, []) is None
    with pytest.raises(access.UnitsDiffer):
        access.assert_same_unit(meta, ["a", "c"])


def test_long_lags_equal_the_plain_regression(spark):
    rng = np.random.default_rng(4)
    rows = [(g, i, float(a), float(b), 40) for g in "gh" for i, (a, b) in enumerate(rng.normal(size=(70, 2)))] + [("k", 0, 1.0, 1.0, 40), ("k", 1, 1.0, 2.0, 40), ("k", 2, 1.0, 3.0, 40)]
    pairs = spark.createDataFrame(rows, "g string, position int, x double, y double, lags int")
    a = {r.g: r for r in series.hac_by_lags(pairs, ["g"], "lags").collect()}
    b = {r.g: r for r in series.hac_regression(pairs, ["g"], 40).collect()}
    assert a.keys() == b.keys() == {"g", "h"}
    for g in a:
        assert all(abs(a[g][c] - b[g][c]) < 1e-9 for c in ("slope", "r2", "adj_r2", "slope_se", "intercept_se", "p_slope", "p_intercept", "resid_se"))
    with pytest.raises(Exception, match="more than 5"):
        series.hac_by_lags(pairs, ["g"], "lags", longest=5).collect()


def test_tails_and_beta_quantiles(spark):
    from math import erfc

    z = [0.0, 0.5, -1.96, 3.0, 6.0]
    got = [r.p for r in spark.createDataFrame([(v,) for v in z], "z double").select(scalar.normal_tail(F.col("z")).alias("p")).collect()]
    assert all(abs(p - erfc(abs(v) / 2**0.5)) <= 2e-7 * erfc(abs(v) / 2**0.5) for p, v in zip(got, z))
    x = np.linspace(0, 1, 200_001)
    for a, b in ((1.0, 1.0), (3.0, 1.0), (9.0, 14.0), (200.0, 35.0)):
        density = x ** (a - 1) * (1 - x) ** (b - 1)
        total = np.concatenate([[0], np.cumsum((density[1:] + density[:-1]) / 2)])
        for q in (0.025, 0.5, 0.975):
            assert abs(float(intervals.beta_quantile(q, a, b)) - np.interp(q, total / total[-1], x)) < 1e-4
    t = spark.createDataFrame([(3, 10), (0, 0), (None, 4)], "k int, n int").select(intervals.beta_interval(F.col("k"), F.col("n")).alias("i")).collect()
    assert abs(t[0].i.low - 0.1093) < 1e-3 and abs(t[1].i.high - 0.975) < 1e-9 and t[2].i.low is None


def test_policies(spark):
    rows = [(D(1975, 3, 1), D(2000, 1, 1), True, 1, D(2010, 1, 1)), (D(1975, 3, 1), D(2000, 1, 1), False, 1, D(2010, 1, 1)), (D(2008, 9, 1), D(2008, 11, 30), True, None, None),
            (D(2008, 9, 1), D(2009, 1, 1), True, None, None), (D(2012, 1, 1), None, True, 0, D(2010, 1, 1)), (D(2009, 1, 1), None, True, 0, D(2010, 1, 1)), (D(1979, 1, 1), D(1979, 6, 1), True, None, None),
            (D(1979, 1, 1), D(1990, 6, 1), True, None, None), (D(1975, 1, 1), D(2000, 1, 1), False, None, D(2010, 1, 1))]
    f = spark.createDataFrame(rows, "q date, a date, r boolean, l int, u date")
    got = [tuple(x.s) for x in f.select(regime.state_by_policy(*[F.col(c) for c in "qarlu"]).alias("s")).collect()]
    assert got == [
        (None, None, "training only"), ("recession", "label, training only", None), ("expansion", "calendar", None), ("recession", "calendar", None),
        (None, None, "past the last label"), ("expansion", "label", None), (None, None, "nothing announced"), (None, None, "before the first known point"), (None, None, "no label"),
    ]
    told = spark.range(1).select(regime.announcement_of(F.lit("2007-12-14").cast("date"), F.lit("peak")).alias("a"), regime.announcement_of(F.lit("2007-12-14").cast("date"), F.lit("trough")).alias("b")).first()
    assert told.a == D(2008, 12, 1) and told.b is None


def test_states_are_ranked_by_labels(spark):
    d = spark.createDataFrame([("k", 1, 0), ("k", 2, 0), ("k", 3, 1), ("k", 4, 2)], "k string, day int, state int")
    labels = spark.createDataFrame([("k", 1, 0), ("k", 2, 1), ("k", 3, 1)], "k string, day int, label int")
    assert [(r.state, r.rank) for r in regime.ranked_states(d, labels, "k", "day").orderBy("rank").collect()] == [(1, 1), (0, 2), (2, 3)]
