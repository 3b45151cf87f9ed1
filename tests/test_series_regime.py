from datetime import date as D
from datetime import timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidegauge.functions import scalar
from tidegauge.operators import audit, regime, series


def frame(spark, rows):
    return spark.createDataFrame(rows, "id string, day date, value double")


def test_null_reading_holds_until_the_next(spark):
    s = frame(spark, [("a", D(2024, 1, 1), 1.0), ("a", D(2024, 1, 3), None), ("a", D(2024, 1, 8), 3.0), ("a", D(2024, 1, 10), 3.0)])
    got = [r.value for r in series.forward_fill(s).orderBy("day").collect()]
    assert got == [1.0, 1.0, None, None, None, 3.0, 3.0, 3.0]


def test_month_target_falls_before_leap_day(spark):
    s = frame(spark, [("a", D(2015, 2, 28), 1.0), ("a", D(2016, 1, 31), 2.0), ("a", D(2016, 2, 29), 3.0)])
    got = series.forward_returns(s, 12).collect()
    assert [(str(r.month_end), r.forward) for r in got] == [("2015-02-28", 1.0)]


def test_trailing_z_of_a_step(spark):
    days = [d for d in (D(2007, 3, 1) + timedelta(i) for i in range(72)) if d.weekday() < 5]
    s = frame(spark, [("a", d, 2.0 if d >= D(2007, 4, 30) else 1.0) for d in days])
    z = s.select("day", series.trailing_z(F.col("value"), 24).alias("z")).where("day = '2007-05-11'").first().z
    assert abs(z - 1.15830) < 1e-5


def test_trailing_rank_across_batches(spark):
    rng = np.random.default_rng(9)
    x = {k: rng.integers(0, 30, 400).astype(float) for k in "abc"}
    rows = [(k, D(2000, 1, 1) + timedelta(i), float(v)) for k, held in x.items() for i, v in enumerate(held)] + [("a", D(1999, 1, 1), None), (None, D(1999, 1, 1), 1.0)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    got = {(r.id, (r.day - D(2000, 1, 1)).days): r.share for r in series.trailing_rank(frame(spark, rows), 60, 20).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert len(got) == 1200
    for (k, i), share in got.items():
        held = x[k][max(0, i - 59) : i + 1]
        assert share is None if i < 19 else abs(share - (held <= x[k][i]).mean()) < 1e-12
    assert series.trailing_rank(frame(spark, []), 5).count() == 0


def test_gaps_and_quartiles(spark):
    values = [None, 1.0, None, None, None, None, None, 7.0, *[None] * 6, 9.0, None]
    s = frame(spark, [("a", D(2020, 1, 1) + timedelta(i), v) for i, v in enumerate(values)])
    got = series.fill_gaps(s).orderBy("day").collect()
    assert [r.value for r in got] == [None, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, *[None] * 6, 9.0, None] and [r.run for r in got][8:14] == [6] * 6
    q = frame(spark, [("a", D(2020, 1, i), v) for i, v in enumerate([1.0, 2.0, 3.0, 100.0, 2.0], 1)] + [("b", D(2020, 1, 1), 5.0)])
    assert {(r.id, r.value): r.is_outlier for r in series.quartile_flags(q).collect()}[("a", 100.0)] is True
    assert series.fill_gaps(frame(spark, [])).count() == 0


def test_regression_matches_closed_form(spark):
    rng = np.random.default_rng(3)
    x, e = rng.normal(size=80), rng.normal(size=80)
    y = 1 + 2 * x + e
    rows = [("g", i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))] + [("g", 200, None, 1.0), ("g", 201, 1.0, None)]
    got = series.hac_regression(spark.createDataFrame(rows, "g string, position int, x double, y double"), ["g"], 3).first()
    X = np.c_[np.ones(80), x]
    beta = np.linalg.lstsq(X, y, rcond=None)[0]
    u = y - X @ beta
    z = (x - x.mean()) * u / ((x - x.mean()) ** 2).sum()
    var = (z * z).sum() + 2 * sum((1 - k / 4) * (z[k:] * z[:-k]).sum() for k in (1, 2, 3))
    assert got.n == 80 and abs(got.slope - beta[1]) < 1e-10 and abs(got.slope_se - var**0.5) < 1e-10


def test_turning_points(spark):
    rows = []
    for month, kind, _ in regime.TURNING_POINTS:
        m = D.fromisoformat(month)
        after = (m + timedelta(32)).replace(day=1)
        late = D(2030, 1, 1)
        rows += [(m, late, "expansion" if kind == "peak" else "recession"), (after, late, "recession" if kind == "peak" else "expansion")]
    rows += [(D(2008, 9, 1), D(2008, 11, 30), "expansion"), (D(2008, 9, 1), D(2009, 1, 1), "recession"), (D(1980, 1, 1), D(1980, 1, 15), None)]
    got = spark.createDataFrame(rows, "m date, t date, want string").withColumn("s", regime.state_at(F.col("m"), F.col("t")))
    assert got.where("not (s <=> want)").count() == 0


def test_scalars(spark):
    row = spark.range(1).select(
        *[c.alias(f"w{i}") for i, c in enumerate(scalar.wilson(F.lit(8.0), F.lit(8.0)))], scalar.wilson(F.lit(7.0), F.lit(8.0))[0].alias("w2"),
        scalar.wilson(F.lit(0.0), F.lit(0.0))[1].alias("w3"), scalar.beta_posterior_mean(F.lit(8), F.lit(8), 0.5, 4).alias("b"),
        scalar.lowest_cap(F.lit(1.0), F.lit(None).cast("double"), F.lit(0.7)).alias("cap"), scalar.quarter_date(F.lit("2003:Q2")).alias("q"),
        scalar.decimal_month(F.lit("1871.1")).alias("m"), scalar.decimal_month(F.lit("x")).alias("none"), scalar.verdict(F.lit(100), 12).alias("v"),
    ).first()
    assert abs(row.w0 - 0.6756) < 1e-4 and abs(row.w2 - 0.529) < 1e-3 and row.w3 == 1.0 and abs(row.b - 10 / 12) < 1e-12
    assert row.cap == 0.7 and row.q == D(2003, 4, 1) and row.m == D(1871, 10, 1) and row.none is None and row.v == "FULL"


def test_markov_likelihood_rises_and_states_part(spark):
    rng = np.random.default_rng(5)
    truth = np.repeat([0, 1, 0, 1], 60)
    x = np.c_[rng.normal(truth * 4, 1), rng.normal(-truth * 3, 1)]
    m = regime.fit_markov(x, states=2, rounds=60)
    ll = m.log_likelihoods
    assert all(b >= a - 0.5 for a, b in zip(ll, ll[1:])) and ll[-1] > ll[0]
    t = spark.createDataFrame([("k", D(2000, 1, 1) + timedelta(i), float(a), float(b)) for i, (a, b) in enumerate(x)], "k string, d date, a double, b double")
    got = np.array([r.state for r in regime.decode(t, "k", "d", ["a", "b"], m).orderBy("d").collect()])
    assert max((got == truth).mean(), (got != truth).mean()) > 0.97


def test_gates(spark):
    t = spark.createDataFrame([(1, 5.0), (1, -1.0), (2, None)], "k int, v double")
    gates = audit.report([audit.unique(t, "t", "k"), audit.always(t, "t", "positive", F.col("v") > 0), audit.always(t.limit(0), "t", "empty", F.col("v") > 0)])
    assert [r.passed for r in gates.collect()] == [False, False, True]
    with pytest.raises(ValueError):
        audit.assert_passed(gates)
