"""Queries that must take in every series of their tables, over small tables written here."""

from datetime import date as D
from datetime import datetime, timedelta

import duckdb
import numpy as np

import __spark_entry__ as entry
from tidegauge.operators import regime, rolling
from tidegauge.streaming import revisions


def write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")


def from_sql(folder, name, *tables):
    c = duckdb.connect()
    for t in tables:
        c.sql(f"create view {t} as select * from read_parquet('{folder}/{t}.parquet/*.parquet')")
    want = c.sql(entry.oracle_sql()[name])
    return {tuple(r) for r in want.fetchall()}, want.columns


CLOSE = "row_id long, ticker string, obs_date timestamp_ntz, close double"


def test_ratio_has_every_ticker(spark, tmp_path):
    # A and B, the first two, share no month; C and D do.
    days = {"A": [(1, 10.0)], "B": [(2, 20.0), (3, 8.0)], "C": [(1, 30.0), (2, 40.0)], "D": [(2, 60.0), (3, None)]}
    rows = [(i, t, datetime(2020, m, 5), v) for i, (t, m, v) in enumerate((t, m, v) for t, held in days.items() for m, v in held)]
    write(spark, tmp_path, "market_close", rows, CLOSE)
    got = entry.queries()["ratio_market"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == [
        ("A", D(2020, 1, 31), 0.5), ("B", D(2020, 2, 29), 0.5), ("B", D(2020, 3, 31), 1.0), ("C", D(2020, 1, 31), 1.5),
        ("C", D(2020, 2, 29), 1.0), ("D", D(2020, 2, 29), 1.5),
    ]
    assert ({tuple(r) for r in got.collect()}, got.columns) == from_sql(tmp_path, "ratio_market", "market_close")


PANEL = "row_id long, indicator_id string, area_code string, obs_date timestamp_ntz, value double, realtime_start timestamp_ntz, realtime_end timestamp_ntz"
META = "indicator_id string, release_lag_days int"


def aligned(spark, folder, observed, closes):
    panel = [(i, k, a, t, v, t, None) for i, (k, a, t, v) in enumerate(observed)]
    write(spark, folder, "vintage_panel", panel, PANEL)
    write(spark, folder, "indicator_meta", [("i", 1), ("j", 1)], META)
    write(spark, folder, "market_close", [(i, t, at, v) for i, (t, at, v) in enumerate(closes)], CLOSE)


def test_every_indicator_is_aligned(spark, tmp_path):
    observed = [("i", "x", datetime(2020, 1, 10), 1.0), ("i", "x", datetime(2020, 2, 29), 2.0), ("i", "x", datetime(2020, 3, 3), 5.0),
                ("i", "x", datetime(2020, 3, 3), None), ("i", "y", datetime(2020, 2, 1), 3.0), ("j", "x", datetime(2020, 9, 1), 4.0)]
    aligned(spark, tmp_path, observed, [("A", datetime(2020, 1, 2), 1.0), ("B", datetime(2020, 2, 3), 1.0), ("B", datetime(2020, 3, 3), 1.0)])
    got = entry.queries()["align_indicators"](spark, str(tmp_path))
    ends = D(2020, 1, 31), D(2020, 2, 29), D(2020, 3, 31)
    want = {("i", "x"): [(D(2020, 1, 10), 1.0), (D(2020, 2, 29), 2.0), (D(2020, 2, 29), 2.0)],
            ("i", "y"): [(None, None), (D(2020, 2, 1), 3.0), (D(2020, 2, 1), 3.0)], ("j", "x"): [(None, None)] * 3}
    rows = {tuple(r) for r in got.collect()}
    assert rows == {(*k, e, *f) for k, held in want.items() for e, f in zip(ends, held)}
    assert (rows, got.columns) == from_sql(tmp_path, "align_indicators", "market_close", "vintage_panel")


def test_days_of_any_year_are_aligned(spark, tmp_path):
    observed = [("i", "x", datetime(y, 6, 1), float(y)) for y in (1885, 1999, 2031)]
    aligned(spark, tmp_path, observed, [("A", datetime(y, 5, 4), 7.0) for y in (1880, 1998, 2030, 2144)])
    got = entry.queries()["align_indicators"](spark, str(tmp_path)).collect()
    assert {r.month_end.year: r.value for r in got} == {1880: None, 1998: 1885.0, 2030: 1999.0, 2144: 2031.0}


def test_markov_is_fitted_on_what_it_decodes(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(11)
    rows = []
    for k in range(24):
        at = 100 * np.exp(np.cumsum(rng.normal(0, 0.02, 300)))
        rows += [(1000 * k + i, f"T{k}", datetime(2020, 1, 1) + timedelta(i), float(v)) for i, v in enumerate(at)]
    write(spark, tmp_path, "market_close", rows, CLOSE)
    seen, decode = {}, regime.decode
    monkeypatch.setattr(regime, "decode", lambda t, key, day, features, model: seen.update(t=t, m=model) or decode(t, key, day, features, model))
    got = entry.queries()["hmm_decode"](spark, str(tmp_path)).collect()
    months = np.array([[r["move"], r["fall"]] for r in seen["t"].collect()])
    assert len(got) == len(months) and {r.state for r in got} == {0, 1, 2} and all(r.probability is not None for r in got)
    assert np.allclose(seen["m"].mean, months.mean(axis=0)) and np.allclose(seen["m"].std, months.std(axis=0))
    ll = seen["m"].log_likelihoods
    assert all(b >= a - 0.01 * abs(a) for a, b in zip(ll, ll[1:])) and ll[-1] > ll[0]


def test_markov_over_one_sequence_is_the_plain_one(spark):
    rng = np.random.default_rng(5)
    truth = np.repeat([0, 1, 0, 1], 60)
    x = np.c_[rng.normal(truth * 4, 1), rng.normal(-truth * 3, 1)]
    t = spark.createDataFrame([("k", D(2000, 1, 1) + timedelta(i), float(a), float(b)) for i, (a, b) in enumerate(x)], "k string, d date, a double, b double")
    want = regime.fit_markov(x, states=2, rounds=8, tolerance=0)
    got = regime.fit_markov_all(t, "k", "d", ["a", "b"], states=2, rounds=8, tolerance=0)
    for name in ("mean", "std", "start", "change", "centres", "covariances", "log_likelihoods"):
        assert np.allclose(getattr(got, name), getattr(want, name), atol=1e-6), name


def test_markov_sums_don_t_depend_on_padding(spark):
    rng = np.random.default_rng(2)
    x = [rng.normal(size=(n, 2)) for n in (1, 7, 3, 12)]
    m = regime.Markov(np.zeros(2), np.ones(2), np.array([0.7, 0.3]), np.array([[0.9, 0.1], [0.2, 0.8]]), np.array([[0.0, 1.0], [1.0, -1.0]]), np.array([np.eye(2)] * 2), [])
    one = np.sum([np.frombuffer(regime._expect([s], m).packed()) for s in x], axis=0)
    assert np.allclose(np.frombuffer(regime._expect(x, m).packed()), one) and one[0] == 4


DAILY = "entity string, day date, amount double"


def same(rows, want):
    plain = lambda rs: sorted((r.entity, r.day, r.window_days, r.n, round(r.total, 6)) for r in rolling.figures(rs).collect())
    assert plain(rows) == plain(want)


def test_a_ticker_that_resumes_keeps_its_window(spark):
    before = [("a", D(2021, 1, 1), 1.0), ("a", D(2021, 1, 5), 2.0), ("b", D(2021, 1, 9), 4.0)]
    today = D(2021, 1, 10)
    fresh = spark.createDataFrame([("a", today, 8.0), ("b", today, 16.0), ("c", today, 32.0)], DAILY)
    held = rolling.advance(None, spark.createDataFrame(before, DAILY))
    whole = rolling.advance(None, spark.createDataFrame(before, DAILY).unionByName(fresh))
    same(held.unionByName(rolling.advance(held, fresh, version=1)), whole)
    carried = rolling.advance(None, spark.createDataFrame(before, DAILY), until=D(2021, 1, 9))
    same(carried.unionByName(rolling.advance(carried, fresh, version=1)), whole)


def test_a_late_amount_extends_the_range(spark):
    old = spark.createDataFrame([("a", D(2021, 3, 1), 1.0), ("a", D(2021, 3, 3), 2.0)], DAILY)
    late = spark.createDataFrame([("a", D(2021, 1, 1), 4.0), ("a", D(2021, 4, 20), 8.0), ("n", D(2021, 3, 2), 16.0)], DAILY)
    state = rolling.advance(None, old)
    same(rolling.latest(state.unionByName(rolling.correct(state, late, 1))), rolling.advance(None, old.unionByName(late)))


def test_old_revisions_of_a_later_batch_are_kept(spark, tmp_path):
    schema = "indicator_id string, area_code string, obs_date timestamp_ntz, value double, realtime_start timestamp_ntz"
    row = lambda year, value: ("i", "x", datetime(2000, 1, 1), value, datetime(year, 1, 1))
    (tmp_path / "in").mkdir()
    stream = revisions.fresh_revisions(spark.readStream.schema(schema).parquet(str(tmp_path / "in")))
    for batch in ([row(2023, 1.0), row(2023, 1.0)], [row(2023, 1.5)], [row(2005, 2.0), row(2010, 3.0), row(2023, 1.0)]):
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        revisions.append_batches(stream, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert sorted(r.value for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [1.0, 1.5, 2.0, 3.0]
