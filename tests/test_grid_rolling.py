import random
from datetime import date as D
from datetime import timedelta

from tidegauge.operators import grid, rolling

READINGS = "series_key string, period string, day date, value double, extra string"


def test_grid_marks_and_interpolates(spark):
    rows = [
        ("m", "M", D(2020, 1, 15), 1.0, ""), ("m", "M", D(2020, 1, 31), 2.0, ""), ("m", "M", D(2020, 4, 10), 9.0, ""), ("m", "M", D(2020, 2, 5), None, ""),
        ("w", "W", D(2020, 1, 1), 1.0, ""), ("w", "W", D(2020, 3, 25), 5.0, ""), ("b", "B", D(2020, 1, 3), 1.0, ""), ("b", "B", D(2020, 1, 4), 7.0, ""),
        ("b", "B", D(2020, 1, 6), 2.0, ""), (None, "M", D(2020, 1, 1), 1.0, ""), ("u", None, D(2020, 1, 1), 1.0, ""), ("q", "Q", D(2020, 5, 5), 3.0, ""),
        ("m", "M", D(2020, 4, 10), 9.0, ""), ("m", "M", D(2020, 3, 3), float("nan"), ""),
    ]
    got = {(r.series_key, str(r.period_start)): (r.value, r.status, r.gap_periods) for r in grid.regular_grid(spark.createDataFrame(rows, READINGS)).collect()}
    assert got["m", "2020-01-01"] == (2.0, "observed", 0)
    value, status, hole = got["m", "2020-02-01"]
    assert (status, hole) == ("interpolated", 2) and abs(value - (2 + 7 * 1 / 70)) < 1e-9
    assert got["w", "2020-02-03"] == (None, "gap", 11)
    assert [k for k in got if k[0] == "b"] and set(k[1] for k in got if k[0] == "b") == {"2020-01-03", "2020-01-06"}
    assert ("u", "2020-01-01") not in got and got["q", "2020-04-01"][1] == "observed"
    assert grid.regular_grid(spark.createDataFrame([], READINGS)).count() == 0


def daily(spark, rows):
    return spark.createDataFrame(rows, "entity string, day date, amount double")


def brute(amounts, windows=(7, 30)):
    days = sorted(amounts)
    out = {}
    t = days[0]
    while t <= days[-1]:
        for w in windows:
            held = [v for d, v in amounts.items() if t - timedelta(w) < d <= t]
            out[t, w] = (len(held), round(sum(held), 6))
        t += timedelta(1)
    return out


def seen(state):
    return {(r.day, r.window_days): (r.n, round(r.total, 6)) for r in rolling.figures(state).collect()}


def test_rolling_advance_and_corrections(spark):
    random.seed(2)
    amounts = {D(2021, 1, 1) + timedelta(i): round(random.uniform(1, 100), 2) for i in range(120) if random.random() < 0.4 and not 50 < i < 70}
    first, last = min(amounts), max(amounts)
    state = rolling.advance(None, daily(spark, [("a", d, v) for d, v in amounts.items()])).cache()
    assert seen(state) == brute(amounts)
    tomorrow = last + timedelta(1)
    more = dict(amounts) | {tomorrow: 5.0}
    step = rolling.advance(state, daily(spark, [("a", tomorrow, 5.0), ("a", first, 7.0)]), version=1)
    assert seen(step) == {k: v for k, v in brute(more).items() if k[0] == tomorrow} and {r.version for r in step.collect()} == {1}
    paused = rolling.advance(state, daily(spark, []), until=last + timedelta(40))
    assert paused.count() == 40 and seen(paused)[last + timedelta(40), 30] == (0, 0.0)
    fixed = sorted(amounts)[5]
    changed = dict(amounts) | {fixed: 1000.0}
    new = rolling.correct(state, daily(spark, [("a", fixed, 1000.0)]), 1)
    assert seen(rolling.latest(state.unionByName(new))) == brute(changed)
    assert all(fixed <= r.day < fixed + timedelta(30) for r in new.collect())
    early, after = first - timedelta(9), last + timedelta(50)
    both = daily(spark, [("a", early, 3.0), ("a", after, 4.0), ("b", first, 2.0), ("a", fixed, None), ("c", first, None)])
    whole = rolling.correct(state, both, 1, whole=True)
    want = {d: v for d, v in amounts.items() if d != fixed} | {early: 3.0, after: 4.0}
    assert seen(whole.where("entity = 'a'")) == brute(want) and seen(whole.where("entity = 'b'")) == brute({first: 2.0})
    assert whole.where("entity = 'c'").count() == 0


def test_rolling_in_lots_equals_at_once(spark):
    random.seed(5)
    start = D(2021, 1, 1)
    rows = []
    for entity in "abcd":
        days = sorted(random.sample(range(90), 40))
        rows += [(entity, start + timedelta(d), random.choice([None, float("nan"), 1.5, 2.5]) if random.random() < 0.2 else float(d), 0) for d in days]
    random.shuffle(rows)
    rows.sort(key=lambda r: r[1] + timedelta(random.choice([0, 0, 0, 25])))
    rows += [(e, d, None if random.random() < 0.3 else 99.0, 0) for e, d, _, _ in random.sample(rows, 12)]
    rows = [(e, d, v, i) for i, (e, d, v, _) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "e string, d date, v double, r long")
    got = {(r.entity, r.day, r.window_days): (r.n, r.total) for r in rolling.figures(rolling.maintained(frame, "e", "d", "v", "r")).collect()}
    want = {}
    for entity in "abcd":
        last = {d: v for e, d, v, _ in rows if e == entity}
        amounts = {d: v for d, v in last.items() if v is not None}
        want |= {(entity, *k): v for k, v in brute(amounts).items()}
    assert got.keys() == want.keys()
    assert all(n == want[k][0] and (t == want[k][1] or t != t and want[k][1] != want[k][1]) for k, (n, t) in got.items())
    empty = {(r.entity, r.day, r.window_days) for r in rolling.empty_windows(rolling.maintained(frame, "e", "d", "v", "r")).collect()}
    assert empty == {k for k, v in want.items() if v[0] == 0}


def test_rolling_odd_amounts_leave_no_residue(spark):
    rows = [("a", D(2021, 1, 1), 1e15), ("a", D(2021, 1, 2), 0.1), ("a", D(2021, 2, 20), 0.2), ("n", D(2021, 1, 1), float("nan")), ("n", D(2021, 2, 15), 1.5)]
    got = {(r.entity, str(r.day), r.window_days): r for r in rolling.figures(rolling.advance(None, daily(spark, rows))).collect()}
    assert got["a", "2021-01-08", 7].total == 0.1 and got["a", "2021-02-10", 30].total == 0.0 and got["a", "2021-02-10", 30].average is None
    assert got["n", "2021-01-03", 7].total != got["n", "2021-01-03", 7].total and got["n", "2021-02-15", 7].total == 1.5
    # After a NaN has left the window, advance goes on with exact totals.
    state = rolling.advance(None, daily(spark, [("n", D(2021, 1, 1), float("nan")), ("n", D(2021, 1, 3), 0.2)]))
    step = rolling.advance(state, daily(spark, [("n", D(2021, 1, 9), 0.5)]))
    on = {(str(r.day), r.window_days): r.total for r in rolling.figures(step).collect()}
    assert on["2021-01-09", 7] == 0.7 and on["2021-01-07", 7] != on["2021-01-07", 7] and on["2021-01-08", 7] == 0.2 and on["2021-01-09", 30] != on["2021-01-09", 30]
    assert rolling.advance(None, daily(spark, [])).count() == 0 and rolling.correct(state, daily(spark, []), 1).count() == 0
    raw = spark.createDataFrame(
        [("a", D(2021, 1, 1), 1.0, 1), ("a", D(2021, 1, 1), None, 2), ("b", D(2021, 1, 1), 2.0, 2), ("b", D(2021, 1, 1), 2.0, 2), (None, D(2021, 1, 1), 2.0, 3)],
        "e string, d date, v double, r long",
    )
    assert [tuple(r) for r in rolling.daily_amounts(raw, "e", "d", "v", "r").collect()] == [("b", D(2021, 1, 1), 2.0)]
