from datetime import datetime, timedelta

import numpy as np
import pytest

from tidegauge.operators import spikes, units


def flags(x):
    o = spikes.judge(np.asarray(x, float))
    x = np.asarray(x, float)
    return np.flatnonzero(((x < o.low) | (x > o.high)) & ~o.seasonal).tolist(), np.flatnonzero(o.held).tolist()


def noise(n, level=100.0, seed=1):
    return level + np.random.default_rng(seed).normal(0, 1, n)


def test_spikes_bursts_and_levels():
    x = noise(200)
    x[50], x[80:84], x[120:] = 150, 40, x[120:] + 60
    found, held = flags(x)
    assert found == [50, 80, 81, 82, 83] and held == []


def test_stuck_runs_but_not_step_series():
    x = noise(200)
    x[60:75] = x[60]
    assert flags(x) == ([], list(range(61, 75)))
    steps = np.repeat([1.0, 1.25, 1.5, 1.25, 1.0, 1.25], 30)
    assert flags(steps) == ([], [])
    steps[40] = 12.5
    assert flags(steps)[0] == [40]


def test_seasonal_moves_are_usual():
    x = noise(300)
    x[20::25] += 12
    assert len(flags(x)[0]) <= 2
    assert flags([]) == ([], []) and flags([1.0]) == ([], []) and flags([5.0] * 40) == ([], [])


def test_flag_readings(spark):
    x = noise(60)
    t = datetime(2021, 1, 1, 8)
    rows = [("i", None, n, t + timedelta(n), float(v), "x") for n, v in enumerate(x)]
    rows += [("i", None, 100, t + timedelta(30), 500.0, "x"), ("i", None, 101, t + timedelta(30), 500.0, "x"), ("i", None, 102, t + timedelta(61), -5.0, "x"),
             ("i", None, 103, t + timedelta(62), None, "x"), ("i", None, 104, None, 500.0, "x"), ("i", None, 105, t + timedelta(63), float("inf"), "x"),
             ("i", None, None, t, 900.0, "x"), ("k", "a", 106, t, 1e9, "x")]
    frame = spark.createDataFrame(rows, "ind string, area string, rid long, ts timestamp, v double, low string")
    limits = spark.createDataFrame([("i", 0.0, None), ("j", 1.0, 2.0)], "ind string, low double, high double")
    got = spikes.flag_readings(frame, limits, ["ind", "area"], "rid", "ts", "v", ["ind"], "low", "high")
    assert sorted((r.rid, r.reason) for r in got.collect()) == [(100, "spike"), (101, "spike"), (102, "limit"), (105, "limit")]
    assert spikes.flag_readings(frame.limit(0), limits, ["ind", "area"], "rid", "ts", "v", ["ind"], "low", "high").count() == 0


@pytest.mark.parametrize("text,value", [
    ("39.180", 39.18), ("39,53", 39.53), ("38,682,601,745", 38682601745), ("38.655.836.623,0", 38655836623), ("20 414 112", 20414112), ("3.6e+10", 3.6e10),
    ("1,234.5", 1234.5), ("1.234,5", 1234.5), ("$4.14932e+01", 41.4932), (" 0,36420", 0.3642), ("1 580,5", 1580.5), ("-12.5 %", -12.5), ("748,454", 748454),
    ("n/a", None), (".", None), ("", None),
])
def test_numbers(text, value):
    assert units.read_value(text, "money")[0] == value


def test_aliases_by_context():
    assert units.read_value("25.2 million", "money")[1] == "M_USD" and units.read_value("25.2 million", "number")[1] == "count_m"
    assert units.read_value("9k USD", "money")[1] == "K_USD" and units.read_value("9bn", "money")[1] == "B_USD" and units.read_value("9bps", "ratio")[1] == "bp"
    assert units.unit_of_field("'000 USD", "money") == "K_USD" and units.unit_of_field("per cent", "ratio") == "pct" and units.unit_of_field("PCT", "money") is None
    prose = units.unit_of_prose
    assert prose("thousands of forms still open", "number") is None and prose("checked against 2 million ledger lines", "money") is None
    assert prose("percent of filers: 96", "ratio") is None and prose("values: thousands of forms open", "number") is None
    assert prose("stated in units, not thousands, see cover page", "number") == "count"
    assert prose("(figures are hundredths of a percentage point)", "ratio") == "bp"
    assert prose("all figures quoted by the bureau as millions of dollars", "money") == "M_USD" and prose("we report k USD", "money") == "K_USD"
    assert prose("discontinued precursor spliced in, scale unchanged", "money") is None and prose("", "money") is None


def test_common_units(spark):
    rows = [(i, "s", "B_USD", f"{40 + i * 0.1:.3f}", None, None, "") for i in range(20)]
    rows += [(50, "s", "B_USD", "41,000.5", "USD bn", None, ""), (51, "s", "B_USD", "40.5", "M_USD", None, ""), (52, "s", "B_USD", "n/a", None, None, None),
             (53, "s", "B_USD", None, "USD", None, None), (54, "s", "B_USD", "0", "M_USD", None, None), (55, "x", "index", "7", "pct", None, None),
             (56, "y", None, "7", None, None, None), (57, None, "pct", "3", None, None, None), (50, "s", "B_USD", "41,000.5", "USD bn", None, "")]
    frame = spark.createDataFrame(rows, "id long, series string, home string, text string, field string, note string, span string")
    got = {r.id: (r.unit, r.value) for r in units.common_units(frame).collect()}
    assert units.common_units(frame).count() == len(rows)
    assert got[50][0] == "M_USD" and abs(got[50][1] - 41.0005) < 1e-9 and got[51] == ("B_USD", 40.5)
    assert got[52] == (None, None) and got[53] == (None, None) and got[54] == ("M_USD", 0.0) and got[55] == ("index", 7.0)
    assert got[57] == ("pct", 3.0)
    basis = {r.id: r.basis for r in units.common_units(frame).collect()}
    assert (basis[0], basis[50], basis[51], basis[52], basis[54], basis[55]) == ("home", "level", "level", None, "label", "home")
    assert units.common_units(frame.limit(0)).count() == 0


def plain_chart(x, rules, floor):
    """One series, one reading at a time."""
    mean, since, side = float(np.median(x[:15])), 0, 0
    scale = max(floor, float(np.median(np.abs(np.diff(x))))) if len(x) > 1 else floor
    out = []
    for i, v in enumerate(x):
        out.append((mean, scale))
        r = v - mean
        suspect = abs(r) > rules.limit * scale
        most = (rules.suspect_clip if suspect else rules.clip) * scale
        now = (1 if r > 0 else -1) if suspect else 0
        since = (since + 1 if now == side else 1) if suspect else 0
        side = now
        used = max(-most, min(most, r))
        mean += rules.weight * used
        scale = max(floor, scale + rules.weight / 4 * (abs(used) - scale))
        if since >= rules.settle:
            mean, since, side = float(np.median(x[i - rules.settle + 1 : i + 1])), 0, 0
    return np.array(out)


def test_charts_of_many_series_are_those_of_each():
    rng = np.random.default_rng(8)
    xs = [np.round(rng.normal(50, 2, n), 2) for n in (5, 90, 40, 200, 1)]
    xs[1][30:60] += 80
    xs[3][[20, 21, 150]] = 500
    rules = spikes.ChartRules()
    for x, (m, s) in zip(xs, spikes.charts(xs, np.full(5, 0.1), rules)):
        assert np.allclose(np.c_[m, s], plain_chart(x, rules, 0.1))


FLAGGED = "ind string, rid long, ts timestamp, v double"


def flagged(spark, rows, **how):
    limits = spark.createDataFrame([("none", 0.0, 0.0)], "ind string, low double, high double")
    got = spikes.flag_readings(spark.createDataFrame(rows, FLAGGED), limits, ["ind"], "rid", "ts", "v", ["ind"], "low", "high", **how)
    return sorted((r.rid, r.reason) for r in got.collect())


def test_every_moment_is_charted(spark):
    t = datetime(2021, 1, 1)
    x = noise(480, seed=3)
    x[200:240] = x[200]
    rows = [("h", n, t + timedelta(hours=n), float(v)) for n, v in enumerate(x)]
    assert flagged(spark, rows) == [(n, "stuck") for n in range(201, 240)]
    # Copies of a flagged figure are flagged with it, a third and fourth one too, under one number or several.
    copies = [("h", 1000 + k, t + timedelta(hours=220), float(x[220])) for k in range(3)] + [("h", 1000, t + timedelta(hours=220), float(x[220]))]
    assert flagged(spark, rows + copies) == sorted([(n, "stuck") for n in range(201, 240)] + [(1000, "stuck")] * 2 + [(1001, "stuck"), (1002, "stuck")])


def test_long_series_in_spans(spark):
    t = datetime(2021, 1, 1)
    x = noise(1200, seed=4)
    x[[100, 399, 400, 801]] = 300.0
    x[600:640] = x[600]
    rows = [("long", n, t + timedelta(minutes=n), float(v)) for n, v in enumerate(x)] + [("short", 5000 + n, t + timedelta(days=n), float(v)) for n, v in enumerate(noise(50))]
    want = sorted([(n, "spike") for n in (100, 399, 400, 801)] + [(n, "stuck") for n in range(601, 640)])
    assert flagged(spark, rows) == want and flagged(spark, rows, hot_rows=300) == want


def test_values_against_a_plain_reading(spark):
    import os
    from collections import defaultdict

    from tidegauge.plans import problems

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    power = {u: p for units_ in units.FAMILIES.values() for u, p in units_.items()}
    rows, levels = {}, defaultdict(list)
    for r in problems._records(spark, d).collect():
        family = units.FAMILY_OF.get(r.home)
        figure, said = units.read_value(r.text, family) if r.text is not None else (None, None)
        if family:
            said = said or (r.field and units.unit_of_field(r.field, family)) or (r.note and units.unit_of_prose(r.note, family)) or (r.span and units.unit_of_prose(r.span, family)) or None
        rows[r.id] = (r, family, figure, said)
        if figure and family:
            levels[r.series] += [round(np.log10(abs(figure)) + power[said or r.home], 2)] * (3 if said else 1)
    got = {r.rec_id: r for r in problems.p4_values(spark, d).collect()}
    assert got.keys() == rows.keys()
    moved = 0
    for i, (r, family, figure, said) in rows.items():
        if figure is None:
            assert got[i].value is None and got[i].unit is None
            continue
        unit = said or r.home
        if figure and family:
            usual, steps = np.median(levels[r.series]), sorted(units.FAMILIES[family].values())
            at = np.log10(abs(figure))
            if abs(at + power[unit] - usual) > 0.625 * min(b - a for a, b in zip(steps, steps[1:])):
                unit = min(units.FAMILIES[family], key=lambda u: abs(at + power[u] - usual))
        moved += unit != r.home
        assert got[i].unit == unit and np.isclose(got[i].value, figure * 10.0 ** (power.get(unit, 0) - power.get(r.home, 0)))
    assert moved > 10


def test_planted_faults_are_found():
    rng = np.random.default_rng(12)
    hit = false = missed = 0
    xs, planted = [], []
    for k in range(80):
        n = int(rng.integers(150, 400))
        walk = np.cumsum(rng.normal(0, 0.3, n)) if k % 2 else np.zeros(n)
        x = 100 + walk + rng.normal(0, 1, n) + (4 * np.sin(np.arange(n) / 9) if k % 3 == 0 else 0)
        if k % 4 == 0:
            x[n // 2 :] += 30
        bad = rng.choice(np.arange(10, n - 10), 5, replace=False)
        bad = bad[np.abs(bad - n // 2) > 8]
        x[bad] += rng.choice([-1, 1], len(bad)) * rng.uniform(20, 200, len(bad))
        xs.append(x)
        planted.append(set(bad.tolist()))
    for x, bad, (low, high, seasonal, _) in zip(xs, planted, spikes.judge_all(xs)):
        found = set(np.flatnonzero(((x < low) | (x > high)) & ~seasonal).tolist())
        hit, false, missed = hit + len(found & bad), false + len(found - bad), missed + len(bad - found)
    assert hit / (hit + missed) >= 0.97 and hit / (hit + false) >= 0.97
