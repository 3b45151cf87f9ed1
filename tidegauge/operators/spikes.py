"""Implausible readings: robust control charts, run-length counters and physical limits."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidegauge.session import stored

#: A series of more rows than this is cut into spans of time of so many rows on average, each charted with its surroundings.
HOT_ROWS = 2_000_000
#: Share of a span that is charted before and after it, so that its charts have settled.
MARGIN = 0.125
#: Rows that a task charts together.
LOT = 200_000
#: Moves within so many readings of a suspect bear witness for its season.
REACH = 4096
#: Places of the hashed set of flagged copies; it bounds that set's broadcast.
COPY_PLACES = 1 << 21


@dataclass(frozen=True)
class ChartRules:
    """Parameters of the charts; scales are mean absolute deviations.

    weight: of a new reading in mean and scale. clip: deviation, in scales, that
    an update may have at most. limit: deviation, in scales, beyond which a
    reading is suspect. suspect_clip: deviation, in scales, to which a suspect value
    is clipped before it updates the chart. settle: so many suspects in a row make a new level.
    shortest_run: least length of a run of equal readings that can be a fault.
    cycle_share: share of the cycles in which a move must recur to be seasonal.
    """

    weight: float = 0.3
    clip: float = 2.5
    limit: float = 6.5
    suspect_clip: float = 1.0
    settle: int = 7
    shortest_run: int = 7
    cycle_share: float = 0.6


def runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal readings."""
    starts = np.flatnonzero(np.r_[True, x[1:] != x[:-1]])
    return starts, np.diff(np.r_[starts, len(x)])


def least_scale(x: np.ndarray) -> float:
    """Least scale of a series' charts, from the changes between neighbours.

    A quarter of the median change; for a series that mostly stands still, half
    of its usual step between values that it holds, so that steps back and forth
    are usual.
    """
    moves = np.abs(np.diff(x))
    typical = 0.25 * float(np.median(moves)) if len(moves) else 0.0
    if typical > 0.0:
        return typical
    starts, lengths = runs(x)
    steps = np.abs(np.diff(x[starts[lengths >= 3]]))
    steps = steps[steps > 0]
    return max(1e-12, 0.5 * float(np.median(steps)) if len(steps) else 0.02 * abs(float(np.median(x))))


def charts(xs: Sequence[np.ndarray], floors: np.ndarray, rules: ChartRules) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each series the mean and scale that the readings before each reading lead to expect.

    An exponentially weighted mean and mean absolute deviation. Every reading
    updates both, clipped to rules.clip scales; a suspect one, to rules.suspect_clip.
    After rules.settle suspects in a row on one side the mean starts anew from their
    median: the level has changed. All series go forward together, one step a reading.
    """
    order = sorted(range(len(xs)), key=lambda i: -len(xs[i]))
    sizes = np.array([len(xs[i]) for i in order])
    x = np.full((int(sizes.max(initial=0)), len(xs)), np.nan)
    floor = np.asarray(floors, float)[order]
    mean, scale = np.zeros(len(xs)), floor.copy()
    for j, i in enumerate(order):
        x[: sizes[j], j] = xs[i]
        mean[j] = np.median(xs[i][:15])
        if sizes[j] > 1:
            scale[j] = max(floor[j], np.median(np.abs(np.diff(xs[i]))))
    means, scales = np.empty_like(x), np.empty_like(x)
    since, side = np.zeros(len(xs), np.int64), np.zeros(len(xs), np.int64)
    a, b = rules.weight, rules.weight / 4
    # The longest series stand first, so that those still going are a slice.
    going = len(xs) - np.searchsorted(sizes[::-1], np.arange(len(x)), side="right")
    for t, k in enumerate(going.tolist()):
        m, s = mean[:k], scale[:k]
        means[t, :k], scales[t, :k] = m, s
        r = x[t, :k] - m
        off = np.abs(r)
        suspect = off > rules.limit * s
        most = rules.clip * s
        if suspect.any():
            most[suspect] = rules.suspect_clip * s[suspect]
            now = np.where(suspect, np.sign(r), 0).astype(np.int64)
            since[:k] = np.where(suspect, np.where(now == side[:k], since[:k] + 1, 1), 0)
            side[:k] = now
            settled = np.flatnonzero(since[:k] >= rules.settle)
        else:
            since[:k], side[:k], settled = 0, 0, ()
        used = np.minimum(off, most)
        m += a * np.copysign(used, r)
        s += b * (used - s)
        np.maximum(s, floor[:k], out=s)
        if len(settled):
            m[settled] = np.median(x[t - rules.settle + 1 : t + 1, settled], axis=0)
            since[settled] = side[settled] = 0
    out: list = [None] * len(xs)
    for j, i in enumerate(order):
        out[i] = means[: sizes[j], j], scales[: sizes[j], j]
    return out


def recurring(q: np.ndarray, rules: ChartRules) -> np.ndarray:
    """Which suspects recur with a season: about the same move, whole cycles apart, in most cycles.

    q is each reading's deviation as a share of the limit; beyond 1 it is suspect.
    Moves of half the limit and more, within REACH readings, bear witness to a
    cycle. A move of over twice the limit must recur in more of the cycles, and more
    alike.
    """
    out = np.zeros(len(q), bool)
    size = np.abs(q)
    moved = np.flatnonzero(size > 0.5)
    for start in np.flatnonzero(size > 1.0).tolist():
        large = size[start] > 2.0
        spread, least, part = (1.5, 5, (1.0 + rules.cycle_share) / 2) if large else (2.0, 4, rules.cycle_share)
        near_by = moved
        n = len(q)
        if n > REACH:
            near_by = moved[np.searchsorted(moved, start - REACH) : np.searchsorted(moved, start + REACH, side="right")]
            n = min(n, start + REACH) - max(0, start - REACH)
        share = q[near_by] / q[start]
        alike = near_by[(share > 1 / spread) & (share < spread)]
        if len(alike) < least:
            continue
        away = alike - start
        # A period needs enough cycles in the series, and no more of them than there are witnesses.
        periods = np.unique(np.abs(away))
        periods = periods[(periods >= max(4, part * n / len(alike))) & (periods * least <= n)]
        if not len(periods):
            continue
        phase = away[None, :] % periods[:, None]
        near = np.minimum(phase, periods[:, None] - phase) <= np.maximum(1, periods // 24)[:, None]
        for i in np.flatnonzero(near.sum(axis=1) >= np.maximum(least, part * n / periods)).tolist():
            if len(np.unique(np.round(away[near[i]] / periods[i]))) >= max(least, part * n / periods[i]):
                out[start] = True
                break
    return out


def stuck(x: np.ndarray, rules: ChartRules) -> np.ndarray:
    """Readings that repeat the one before in a run far longer than the series otherwise shows."""
    out = np.zeros(len(x), bool)
    if len(x) < rules.shortest_run:
        return out
    starts, lengths = runs(x)
    long = lengths >= rules.shortest_run
    rest = lengths[~long]
    # A series that moves in steps holds its values for long as a rule.
    if not len(rest) or long.sum() > 0.25 * len(lengths) or (lengths[long] - 1).sum() > 0.5 * len(x):
        return out
    again = min(0.9, max(1e-3, float((rest - 1).sum()) / max(1, rest.sum())))
    usual = math.log(max(2, len(x))) / -math.log(again)
    least = max(rules.shortest_run, math.ceil(usual) + 3)
    for s, k in zip(starts[lengths >= least], lengths[lengths >= least]):
        out[s + 1 : s + k] = True
    return out


def judge_all(xs: Sequence[np.ndarray], rules: ChartRules = ChartRules()) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each series in time order: low, high, seasonal and held for every reading.

    A reading below low or above high leaves both the course seen from before and
    the course seen from after; a lasting change of level leaves only one of
    them. seasonal: it does so at the same place of most cycles. held: it repeats
    the reading before in a run that is too long for the series. Series of fewer
    than five readings have no bounds.
    """
    out = [(np.full(len(x), -np.inf), np.full(len(x), np.inf), np.zeros(len(x), bool), np.zeros(len(x), bool)) for x in xs]
    long = [i for i, x in enumerate(xs) if len(x) >= 5]
    for i in long:
        out[i][3][:] = stuck(xs[i], rules)
    fresh = [np.flatnonzero(~out[i][3]) for i in long]
    ys = [xs[i][f] for i, f in zip(long, fresh)]
    floors = np.array([least_scale(y) for y in ys])
    ahead, back = charts(ys, floors, rules), charts([y[::-1] for y in ys], floors, rules)
    for i, f, y, (m1, s1), (m2, s2) in zip(long, fresh, ys, ahead, back):
        m2, s2 = m2[::-1], s2[::-1]
        low = np.minimum(m1 - rules.limit * s1, m2 - rules.limit * s2)
        high = np.maximum(m1 + rules.limit * s1, m2 + rules.limit * s2)
        out[i][0][f], out[i][1][f] = low, high
        out[i][2][f] = recurring((y - (low + high) / 2) / np.maximum((high - low) / 2, 1e-12), rules)
    return out


def judge(x: np.ndarray, rules: ChartRules = ChartRules()) -> pd.DataFrame:
    """low, high, seasonal and held of one series, see judge_all."""
    return pd.DataFrame(dict(zip(("low", "high", "seasonal", "held"), judge_all([np.asarray(x, float)], rules)[0])))


def _flag(v: np.ndarray, at: np.ndarray, rank: np.ndarray, starts: np.ndarray, rules: ChartRules) -> np.ndarray:
    """0, 1 (stuck) or 2 (spike) for the figures of whole series, which begin at starts; figures are in order of time and rank."""
    fresh = np.zeros(len(v), bool)
    fresh[starts] = True
    moment = np.flatnonzero(fresh | np.r_[True, at[1:] != at[:-1]])
    # Of several figures of one moment the highest rank, the last in order, is the reading.
    chosen = np.r_[moment[1:], len(v)] - 1
    of = np.repeat(np.arange(len(moment)), np.diff(np.r_[moment, len(v)]))
    cut = np.searchsorted(moment, starts)
    low, high, seasonal, held = (np.concatenate(c) for c in zip(*judge_all(np.split(v[chosen], cut[1:]), rules)))
    own = v == v[chosen][of]
    spike = ((v < low[of]) | (v > high[of])) & ~(seasonal[of] & own)
    return np.where(held[of] & own, 1, np.where(spike, 2, 0))


def _boundaries(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """Where a row's keys differ from the row before; null equals null."""
    differs = np.zeros(t.num_rows, bool)
    differs[0] = True
    for k in keys:
        c = t.column(k).combine_chunks()
        a, b = c.slice(1), c.slice(0, len(c) - 1)
        unlike = pc.or_kleene(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        differs[1:] |= unlike.to_numpy(zero_copy_only=False)
    return np.flatnonzero(differs)


def flag_readings(
    readings: DataFrame, limits: DataFrame, keys: list[str], row_id: str, time: str, value: str,
    limit_keys: list[str], low: str, high: str, rules: ChartRules = ChartRules(), hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """row_id and reason of every implausible row; a row has one reason.

    reason is limit (beyond the physical limits in limits(limit_keys, low, high),
    a null limit being none, or infinite), stuck, or spike, the first that holds.
    Each series is charted over one reading a moment, that of the highest row_id;
    corrected figures of the moment are held against the same chart. Null and NaN
    values, null times and null row ids are never flagged; a null key is a value
    like another. Series of fewer than five readings have limits only.

    Copies are reduced to one figure before the shuffle, and only flagged figures
    that have copies are joined with their rows again. A series of more than
    hot_rows rows is cut into spans of time, each charted with MARGIN of a span on
    both sides; what a span's chart forgets by then is beyond its precision, but its
    least scale, runs and seasons are the span's own. The flagged figures are stored.
    """
    inner = [f"k{i}" for i in range(len(keys))]
    at = F.to_timestamp(F.col(time)) if dict(readings.dtypes)[time] == "string" else F.col(time)
    rows = readings.select(
        *[F.col(k).alias(k2) for k2, k in zip(inner, keys)],
        F.col(row_id).alias("id"), at.alias("at"), F.col(value).cast("double").alias("v"),
    ).where("id is not null and at is not null and v is not null and not isnan(v)")
    bounds = limits.select(
        *[F.col(k).alias(f"l_{k}") for k in limit_keys], F.col(low).cast("double").alias("lo"), F.col(high).cast("double").alias("hi")
    ).dropDuplicates([f"l_{k}" for k in limit_keys])
    on = [F.col(inner[keys.index(k)]) == F.col(f"l_{k}") for k in limit_keys]
    infinite = F.abs("v") == F.lit(float("inf"))
    beyond = infinite | F.coalesce(F.col("v") < F.col("lo"), F.lit(False)) | F.coalesce(F.col("v") > F.col("hi"), F.lit(False))
    bounded = rows.join(bounds, on, "left")
    limited = bounded.where(beyond).select(F.col("id").alias(row_id), F.lit("limit").alias("reason"))

    figures = rows.where(~infinite).groupBy(*inner, "at", "v").agg(F.count("*").alias("copies"), F.max("id").alias("rank"))
    micros = F.unix_micros(F.col("at").cast("timestamp"))
    # At most one row for every hot_rows rows, which bounds the broadcast.
    hot = rows.groupBy(*inner).agg(F.count("*").alias("c"), F.min(micros).alias("from"), F.max(micros).alias("to")).where(F.col("c") > hot_rows).select(
        *[F.col(k).alias(f"h_{k}") for k in inner], "from", ((F.col("to") - F.col("from") + 1) / F.ceil(F.col("c") / hot_rows)).alias("width")
    )
    meets = F.lit(True)
    for k in inner:
        meets = meets & F.col(k).eqNullSafe(F.col(f"h_{k}"))
    place = (micros - F.col("from")) / F.col("width")
    own = F.floor(place).cast("int")
    spans = F.array_distinct(F.array(own, F.floor(place - MARGIN).cast("int"), F.floor(place + MARGIN).cast("int")))
    cut = figures.join(F.broadcast(hot), meets, "left").withColumn("own", F.coalesce(own, F.lit(0))).select(
        *inner, "at", "v", "copies", "rank", "own", F.explode(F.when(F.col("width").isNull(), F.array(F.lit(0))).otherwise(spans)).alias("span")
    )
    series = [*inner, "span"]

    def charted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flagged(t: pa.Table, starts: np.ndarray) -> Iterator[pa.RecordBatch]:
            moments = t.column("at")
            moments = moments.cast(pa.int32() if pa.types.is_date(moments.type) else pa.int64()).to_numpy()
            kind = _flag(t.column("v").to_numpy(), moments, t.column("rank").to_numpy(), starts, rules)
            hit = np.flatnonzero((kind > 0) & (t.column("own").to_numpy() == t.column("span").to_numpy()))
            chosen = t.select([*inner, "at", "v", "copies", "rank"]).take(hit)
            yield from chosen.append_column("reason", pa.array(np.array(["", "stuck", "spike"])[kind[hit]], pa.string())).combine_chunks().to_batches()

        held: list[pa.RecordBatch] = []
        size, wait = 0, LOT
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= wait:
                t = pa.Table.from_batches(held).combine_chunks()
                starts = _boundaries(t, series)
                done = int(starts[-1])
                if done:
                    yield from flagged(t.slice(0, done), starts[:-1])
                held, size = t.slice(done).to_batches(), t.num_rows - done
                wait = max(LOT, 2 * size)
        if size:
            t = pa.Table.from_batches(held).combine_chunks()
            yield from flagged(t, _boundaries(t, series))

    types = dict(figures.dtypes)
    shape = ", ".join(f"{k} {types[k]}" for k in [*inner, "at", "v", "copies", "rank"])
    found = stored(cut.repartition(*series).sortWithinPartitions(*series, "at", "rank").mapInArrow(charted, f"{shape}, reason string"))
    plausible = found.join(bounds, on, "left").where(~beyond).drop("lo", "hi", *[f"l_{k}" for k in limit_keys])
    single = plausible.where("copies = 1").select(F.col("rank").alias(row_id), "reason")
    spot = F.pmod(F.xxhash64(*inner, "at", F.col("v") + F.lit(0.0)), F.lit(COPY_PLACES)).alias("spot")
    several = plausible.where("copies > 1").select(*[F.col(c).alias(f"c_{c}") for c in [*inner, "at", "v"]], "reason", spot)
    same = (F.col("at") == F.col("c_at")) & (F.col("v") == F.col("c_v"))
    for k in inner:
        same = same & F.col(k).eqNullSafe(F.col(f"c_{k}"))
    copies = rows.select("*", spot).join(F.broadcast(several.select("spot").distinct()), "spot", "left_semi").join(several.drop("spot"), same)
    return limited.unionByName(single).unionByName(copies.select(F.col("id").alias(row_id), "reason"))
