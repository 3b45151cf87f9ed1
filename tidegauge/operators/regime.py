"""Turning-point calendars, rule votes and a hidden Markov model."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidegauge.session import durable, spread
from tidegauge.sources import store

# US business-cycle turning points and the days they were announced (NBER).
TURNING_POINTS = [
    ("1980-01-01", "peak", "1980-06-03"), ("1980-07-01", "trough", "1981-07-08"),
    ("1981-07-01", "peak", "1982-01-06"), ("1982-11-01", "trough", "1983-07-08"),
    ("1990-07-01", "peak", "1991-04-25"), ("1991-03-01", "trough", "1992-12-22"),
    ("2001-03-01", "peak", "2001-11-26"), ("2001-11-01", "trough", "2003-07-17"),
    ("2007-12-01", "peak", "2008-12-01"), ("2009-06-01", "trough", "2010-09-20"),
    ("2020-02-01", "peak", "2020-06-08"), ("2020-04-01", "trough", "2021-07-19"),
]


def _calendar() -> Column:
    return F.array(*[
        F.struct(F.lit(m).cast("date").alias("month"), F.lit(k).alias("kind"), F.lit(a).cast("date").alias("announced"))
        for m, k, a in TURNING_POINTS
    ])


def last_point(as_of: Column, month: Column | None = None) -> Column:
    """The latest turning point announced by as_of (and not after month) as struct(month, kind, announced), or null."""
    known = F.filter(_calendar(), lambda p: (p["announced"] <= as_of) & (F.lit(True) if month is None else p["month"] <= month))
    return F.try_element_at(F.array_sort(known), F.lit(-1))


def state_at(query_day: Column, as_of: Column) -> Column:
    """expansion or recession in the month of query_day as known on as_of, null before the first announcement.

    The month of a turning point still has the state that ends with it.
    """
    month = F.trunc(query_day, "month")
    point = last_point(as_of, month)
    own = point["month"] == month
    return F.when(point["kind"] == "peak", F.when(own, "expansion").otherwise("recession")).when(
        point["kind"] == "trough", F.when(own, "recession").otherwise("expansion")
    )


def announcement_of(month: Column, kind: Column) -> Column:
    """Day on which the turning point of exactly this month and kind was announced; null if there is none."""
    met = F.filter(_calendar(), lambda p: (p["month"] == F.trunc(month, "month")) & (p["kind"] == kind))
    return F.try_element_at(met, F.lit(1))["announced"]


def recession_months(spark: SparkSession) -> DataFrame:
    """month, label: 1 for each month after a peak up to its trough; a few dozen rows."""
    falls = [(p[0], t[0]) for p, t in zip(TURNING_POINTS, TURNING_POINTS[1:]) if p[1] == "peak"]
    held = F.array(*[F.sequence(F.add_months(F.lit(p).cast("date"), 1), F.lit(t).cast("date"), F.expr("interval 1 month")) for p, t in falls])
    return spark.range(1).select(F.explode(F.flatten(held)).alias("month"), F.lit(1).alias("label"))


#: Before this month announcements have no reliable dates.
BOUNDARY = "1978-01-01"


def state_by_policy(query_day: Column, as_of: Column, real_time: Column, label: Column, label_until: Column) -> Column:
    """struct(state, source, refused) of a month under a policy on what may be used.

    Without as_of: the label, up to label_until, the last day that is labelled. From
    BOUNDARY on: the calendar as announced by as_of. Earlier months: in real time
    refused; else (training) the label. refused says why there is no state; a label
    is 1 for recession and 0 for expansion.
    """
    words = F.when(label == 1, "recession").when(label == 0, "expansion")
    known = state_at(query_day, as_of)
    early = query_day < F.lit(BOUNDARY).cast("date")
    by_label = as_of.isNull() | early
    refused = (
        F.when(as_of.isNotNull() & early & real_time, "training only")
        .when(by_label & (label_until.isNull() | (query_day > label_until)), "past the last label")
        .when(by_label & words.isNull(), "no label")
        .when(~by_label & last_point(as_of).isNull(), "nothing announced")
        .when(~by_label & known.isNull(), "before the first known point")
    )
    state = F.when(refused.isNull(), F.when(by_label, words).otherwise(known))
    source = F.when(refused.isNull(), F.when(by_label & as_of.isNotNull(), "label, training only").when(by_label, "label").otherwise("calendar"))
    return F.struct(state.alias("state"), source.alias("source"), refused.alias("refused"))


def vote(rules: Mapping[str, Sequence[Column]], least: int = 2, otherwise: str = "indeterminate") -> Column:
    """The label with most true rules, at least so many; of equals the one named first. A null rule isn't true."""
    order = list(rules)
    counted = [
        F.struct(
            sum((F.when(rule, 1).otherwise(0) for rule in rules[label]), F.lit(0)).alias("hits"),
            F.lit(-i).alias("priority"), F.lit(label).alias("label"),
        )
        for i, label in enumerate(order)
    ]
    best = F.array_max(F.array(*counted))
    return F.when(best["hits"] >= least, best["label"]).otherwise(otherwise)


@dataclass
class Markov:
    """Gaussian hidden Markov model on standardised features."""

    mean: np.ndarray
    std: np.ndarray
    start: np.ndarray
    change: np.ndarray
    centres: np.ndarray
    covariances: np.ndarray
    log_likelihoods: list[float]


def _densities(x: np.ndarray, m: Markov) -> np.ndarray:
    out = np.empty((len(x), len(m.centres)))
    for k, (c, s) in enumerate(zip(m.centres, m.covariances)):
        root = np.linalg.cholesky(s)
        d = np.linalg.solve(root, (x - c).T)
        out[:, k] = -0.5 * (d * d).sum(axis=0) - np.log(np.diag(root)).sum() - 0.5 * x.shape[1] * np.log(2 * np.pi)
    return out


def _forward(log_b: np.ndarray, m: Markov) -> tuple[np.ndarray, np.ndarray]:
    n, k = log_b.shape
    shift = log_b.max(axis=1)
    b = np.exp(log_b - shift[:, None])
    alpha, scale = np.empty((n, k)), np.empty(n)
    state = m.start
    for t in range(n):
        a = (state if t == 0 else state @ m.change) * b[t]
        total = a.sum()
        state = a / total
        alpha[t], scale[t] = state, np.log(total) + shift[t]
    return alpha, scale


def fit_markov(features: np.ndarray, states: int = 3, rounds: int = 200, tolerance: float = 1e-4) -> Markov:
    """Expectation maximisation from a start by quantiles of the first feature; deterministic.

    For one bounded feature table (months by features), in memory. A small ridge
    keeps covariances regular; the likelihood never falls but by its effect.
    """
    mean, std = features.mean(axis=0), np.where(features.std(axis=0) > 0, features.std(axis=0), 1.0)
    x = (features - mean) / std
    n, d = x.shape
    group = np.argsort(np.argsort(x[:, 0], kind="stable")) * states // n
    ridge = 1e-3 * np.eye(d)
    m = Markov(
        mean, std, np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1)),
        np.array([x[group == k].mean(axis=0) for k in range(states)]), np.array([np.eye(d)] * states), [],
    )
    for _ in range(rounds):
        log_b = _densities(x, m)
        alpha, scale = _forward(log_b, m)
        b = np.exp(log_b - log_b.max(axis=1, keepdims=True))
        beta = np.ones((n, states))
        pairs = np.zeros((states, states))
        for t in range(n - 2, -1, -1):
            v = m.change @ (b[t + 1] * beta[t + 1])
            beta[t] = v / v.sum()
            xi = alpha[t][:, None] * m.change * (b[t + 1] * beta[t + 1])
            pairs += xi / xi.sum()
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        weight = gamma.sum(axis=0)
        m.start, m.change = gamma[0], (pairs + 1e-9) / (pairs + 1e-9).sum(axis=1, keepdims=True)
        m.centres = gamma.T @ x / weight[:, None]
        m.covariances = np.array([((gamma[:, k, None] * (x - c)).T @ (x - c)) / weight[k] + ridge for k, c in enumerate(m.centres)])
        m.log_likelihoods.append(float(scale.sum()))
        if len(m.log_likelihoods) > 1 and abs(m.log_likelihoods[-1] - m.log_likelihoods[-2]) < tolerance:
            break
    return m


@dataclass
class _Sums:
    """Expected counts and moments of some sequences under a model."""

    sequences: float
    log_likelihood: float
    start: np.ndarray
    pairs: np.ndarray
    weight: np.ndarray
    first: np.ndarray
    second: np.ndarray

    def packed(self) -> bytes:
        parts = [np.array([self.sequences, self.log_likelihood]), self.start, self.pairs, self.weight, self.first, self.second]
        return np.concatenate([p.ravel() for p in parts]).tobytes()


def _unpack(blob: bytes | np.ndarray, k: int, d: int) -> _Sums:
    v = np.frombuffer(blob) if isinstance(blob, bytes) else blob
    at = np.cumsum([2, k, k * k, k, k * d])
    head, start, pairs, weight, first, second = np.split(v, at)
    return _Sums(head[0], head[1], start, pairs.reshape(k, k), weight, first.reshape(k, d), second.reshape(k, d, d))


def _expect(sequences: Sequence[np.ndarray], m: Markov) -> _Sums:
    """Forward and backward over many sequences of standardised rows at once, padded to the longest."""
    k, d = m.centres.shape
    sizes = np.array([len(x) for x in sequences])
    n, longest = len(sizes), int(sizes.max())
    inside = np.arange(longest)[None, :] < sizes[:, None]
    x = np.zeros((n, longest, d))
    x[inside] = np.concatenate(sequences)
    log_b = np.zeros((n, longest, k))
    log_b[inside] = _densities(x[inside], m)
    shift = log_b.max(axis=2)
    b = np.exp(log_b - shift[:, :, None])
    alpha, beta, log_scale = np.zeros((n, longest, k)), np.ones((n, longest, k)), np.zeros((n, longest))
    for t in range(longest):
        on = inside[:, t]
        a = (m.start if t == 0 else alpha[on, t - 1] @ m.change) * b[on, t]
        total = a.sum(axis=1)
        alpha[on, t], log_scale[on, t] = a / total[:, None], np.log(total) + shift[on, t]
    pairs = np.zeros((k, k))
    for t in range(longest - 2, -1, -1):
        on = inside[:, t + 1]
        ahead = b[on, t + 1] * beta[on, t + 1]
        v = ahead @ m.change.T
        beta[on, t] = v / v.sum(axis=1, keepdims=True)
        xi = alpha[on, t][:, :, None] * m.change * ahead[:, None, :]
        pairs += (xi / xi.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
    gamma = alpha[inside] * beta[inside]
    gamma /= gamma.sum(axis=1, keepdims=True)
    rows, opening = x[inside], np.concatenate([[0], np.cumsum(sizes)[:-1]])
    return _Sums(
        n, float(log_scale.sum()), gamma[opening].sum(axis=0), pairs, gamma.sum(axis=0), gamma.T @ rows,
        np.einsum("nk,ni,nj->kij", gamma, rows, rows),
    )


def fit_markov_all(
    table: DataFrame, key: str, day: str, features: Sequence[str], states: int = 3, rounds: int = 50, tolerance: float = 1e-6, lot: int = 2000
) -> Markov:
    """Expectation maximisation over the sequences of all keys, each of its own start; the start is as in fit_markov.

    Every row has the same weight in the scale, the start and the sums. Each round
    every partition adds up its sequences' statistics, in lots of bounded size, and
    only those sums come to the driver. Rounds end when the log-likelihood gains less
    than tolerance a row. Rows with a null feature are left out, as in decode.
    """
    d = len(features)
    slim = table.select(key, day, *[F.col(f).cast("double") for f in features]).na.drop(subset=list(features))
    rows = F.array_sort(F.collect_list(F.struct(F.col(day).alias("day"), *[F.col(f).alias(f"x{i}") for i, f in enumerate(features)])))
    data = durable(spread(slim.groupBy(key).agg(rows.alias("rows")).select(*[F.col(f"rows.x{i}").alias(f"x{i}") for i in range(d)])))
    each = data.select(F.inline(F.arrays_zip(*[f"x{i}" for i in range(d)])))
    cuts = [(j + 1) / states for j in range(states - 1)]
    whole = each.agg(
        F.count("*").alias("n"), *[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)], *[F.stddev_pop(f"x{i}").alias(f"s{i}") for i in range(d)],
        F.percentile_approx("x0", cuts, 100_000).alias("cuts"),
    ).first()
    if not whole["n"]:
        raise ValueError("no rows to fit on")
    mean, std = np.array([whole[f"m{i}"] for i in range(d)]), np.array([whole[f"s{i}"] or 1.0 for i in range(d)])
    group = sum(((F.col("x0") > float(c)).cast("int") for c in whole["cuts"]), F.lit(0))
    centres = np.zeros((states, d))
    for r in each.groupBy(group.alias("g")).agg(*[F.avg(f"x{i}").alias(f"m{i}") for i in range(d)]).collect():
        centres[r["g"]] = (np.array([r[f"m{i}"] for i in range(d)]) - mean) / std
    ridge = 1e-3 * np.eye(d)
    m = Markov(
        mean, std, np.full(states, 1 / states), np.full((states, states), 0.1 / max(1, states - 1)) + np.eye(states) * (0.9 - 0.1 / max(1, states - 1)),
        centres, np.array([np.eye(d)] * states), [],
    )
    for _ in range(rounds):
        model = m

        def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total = 0.0
            for pdf in batches:
                if pdf.empty:
                    continue
                flat = np.column_stack([np.concatenate(pdf[f"x{i}"].to_numpy()) for i in range(d)])
                held = sorted(np.split((flat - model.mean) / model.std, np.cumsum(pdf["x0"].map(len))[:-1]), key=len)
                for i in range(0, len(held), lot):
                    total = total + np.frombuffer(_expect(held[i : i + lot], model).packed())
            if not np.isscalar(total):
                yield pd.DataFrame({"part": [int(TaskContext.get().partitionId())], "sums": [total.tobytes()]})

        parts = sorted(data.mapInPandas(add, "part int, sums binary").collect(), key=lambda r: r["part"])
        s = _unpack(np.sum([np.frombuffer(r["sums"]) for r in parts], axis=0), states, d)
        weight = np.maximum(s.weight, 1e-9)
        centres = s.first / weight[:, None]
        m = Markov(
            mean, std, (s.start + 1e-9) / (s.start + 1e-9).sum(), (s.pairs + 1e-9) / (s.pairs + 1e-9).sum(axis=1, keepdims=True), centres,
            s.second / weight[:, None, None] - np.einsum("ki,kj->kij", centres, centres) + ridge, [*m.log_likelihoods, s.log_likelihood],
        )
        ll = m.log_likelihoods
        if len(ll) > 1 and abs(ll[-1] - ll[-2]) < tolerance * whole["n"]:
            break
    return m


#: Version of the stored form of a model.
MODEL_VERSION = "1"
_PARTS = ("mean", "std", "start", "change", "centres", "covariances")


def save_markov(spark: SparkSession, model: Markov, features: Sequence[str], path: str) -> str:
    """Store a fitted model with the names of its features; returns the digest."""
    body = {p: getattr(model, p).tolist() for p in _PARTS} | {"features": list(features), "log_likelihoods": model.log_likelihoods}
    return store.write_model(spark, path, "markov", MODEL_VERSION, body)


def load_markov(spark: SparkSession, path: str, features: Sequence[str]) -> Markov:
    """A stored model of exactly these features; anything else raises StoreError."""
    body = store.read_model(spark, path, "markov", MODEL_VERSION, {*_PARTS, "features"})
    if body["features"] != list(features):
        raise store.StoreError(f"{path}: features {body['features']}")
    return Markov(*[np.array(body[p]) for p in _PARTS], body.get("log_likelihoods", []))


def ranked_states(decoded: DataFrame, labels: DataFrame, key: str, day: str) -> DataFrame:
    """state, share, months, rank: how often each state meets a label of 1, and its rank, the most labelled state first.

    labels(key, day, label); rows without a label count for no share. Of equal
    shares the lower state ranks first.
    """
    met = decoded.select(key, day, "state").join(labels.select(key, day, "label"), [key, day], "left")
    share = met.groupBy("state").agg(F.avg(F.col("label").cast("double")).alias("share"), F.count("*").alias("months"))
    # A row for each state of the model.
    return share.withColumn("rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("share"), "state")))


def decode(table: DataFrame, key: str, day: str, features: Sequence[str], model: Markov) -> DataFrame:
    """key, day, state (most likely path), probability and smoothed (of that state, from the rows so far and from all); rows with a null feature are left out."""
    slim = table.select(key, day, *[F.col(f).cast("double") for f in features]).na.drop(subset=list(features))
    types = dict(slim.dtypes)

    def path(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(day, ignore_index=True)
        x = (pdf[list(features)].to_numpy(float) - model.mean) / model.std
        log_b = _densities(x, model)
        log_a = np.log(model.change)
        score, back = np.log(model.start + 1e-300) + log_b[0], []
        for t in range(1, len(x)):
            step = score[:, None] + log_a
            back.append(step.argmax(axis=0))
            score = step.max(axis=0) + log_b[t]
        states = [int(score.argmax())]
        for b in reversed(back):
            states.append(int(b[states[-1]]))
        states = states[::-1]
        alpha, _ = _forward(log_b, model)
        b = np.exp(log_b - log_b.max(axis=1, keepdims=True))
        beta = np.ones_like(alpha)
        for t in range(len(x) - 2, -1, -1):
            v = model.change @ (b[t + 1] * beta[t + 1])
            beta[t] = v / v.sum()
        gamma = alpha * beta
        gamma /= gamma.sum(axis=1, keepdims=True)
        at = np.arange(len(x)), states
        return pd.DataFrame({key: pdf[key], day: pdf[day], "state": states, "probability": alpha[at], "smoothed": gamma[at]})

    return slim.groupBy(key).applyInPandas(path, f"{key} {types[key]}, {day} {types[day]}, state int, probability double, smoothed double")
