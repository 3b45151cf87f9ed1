"""Beta posteriors of shares and of likelihood ratios, in Arrow batches; numpy only."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_gamma = np.vectorize(lgamma, otypes=[float])


def beta_share(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction, for x within 0 and 1."""
    x, a, b = np.broadcast_arrays(*(np.asarray(v, float) for v in (x, a, b)))
    turned = x > (a + 1) / (a + b + 2)
    x, a, b = np.where(turned, 1 - x, x), np.where(turned, b, a), np.where(turned, a, b)
    with np.errstate(divide="ignore"):
        front = np.exp(_gamma(a + b) - _gamma(a) - _gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
    tiny = 1e-300
    c = np.ones_like(x)
    d = 1 - (a + b) * x / (a + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    # The fraction settles within some multiple of the root of the larger parameter.
    for m in range(1, 60 + int(8 * np.sqrt(max(1.0, float(np.max(np.maximum(a, b), initial=1.0)))))):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + up * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + up / np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
    out = np.where(x <= 0, 0.0, front * h)
    return np.where(turned, 1 - out, out)


def beta_quantile(q: float, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Bisection to the last bits of the share below which the beta distribution has q."""
    a, b = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float))
    low, high = np.zeros(a.shape), np.ones(a.shape)
    for _ in range(60):
        middle = (low + high) / 2
        under = beta_share(middle, a, b) < q
        low, high = np.where(under, middle, low), np.where(under, high, middle)
    return (low + high) / 2


def beta_interval(k: Column, n: Column, prior_mean: float = 0.5, prior_strength: int = 2, level: float = 0.95) -> Column:
    """struct(low, high): equal-tailed posterior interval of a share after k of n, under a beta prior (2 is flat); null for null."""
    a0, b0 = 1 + prior_mean * (prior_strength - 2), 1 + (1 - prior_mean) * (prior_strength - 2)
    tail = (1 - level) / 2

    @F.pandas_udf("low double, high double")
    def interval(k: pd.Series, n: pd.Series) -> pd.DataFrame:
        a, b = k.to_numpy(float) + a0, (n - k).to_numpy(float) + b0
        known = ~(np.isnan(a) | np.isnan(b))
        out = np.full((2, len(a)), np.nan)
        if known.any():
            out[:, known] = [beta_quantile(q, a[known], b[known]) for q in (tail, 1 - tail)]
        return pd.DataFrame({"low": out[0], "high": out[1]})

    return interval(k.cast("double"), n.cast("double"))


def ratio_interval(tp: Column, p: Column, fp: Column, n: Column, draws: int = 10_000, seed: int = 42) -> Column:
    """struct(median, low, high) of the likelihood ratio of a signal, drawn from the flat posteriors of both shares.

    Every row has the same stream of draws, so a row's result depends on nothing
    but its own counts.
    """
    @F.pandas_udf("median double, low double, high double")
    def interval(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        for tp, p, fp, n in batches:
            rows = []
            for a, b, c, d in zip(tp.astype(float), p.astype(float), fp.astype(float), n.astype(float)):
                if any(np.isnan(v) for v in (a, b, c, d)):
                    rows.append((None, None, None))
                    continue
                rng = np.random.default_rng(seed)
                hit, false = rng.beta(1 + a, 1 + b - a, draws), rng.beta(1 + c, 1 + d - c, draws)
                ratio = hit[false > 0] / false[false > 0]
                rows.append(tuple(float(x) for x in np.percentile(ratio, (50, 2.5, 97.5))) if len(ratio) else (None, None, None))
            yield pd.DataFrame(rows, columns=["median", "low", "high"])

    return interval(*[c.cast("double") for c in (tp, p, fp, n)])
