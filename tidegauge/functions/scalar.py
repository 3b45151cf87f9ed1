"""Column expressions without state: normalisers, date parsers, curve yields, intervals and scores."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def ramp(x: Column, low: float, high: float) -> Column:
    """0 up to low, 1 from high on, linear between."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), (x - low) / (high - low)))


def clip(x: Column, low: float, high: float) -> Column:
    """x within bounds; null stays null."""
    return F.when(x.isNotNull(), F.greatest(F.lit(low), F.least(F.lit(high), x)))


def annualised(total: Column, months: int) -> Column:
    """Yearly rate of a total return over so many months; null where the total loses all."""
    return total if months == 12 else F.when(total > -1, F.pow(1.0 + total, 12.0 / months) - 1.0)


def effective_n(n: Column, horizon_months: int) -> Column:
    """Observations that don't overlap within the horizon."""
    return F.floor(n / horizon_months).cast("int")


def verdict(n: Column, horizon_months: int, least: int = 2, full: int = 5) -> Column:
    """NO_OVERLAP, UNDERPOWERED or FULL by the number of observations that don't overlap."""
    return (
        F.when(n < least, "NO_OVERLAP")
        .when(effective_n(n, horizon_months) < full, "UNDERPOWERED")
        .otherwise("FULL")
    )


def quarter_date(text: Column) -> Column:
    """First day of the quarter in texts like 2003:Q2, 2003-Q2 or 2003Q2; else null."""
    year = F.regexp_extract(text, r"^\s*(\d{4})\s*[:\- ]?\s*[Qq]([1-4])\s*$", 1)
    quarter = F.regexp_extract(text, r"^\s*(\d{4})\s*[:\- ]?\s*[Qq]([1-4])\s*$", 2)
    return F.when(year != "", F.make_date(year.cast("int"), quarter.try_cast("int") * 3 - 2, F.lit(1)))


def decimal_month(text: Column) -> Column:
    """First day of the month in figures like 1871.01 and 1871.1 (October); else null."""
    fixed = F.format_string("%.2f", text.try_cast("double"))
    month = F.substring_index(fixed, ".", -1).try_cast("int")
    return F.when(month.between(1, 12), F.make_date(F.substring_index(fixed, ".", 1).try_cast("int"), month, F.lit(1)))


def quarter_index(date: Column) -> Column:
    return F.year(date) * 4 + F.quarter(date)


def svensson_yield(tau: float, b0: Column, b1: Column, b2: Column, b3: Column, t1: Column, t2: Column) -> Column:
    """Zero yield at tau years; without a second hump (b3 or t2 null or t2 not positive) the three-factor form."""
    x1 = F.lit(tau) / t1
    first = (1.0 - F.exp(-x1)) / x1
    base = b0 + b1 * first + b2 * (first - F.exp(-x1))
    x2 = F.lit(tau) / F.when(t2 > 0, t2)
    hump = b3 * ((1.0 - F.exp(-x2)) / x2 - F.exp(-x2))
    return F.when(t1 > 0, base + F.coalesce(hump, F.lit(0.0)))


def forward_rate(start: float, span: float, yield_at) -> Column:
    """Rate between start and start + span years from the zero yields at both."""
    return (yield_at(start + span) * (start + span) - yield_at(start) * start) / span


def wilson(k: Column, n: Column, z: float = 1.959963984540054) -> tuple[Column, Column]:
    """95 % interval of a share; without trials 0 to 1."""
    n = F.when(n > 0, n)
    p, z2 = k / n, z * z
    middle, half = p + z2 / (2 * n), z * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))
    low, high = (middle - half) / (1 + z2 / n), (middle + half) / (1 + z2 / n)
    return (
        F.coalesce(F.greatest(F.lit(0.0), low), F.lit(0.0)),
        F.coalesce(F.least(F.lit(1.0), high), F.lit(1.0)),
    )


def beta_posterior_mean(k: Column, n: Column, prior_mean: float, prior_strength: int) -> Column:
    """Mean of the share after k of n, under a beta prior of the given mean and strength (2 is flat)."""
    a, b = 1 + prior_mean * (prior_strength - 2), 1 + (1 - prior_mean) * (prior_strength - 2)
    return (k + a) / (n + a + b)


def lowest_cap(*caps: Column) -> Column:
    """Least cap that isn't null; without any, 1."""
    return F.coalesce(F.least(*caps, F.lit(None).cast("double")), F.lit(1.0))


def vintage_end(key: Column) -> Column:
    """Last day of the quarter of a vintage key like 2020Q1; else null."""
    return F.last_day(F.add_months(quarter_date(key), 2))


def published(key: Column, days: int = 14) -> Column:
    """Day on which a quarter's vintage comes out."""
    return F.date_add(vintage_end(key), days)


def sample_adequacy(n: Column, target: int) -> Column:
    """Share of confidence that n of target observations give, 1 at most."""
    return F.least(F.lit(1.0), F.sqrt(n.cast("double") / target))


#: Factors to the base of each family of units that can be converted; fixed values.
UNIT_FACTORS = {
    "money": {"USD": 1.0, "K_USD": 1e3, "M_USD": 1e6, "B_USD": 1e9, "B_USD_signed": 1e9, "T_USD": 1e12},
    "percent": {
        "pct": 0.01, "pct_change": 0.01, "pct_exposure": 0.01, "bp": 1e-4, "share": 1.0, "decimal": 1.0, "ratio": 1.0,
    },
}


def in_unit(value: Column, unit: Column, target: str) -> Column:
    """value in the target unit; a unit that isn't of the target's family, or null, raises where value isn't null."""
    factors = next((f for f in UNIT_FACTORS.values() if target in f), None)
    if factors is None:
        raise ValueError(f"no unit {target}")
    table = F.create_map(*[x for u, f in factors.items() for x in (F.lit(u), F.lit(f / factors[target]))])
    refused = F.raise_error(F.concat(F.lit("can't convert "), F.coalesce(unit, F.lit("null")), F.lit(f" to {target}"))).cast("double")
    return F.when(value.isNotNull(), value * F.coalesce(F.try_element_at(table, unit), refused))


def normal_tail(z: Column) -> Column:
    """Two-sided tail of the standard normal beyond z, by a rational approximation good to 1.2e-7 of itself."""
    x = F.abs(z) / math.sqrt(2.0)
    t = 1.0 / (1.0 + 0.5 * x)
    series = F.lit(0.0)
    for c in reversed(TAIL_COEFFICIENTS):
        series = series * t + c
    return t * F.exp(-x * x + series)


# A published Chebyshev fit of the complementary error function.
TAIL_COEFFICIENTS = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
