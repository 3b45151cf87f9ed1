"""Figures filed in different units: aliases found in text, numbers read, one common unit."""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidegauge.session import stored

# Unit codes by family, with the power of ten that leads to the family's base unit.
FAMILIES = {
    "money": {"USD": 0, "K_USD": 3, "M_USD": 6, "B_USD": 9, "T_USD": 12},
    "ratio": {"bp": -4, "pct": -2, "share": 0},
    "number": {"count": 0, "count_k": 3, "count_m": 6},
}
FAMILY_OF = {unit: family for family, units in FAMILIES.items() for unit in units}

# How the units are written, by unit code.
ALIASES = {
    "USD": ["usd", "us$", "$", "dollars", "us dollars", "plain dollars", "single dollars", "single dollars (usd)"],
    "K_USD": [
        "k_usd", "k usd", "usd k", "kusd", "$000", "'000 usd", "usd '000", "thous. usd", "usd thousands", "thousand usd",
        "thousands usd", "thousands of dollars", "thousand dollars", "thou. of us dollars", "$k", "tsd. usd",
    ],
    "M_USD": [
        "m_usd", "m usd", "usd m", "mn usd", "usd mn", "$m", "$mn", "usd millions", "usd million", "million usd", "millions usd",
        "millions of dollars", "million dollars", "mio. usd", "usd mio.", "millions of us dollars",
    ],
    "B_USD": [
        "b_usd", "b usd", "usd b", "bn usd", "usd bn", "$b", "$bn", "usd billions", "usd billion", "billion usd", "billions usd",
        "billions of dollars", "billion dollars", "mrd. usd", "usd mrd.", "billions of us dollars",
    ],
    "T_USD": [
        "t_usd", "tn usd", "usd tn", "$tn", "usd trillions", "usd trillion", "trillion usd", "trillions usd",
        "trillions of dollars", "trillion dollars", "trillions of us dollars",
    ],
    "bp": ["bp", "bps", "b.p.", "basis points", "basis point", "hundredths of a percentage point"],
    "pct": ["pct", "%", "per cent", "percent", "percentage points", "percentage point", "p.c."],
    "share": [
        "share", "shares", "fraction", "fractions", "decimal", "ratio of 1", "shares of unity", "fractions of one",
        "decimal shares", "share of one", "ratio",
    ],
    "count": ["count", "units", "persons", "no.", "single units", "number", "heads"],
    "count_k": ["count_k", "'000 units", "thousands of units", "thousands of persons", "thousand units", "'000 persons"],
    "count_m": ["count_m", "mn units", "millions of units", "million units", "millions of persons", "mio. units"],
}
# Words for a scale alone; the indicator's family tells the unit.
SCALES = {
    3: ["k", "thousand", "thousands", "thous.", "'000", "tsd."],
    6: ["m", "mn", "million", "millions", "mio."],
    9: ["b", "bn", "billion", "billions", "mrd."],
    12: ["tn", "trillion", "trillions"],
}
# Stems of words for quantities and for putting them on record; prose near one states a unit.
CUES = [
    "amount", "figure", "value", "number", "unit", "scale", "total", "data", "state", "stating", "express", "report", "record", "file", "filing",
    "quote", "give", "show", "measure", "denominate", "convert", "kept", "keep",
]
#: A cue stands at most so many words before its unit.
CUE_WORDS = 5
#: A label is believed while the figure read by it lies within this share of a step between units from the series' level.
LABEL_SLACK = 0.625

_SPACE = re.compile(r"\s+")
_PLAIN = re.compile(r"-?\d+(?:\.\d+)?")
_CUE = re.compile(r"\b(?:" + "|".join(CUES) + r")\w*")
_COUNTS = re.compile(r" of (?!(?:" + "|".join(("us", "usd", "dollars", "units", "persons", "one", "unity", "a")) + r")\b)")
_NUMBER = re.compile(r"[-+−]?\d[\d.,' ]*(?:e[-+]?\d+)?|[-+−]?[.,]\d+(?:e[-+]?\d+)?")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for unit, words in ALIASES.items():
        for word in words:
            found.add_word(word, (word, unit, None))
    for power, words in SCALES.items():
        for word in words:
            found.add_word(word, (word, None, power))
    found.make_automaton()
    return found


def plain(text: str) -> str:
    """Lower case, one kind of space and quote."""
    return _SPACE.sub(" ", text.replace("’", "'")).strip().casefold()


def aliases(text: str) -> list[tuple[int, int, str | None, int | None]]:
    """Whole-word aliases in plain text as (start, end, unit, power), longest first where they overlap."""
    hits = []
    for end, (word, unit, power) in _automaton().iter(text):
        start, end = end - len(word) + 1, end + 1
        left, right = text[start - 1 : start], text[end : end + 1]
        if (word[0].isalpha() and (left.isalpha() or left == "_")) or (word[-1].isalpha() and (right.isalpha() or right == "_")):
            continue
        hits.append((start, end, unit, power))
    hits.sort(key=lambda h: (h[0] - h[1], h[0]))
    kept: list = []
    for h in hits:
        if all(h[1] <= k[0] or h[0] >= k[1] for k in kept):
            kept.append(h)
    return sorted(kept)


def _unit(hit: tuple, family: str) -> str | None:
    """The unit of a hit within a family, if the family has it."""
    _, _, unit, power = hit
    if unit is None:
        return next((u for u, p in FAMILIES[family].items() if p == power and family != "ratio"), None)
    return unit if FAMILY_OF[unit] == family else None


def _first(hits: list, family: str) -> str | None:
    units = [u for h in hits if (u := _unit(h, family))]
    # A currency sign beside a scale word says less than the word.
    return next((u for u in units if u != "USD"), units[0] if units else None)


def unit_of_field(text: str, family: str) -> str | None:
    return _first(aliases(plain(text)), family)


def unit_of_prose(text: str, family: str) -> str | None:
    """The unit that a note or the reason of a suspect period states.

    An alias states the unit if a cue stands at most CUE_WORDS words before it, the
    cue no part of it. One with a figure right before it, one that counts other
    things ("thousands of forms") and one that is denied ("not thousands") are
    remarks about something else.
    """
    low = plain(text)
    hits = aliases(low)
    if not hits:
        return None
    cues = [m.end() for m in _CUE.finditer(low)]
    told = []
    for hit in hits:
        start, end = hit[:2]
        before = low[:start].rstrip(" (")
        if before[-1:].isdigit() or before.endswith(" not") or _COUNTS.match(low, end):
            continue
        if any(c <= start and len(low[c:start].split()) <= CUE_WORDS for c in cues):
            told.append(hit)
    return _first(told, family)


def number(token: str) -> float | None:
    """A number written with decimal point or comma and groups by comma, point, space or quote.

    With both marks the last is the decimal one. A mark that occurs more than
    once groups. A single comma groups if it stands before exactly three digits
    and after one to three that don't begin with zero; a single point is decimal.
    """
    token = token.strip().replace("−", "-").replace(" ", "").replace("'", "")
    mantissa, e, power = token.partition("e")
    mantissa = mantissa.rstrip(".,")
    point, comma = mantissa.rfind("."), mantissa.rfind(",")
    if point >= 0 and comma >= 0:
        group = "," if point > comma else "."
        mantissa = mantissa.replace(group, "").replace(",", ".")
    elif mantissa.count(",") > 1:
        mantissa = mantissa.replace(",", "")
    elif mantissa.count(".") > 1:
        mantissa = mantissa.replace(".", "")
    elif comma >= 0:
        head, tail = mantissa.lstrip("+-").split(",")
        groups = len(tail) == 3 and 1 <= len(head) <= 3 and not head.startswith("0")
        mantissa = mantissa.replace(",", "" if groups else ".")
    try:
        value = float(mantissa + e + power)
    except ValueError:
        return None
    return value if math.isfinite(value) else None


def read_value(text: str, family: str | None) -> tuple[float | None, str | None]:
    """The figure of a value text, and the unit that stands by it."""
    if _PLAIN.fullmatch(text):
        value = float(text)
        return (value if math.isfinite(value) else None), None
    low = plain(text)
    found = _NUMBER.search(low)
    if not found:
        return None, None
    value = number(found.group())
    if value is None or family is None:
        return value, None
    rest = (low[: found.start()] + " " + low[found.end() :]).strip()
    return value, _first(aliases(rest), family) if rest else None


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    fields: dict[tuple, str | None] = {}

    def cached(how, text, family):
        if not isinstance(text, str) or family is None:
            return None
        key = (how, text, family)
        if key not in fields:
            if len(fields) > 50_000:
                fields.clear()
            fields[key] = how(text, family)
        return fields[key]

    for pdf in batches:
        family = [FAMILY_OF.get(u) if isinstance(u, str) else None for u in pdf["home"]]
        read = [read_value(t, f) if isinstance(t, str) else (None, None) for t, f in zip(pdf["text"], family)]
        field = [cached(unit_of_field, t, f) for t, f in zip(pdf["field"], family)]
        note = [cached(unit_of_prose, t, f) for t, f in zip(pdf["note"], family)]
        span = [cached(unit_of_prose, t, f) for t, f in zip(pdf["span"], family)]
        label = [v[1] or b or c or d for v, b, c, d in zip(read, field, note, span)]
        yield pd.DataFrame(
            {"id": pdf["id"], "series": pdf["series"], "home": pdf["home"], "figure": [v[0] for v in read], "label": label}
        ).astype({"figure": "float64"})


def _factors(spark) -> DataFrame:
    """Eleven rows: family, unit, power."""
    rows = ", ".join(f"('{f}', '{u}', {p})" for f, units in FAMILIES.items() for u, p in units.items())
    return spark.sql(f"select * from values {rows} as t(family, unit, power)")


def common_units(records: DataFrame) -> DataFrame:
    """Every record's figure in its indicator's unit.

    Input: records(id, series, home, text, field, note, span), where home is the
    indicator's unit and span the reason of the suspect period that the record
    falls in. Result: id, home, figure, label, unit, basis, value; one row per input row.

    label is the unit that stands by the number, else in the field, else in what
    the note states, else in what span states: of the aliases found the longest,
    and a scale word alone is read within the family of home. basis tells what
    decided on unit: label, if the figure read by it fits the level of its series
    (LABEL_SLACK of a step, a factor of 100 or 1000, between units); home, if there
    is no label and the figure fits as it stands; else level: of the family's units
    the one that brings the figure nearest to it, the label being absent or wrong.
    The level is the median magnitude of the series read by its labels, where
    figures without a label count as home and weigh a third.

    A figure that can't be read gives null figure, unit, basis and value. A home of
    no family (or null) is taken as the unit itself. A figure of zero, which has no
    magnitude, and an infinite one keep their label or home. Texts are read once;
    what was read is stored for the levels and the result.
    """
    kinds = dict(records.dtypes)
    read = stored(records.select("id", "series", "home", "text", "field", "note", "span").mapInPandas(
        _read, f"id {kinds['id']}, series string, home string, figure double, label string"
    ))
    factors = _factors(records.sparkSession)
    own = F.broadcast(factors.select("family", F.col("unit").alias("home"), F.col("power").alias("home_power")))
    said = F.broadcast(factors.select(F.col("unit").alias("label"), F.col("power").alias("label_power")))
    magnitude = F.when(F.col("figure") != 0, F.log10(F.abs("figure")))
    sized = read.join(own, "home", "left").join(said, "label", "left").withColumn("magnitude", magnitude)
    weight = F.when(F.col("label").isNull(), 1).otherwise(3)
    # Rounded levels are a few thousand values at most, so the exact median holds a bounded map.
    levels = (
        sized.select(F.col("series").alias("s"), F.round(F.col("magnitude") + F.coalesce("label_power", "home_power"), 2).alias("level"), weight.alias("w"))
        .where("level is not null and s is not null")
        .groupBy("s", "level").agg(F.sum("w").cast("long").alias("w"))
        .groupBy("s").agg(F.percentile("level", F.lit(0.5), F.col("w")).alias("usual"))
    )

    def by_family(value) -> Column:
        return functools.reduce(lambda c, f: c.when(F.col("family") == f, value(f)), FAMILIES, F.when(F.lit(False), value("money")))

    def nearest(family: str) -> Column:
        miss = [
            F.struct(F.abs(F.col("magnitude") + F.lit(p) - F.col("usual")).alias("miss"), F.lit(u).alias("unit"))
            for u, p in FAMILIES[family].items()
        ]
        return F.array_min(F.array(*miss))["unit"]

    def slack(family: str) -> Column:
        powers = sorted(FAMILIES[family].values())
        return F.lit(LABEL_SLACK * min(b - a for a, b in zip(powers, powers[1:])))

    fits = F.abs(F.col("magnitude") + F.coalesce("label_power", "home_power") - F.col("usual")) <= by_family(slack)
    basis = (
        F.when(F.col("figure").isNull(), None)
        .when(F.col("magnitude").isNull() | F.col("usual").isNull() | F.col("family").isNull() | fits, F.when(F.col("label").isNull(), "home").otherwise("label"))
        .otherwise("level")
    )
    used = F.broadcast(factors.select("unit", F.col("power").alias("unit_power")))
    chosen = F.when(F.col("basis") == "level", by_family(nearest)).when(F.col("basis") == "label", F.col("label")).when(F.col("basis") == "home", F.col("home"))
    return (
        sized.join(levels, F.col("series") == F.col("s"), "left")
        .withColumn("basis", basis)
        .withColumn("unit", chosen)
        .join(used, "unit", "left")
        .select(
            "id", "home", "figure", "label", "unit", "basis",
            (F.col("figure") * F.pow(F.lit(10.0), F.coalesce(F.col("unit_power") - F.col("home_power"), F.lit(0)))).alias("value"),
        )
    )
