"""Validity intervals, the join of events with what was known at event time, and attribute history."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days per time bucket of the containment join.
BUCKET_DAYS = 64
#: Places of the hashed set of asked entities; it bounds that set's broadcast, whatever the number of entities.
ASKED_PLACES = 1 << 21
#: End of a version that is still valid.
OPEN_END = "9999-12-31"


def latest_per_day(
    changes: DataFrame, keys: Sequence[str], change_day: str, order_by: str, payload: Sequence[str]
) -> DataFrame:
    """One row per entity and change day with the payload of the highest order_by: keys, __start, order_by, payload.

    A null order_by counts as lowest. The aggregation combines before the
    shuffle, so an entity with very many rows sends one row per task and day.
    Whole-number orders and fixed-width payloads keep it a hash aggregation.
    """
    whole = dict(changes.dtypes)[order_by] in ("tinyint", "smallint", "int", "bigint")
    ranked = (
        F.coalesce(F.col(order_by).cast("long"), F.lit(-(2**63))) if whole
        else F.struct(F.col(order_by).isNotNull().alias("r"), F.col(order_by).alias("o"))
    )
    return (
        changes.where(F.col(change_day).isNotNull())
        .groupBy(*[F.col(k) for k in keys], F.col(change_day).alias("__start"))
        .agg(F.max(order_by).alias(order_by), *[F.max_by(c, ranked).alias(c) for c in payload if c != order_by])
    )


def _bucket(column: Column, width: int) -> Column:
    return F.floor(F.unix_date(column) / F.lit(width)).cast("int")


def join_as_of(
    events: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    event_day: str,
    change_day: str,
    order_by: str,
    payload: Sequence[str],
    bucket_days: int = BUCKET_DAYS,
) -> DataFrame:
    """Each event with the attributes of its entity that were valid on its day.

    Validity is half open: from a change day up to, but without, the next one;
    of several changes on one day the highest order_by counts, whatever its
    payload holds. Successive change days give the intervals, which are cut into
    time buckets and met by an equi-join on entity and bucket. The buckets of an
    interval reach only over the days for which its entity has events at all, so
    an entity costs at most its changes plus its span of events in buckets.
    Changes of entities without events are dropped where they are read, by a
    hashed set of the asked entities, which has ASKED_PLACES rows at most; those
    that share a place with an asked one go at the exact join.

    Events of a null key, of a null day or of a day before the first change get
    no row; repeated events give repeated rows. Further columns of either side
    are ignored: the result has the columns of events, then order_by and
    payload (a payload column that events also have must be renamed before).
    """
    clash = {order_by, *payload} & set(events.columns)
    if clash:
        raise ValueError(f"columns on both sides: {sorted(clash)}")
    inner = [f"__k{i}" for i in range(len(keys))]
    asked = events.withColumns(
        {k2: F.col(k) for k2, k in zip(inner, keys)} | {"__day": F.col(event_day)}
    ).where(" and ".join(f"{k} is not null" for k in [*inner, "__day"]))
    span = asked.groupBy(*inner).agg(F.min("__day").alias("__lo"), F.max("__day").alias("__hi"))
    carried = list(dict.fromkeys([order_by, *payload]))
    place = F.pmod(F.xxhash64(*inner), F.lit(ASKED_PLACES)).alias("__place")
    slim = changes.select(
        *[F.col(k).alias(k2) for k2, k in zip(inner, keys)], F.col(change_day).alias("__change"), *[F.col(c) for c in carried]
    ).select("*", place)
    wanted = slim.join(F.broadcast(asked.select(place).distinct()), "__place", "left_semi").drop("__place")
    versions = latest_per_day(wanted, inner, "__change", order_by, payload)
    entity = Window.partitionBy(*inner)
    intervals = (
        versions.join(span, inner)
        .withColumn("__end", F.lead("__start").over(entity.orderBy("__start")))
        .where((F.col("__start") <= F.col("__hi")) & (F.col("__end").isNull() | (F.col("__end") > F.col("__lo"))))
        .withColumn(
            "__b",
            F.explode(
                F.sequence(
                    _bucket(F.greatest("__start", "__lo"), bucket_days),
                    _bucket(F.least(F.date_sub(F.col("__end"), 1), F.col("__hi")), bucket_days),
                )
            ),
        )
        .select(*inner, "__b", "__start", "__end", *carried)
    )
    return (
        asked.withColumn("__b", _bucket(F.col("__day"), bucket_days))
        .join(intervals, [*inner, "__b"])
        .where((F.col("__start") <= F.col("__day")) & (F.col("__end").isNull() | (F.col("__day") < F.col("__end"))))
        .select(*events.columns, *carried)
    )


def history(
    changes: DataFrame,
    keys: Sequence[str],
    change_day: str,
    order_by: str,
    attributes: Sequence[str],
) -> DataFrame:
    """Versions of each entity's attributes: keys, attributes, valid_from, valid_to, is_current.

    Per entity and day the row with the highest order_by counts. A version starts
    on the entity's first day and wherever the attributes differ from the day
    before in that list; null is a value, and equal nulls are no change, nor are
    0.0 and -0.0. A hash of the attributes that differs from the day before marks
    a change; only where the hashes agree are the attributes themselves compared,
    against a collision. A running sum of the marks numbers the islands, and each
    island's first day and the next island's first day are its period. valid_to of
    the last is 9999-12-31. Null keys form an entity of their own; rows without a
    day are left out.
    """
    inner = [f"__k{i}" for i in range(len(keys))]
    held = [f"__a{i}" for i in range(len(attributes))]
    slim = changes.select(
        *[F.col(k).alias(k2) for k2, k in zip(inner, keys)],
        F.col(change_day).alias("__change"),
        F.col(order_by).alias("__order"),
        *[F.col(a).alias(a2) for a2, a in zip(held, attributes)],
    )
    days = latest_per_day(slim, inner, "__change", "__order", held).drop("__order")
    numeric = {a for a, kind in days.select(*held).dtypes if kind in ("double", "float")}
    # One form of zero and of NaN, so that equal values have equal hashes.
    plain = [F.when(F.isnan(a), float("nan")).otherwise(F.col(a) + F.lit(0.0)) if a in numeric else F.col(a) for a in held]
    by_day = Window.partitionBy(*inner).orderBy("__start")
    same = F.lit(True)
    for a in held:
        same = same & F.col(a).eqNullSafe(F.lag(a).over(by_day))
    before = F.lag("__hash").over(by_day)
    marked = days.withColumn("__hash", F.xxhash64(*plain, *[F.col(a).isNull() for a in held])).withColumn(
        "__new", F.when(before.isNull() | (F.col("__hash") != before), 1).when(same, 0).otherwise(1)
    )
    islands = (
        marked.withColumn("__island", F.sum("__new").over(by_day.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*inner, "__island")
        .agg(F.min("__start").alias("valid_from"), *[F.min_by(a, "__start").alias(a) for a in held])
    )
    following = F.lead("valid_from").over(Window.partitionBy(*inner).orderBy("valid_from"))
    return islands.withColumn("__next", following).select(
        *[F.col(k2).alias(k) for k2, k in zip(inner, keys)],
        *[F.col(a2).alias(a) for a2, a in zip(held, attributes)],
        "valid_from",
        F.coalesce("__next", F.lit(OPEN_END).cast("date")).alias("valid_to"),
        F.col("__next").isNull().alias("is_current"),
    )
