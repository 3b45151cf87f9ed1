from datetime import date as D

import pytest

from tidegauge.operators import validity

CHANGES = "entity string, other string, d date, rid long, value double"


def changes(spark, rows):
    return spark.createDataFrame(rows, CHANGES)


def test_as_of_ties_nulls_and_copies(spark):
    c = changes(spark, [
        ("a", "x", D(2020, 1, 5), 1, 1.0), ("a", "x", D(2020, 1, 5), 2, None), ("a", "x", D(2020, 1, 5), 2, None),
        ("a", "x", D(2020, 3, 1), 3, 3.0), (None, "x", D(2020, 1, 1), 4, 4.0), ("b", "x", None, 5, 5.0),
    ])
    e = spark.createDataFrame(
        [(1, "a", D(2020, 1, 4)), (2, "a", D(2020, 1, 5)), (3, "a", D(2020, 2, 29)), (4, "a", D(2020, 3, 1)), (5, None, D(2020, 5, 1)),
         (6, "b", D(2020, 5, 1)), (7, "a", None), (4, "a", D(2020, 3, 1)), (8, "a", D(2035, 1, 1))],
        "id long, entity string, at date",
    )
    got = validity.join_as_of(e, c, ["entity"], "at", "d", "rid", ["rid", "value"], bucket_days=7)
    assert got.columns == ["id", "entity", "at", "rid", "value"]
    assert sorted((r.id, r.rid, r.value) for r in got.collect()) == [(2, 2, None), (3, 2, None), (4, 3, 3.0), (4, 3, 3.0), (8, 3, 3.0)]


def test_as_of_empty_and_clash(spark):
    e = spark.createDataFrame([], "id long, entity string, at date")
    assert validity.join_as_of(e, changes(spark, []), ["entity"], "at", "d", "rid", ["value"]).count() == 0
    with pytest.raises(ValueError):
        validity.join_as_of(e.withColumnRenamed("id", "value"), changes(spark, []), ["entity"], "at", "d", "rid", ["value"])


def test_as_of_against_brute_force(spark):
    import random

    random.seed(4)
    day = lambda: D.fromordinal(737000 + random.randrange(900))
    c = [(random.choice("ab"), "x", day(), i, float(i)) for i in range(200)]
    e = [(i, random.choice("abc"), day()) for i in range(300)]
    got = validity.join_as_of(
        spark.createDataFrame(e, "id long, entity string, at date"), changes(spark, c), ["entity"], "at", "d", "rid", ["rid"], bucket_days=30
    )
    want = []
    for i, k, t in e:
        known = [(d, r) for n, _, d, r, _ in c if n == k and d <= t]
        if known:
            want.append((i, max(known)[1]))
    assert sorted((r.id, r.rid) for r in got.collect()) == want


def test_history_null_is_a_value(spark):
    c = changes(spark, [
        ("a", "x", D(2020, 1, 1), 1, None), ("a", "x", D(2020, 1, 2), 2, None), ("a", "x", D(2020, 1, 3), 3, 0.0), ("a", "x", D(2020, 1, 4), 4, -0.0),
        ("a", "x", D(2020, 1, 5), 6, 2.0), ("a", "x", D(2020, 1, 5), 5, 9.0), ("a", "x", D(2020, 1, 6), 7, None), (None, "x", D(2020, 1, 6), 8, 1.0),
        ("z", "x", None, 9, 1.0), ("n", "x", D(2020, 1, 1), 10, float("nan")), ("n", "x", D(2020, 1, 2), 11, float("nan")),
    ])
    got = validity.history(c, ["entity"], "d", "rid", ["value"])
    rows = [(r.entity, r.value, str(r.valid_from), str(r.valid_to), r.is_current) for r in got.collect() if r.entity == "a"]
    assert sorted(rows, key=lambda r: r[2]) == [
        ("a", None, "2020-01-01", "2020-01-03", False), ("a", 0.0, "2020-01-03", "2020-01-05", False),
        ("a", 2.0, "2020-01-05", "2020-01-06", False), ("a", None, "2020-01-06", "9999-12-31", True),
    ]
    assert got.where("entity is null").count() == 1 and got.where("entity = 'z'").count() == 0 and got.where("entity = 'n'").count() == 1
    assert validity.history(changes(spark, []), ["entity"], "d", "rid", ["value", "other"]).count() == 0


def test_places_that_collide_lose_and_add_nothing(spark, monkeypatch):
    c = changes(spark, [(k, "x", D(2020, 1, 1 + n), n, float(n)) for n, k in enumerate("abcdefgh")])
    e = spark.createDataFrame([(1, "a", D(2020, 2, 1)), (2, "h", D(2020, 2, 1)), (3, "q", D(2020, 2, 1))], "id long, entity string, at date")
    monkeypatch.setattr(validity, "ASKED_PLACES", 2)
    got = validity.join_as_of(e, c, ["entity"], "at", "d", "rid", ["value"])
    assert sorted((r.id, r.value) for r in got.collect()) == [(1, 0.0), (2, 7.0)]


def test_equal_hashes_are_compared(spark, monkeypatch):
    from pyspark.sql import functions as F

    rows = [("a", "x", D(2020, 1, n), n, v) for n, v in enumerate([1.0, 1.0, 2.0, 2.0, None, None, 3.0], 1)]
    # Every hash collides: the values decide.
    monkeypatch.setattr(validity.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = sorted((str(r.valid_from), r.value) for r in validity.history(changes(spark, rows), ["entity"], "d", "rid", ["value"]).collect())
    assert got == [("2020-01-01", 1.0), ("2020-01-03", 2.0), ("2020-01-05", None), ("2020-01-07", 3.0)]
