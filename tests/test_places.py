"""Joins of places against plain loops."""

import random

import pytest

from lexloom.operators import places


def frame(spark, rows, schema, parts=3):
    return spark.createDataFrame(rows, schema).repartition(parts)


@pytest.mark.parametrize("width", [1, 10, 1024])
def test_intervals(spark, width):
    rng = random.Random(width)
    keys = [None, "a", "b", "hot", "hot", "hot"]
    at = [(rng.choice(keys), rng.choice([None, *range(300)]), i) for i in range(400)]
    spans = [(rng.choice(keys), s := rng.randint(0, 300), s + rng.choice([0, 1, 5, 40])) for _ in range(60)] + [("b", None, 5), ("b", 7, 3), ("b", 0, None)]
    held = lambda k, p: k is not None and p is not None and any(k == key and None not in (s, e) and s <= p < e for key, s, e in spans)
    left, right = frame(spark, at, "k string, pos int, id int"), frame(spark, spans, "k string, start int, end int")
    assert sorted(r.id for r in places.outside(left, right, "k", width=width).collect()) == [i for k, p, i in at if not held(k, p)]
    assert sorted(r.id for r in places.inside(left, right, "k", width=width).collect()) == [i for k, p, i in at if held(k, p)]


def nearest(rows, k, p, forward, strict):
    """The value of the nearest row, the largest of several at its position."""
    if k is None or p is None:
        return None
    ok = [(q, v) for key, q, v in rows if key == k and q is not None and ((q > p or (q == p and not strict)) if forward else (q < p or (q == p and not strict)))]
    if not ok:
        return None
    best = min(q for q, _ in ok) if forward else max(q for q, _ in ok)
    return max(v for q, v in ok if q == best)


@pytest.mark.parametrize("width", [1, 7, 1 << 16])
@pytest.mark.parametrize("forward", [False, True])
@pytest.mark.parametrize("strict", [False, True])
def test_as_of(spark, width, forward, strict):
    rng = random.Random(width)
    keys = [None, "a", "b", "hot", "hot", "hot", "left only"]
    left = [(rng.choice(keys), rng.choice([None, *range(-20, 200)]), i) for i in range(200)] + [("a", 5, 900), ("a", 5, 901)]
    right = [(rng.choice(keys[:-1]), rng.choice([None, *range(0, 180, 3)]), f"v{i:03d}") for i in range(70)]
    out = places.as_of(frame(spark, left, "k string, pos int, id int"), frame(spark, right, "k string, pos int, v string"), "k", {"v": "found"}, forward=forward, strict=strict, width=width)
    assert out.columns == ["k", "pos", "id", "found"]
    assert sorted((r.id, r.found) for r in out.collect()) == sorted((i, nearest(right, k, p, forward, strict)) for k, p, i in left)


def test_as_of_nothing(spark):
    left, right = frame(spark, [("a", 1)], "k string, pos int"), frame(spark, [], "k string, pos int, v int")
    assert [tuple(r) for r in places.as_of(left, right, "k", {"v": "found"}).collect()] == [("a", 1, None)]
    assert places.as_of(left.limit(0), right, "k", {"v": "found"}).count() == 0


def test_no_nested_loop(spark):
    left, right = frame(spark, [("a", 1)], "k string, pos int"), frame(spark, [("a", 1, 2)], "k string, start int, end int")
    plans = [places.outside(left, right, "k"), places.as_of(left, right.withColumnRenamed("start", "pos"), "k", {"end": "e"})]
    for df in plans:
        plan = df._jdf.queryExecution().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
