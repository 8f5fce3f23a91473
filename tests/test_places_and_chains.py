"""Nearest places and chains against plain Python, and shared folders."""

import math
import random

import pytest

from terrane.operators import ownership, spatial


def degrees(a, b):
    """The distance of the docstring of scalars.degree_distance."""
    across = abs(a[0] - b[0])
    scale = max(math.cos(math.radians((a[1] + b[1]) / 2)), 0.15)
    return round(math.hypot(min(across, 360 - across) * scale, a[1] - b[1]), 9)


@pytest.mark.parametrize("n", [1, 3, 40, 400])
def test_nearest_places(spark, n):
    rng = random.Random(n)
    spot = lambda: (rng.choice([-180.0, 179.5, rng.uniform(-180, 180)]), rng.choice([89.0, -88.5, rng.uniform(-60, 85)]))
    places, points = [(k, *spot()) for k in range(n)], [(k, *spot()) for k in range(150)]
    if n == 40:  # all in one corner, so most points need several rounds
        places = [(k, 10 + k / 100, 5.0) for k in range(n)]
    got = spatial.nearest_place(spark.createDataFrame(points, "point_id long, plon double, plat double"), spark.createDataFrame(places, "id long, lon double, lat double")).collect()
    assert len(got) == len(points)
    for p, best, d in got:
        at = next(x[1:] for x in points if x[0] == p)
        want = min((degrees(at, x[1:]), x[0]) for x in places)
        assert abs(d - want[0]) < 2e-9 and abs(degrees(at, places[best][1:]) - want[0]) < 2e-9


def test_nearest_of_no_places(spark):
    points = spark.createDataFrame([(1, 2.0, 3.0)], "point_id long, plon double, plat double")
    assert spatial.nearest_place(points, spark.createDataFrame([], "id long, lon double, lat double")).count() == 0


def test_chains_of_any_length_and_cycles(spark):
    rows = [(0, None)] + [(k, k - 1) for k in range(1, 60)] + [(70, 71), (71, 72), (72, 70), (73, 70), (80, 99), (81, 81)]
    got = {r[0]: (r[1], r[2]) for r in ownership.vassal_chain(spark.createDataFrame(rows, "country_id int, vassal_of int")).collect()}
    assert all(got[k] == (0, k) for k in range(60))
    assert all(got[k] == (None, None) for k in (70, 71, 72, 73))
    assert got[80] == (80, 0) and got[81] == (81, 0)
