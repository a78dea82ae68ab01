from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import radius_join as rj

POINTS, QUERIES = "id long, lat double, lon double", "query_idx long, qlat double, qlon double, radius double"


def frames(spark, seed, lat, lon, radius, n=400, m=40):
    draw = random.Random(seed)
    points = [(i, draw.uniform(*lat), draw.uniform(*lon)) for i in range(n)] + [(n, None, 1.0), (n + 1, 1.0, None)]
    queries = [(i, draw.uniform(*lat), draw.uniform(*lon), float(radius * draw.choice([0.3, 1, 1]))) for i in range(m)] + [(m, None, 1.0, 1.0), (m + 1, *points[0][1:], 0.0), (m + 2, *points[1][1:], float(radius))]
    return spark.createDataFrame(points, POINTS), spark.createDataFrame(queries, QUERIES)


def pairs(df):
    return sorted(map(tuple, df.select("query_idx", "id").collect()))


@pytest.mark.parametrize(
    "lat,lon,radius",
    [((59.8, 60.1), (30.1, 30.6), 0.5), ((-34.1, -33.9), (151, 151.3), 2), ((-0.1, 0.1), (-0.1, 0.1), 3), ((10, 10.5), (179.7, 180), 20), ((-18, -17.5), (-180, -179.6), 30), ((88.5, 90), (-180, 180), 60), ((-90, -89), (-180, 180), 40), ((-80, 80), (-180, 180), 2500), ((0, 1), (-180, 180), 9000)],
)
@pytest.mark.parametrize("small", [True, False])
def test_cells_find_what_the_nested_join_finds(spark, lat, lon, radius, small):
    points, queries = frames(spark, 42, lat, lon, radius)
    cell = pairs(rj.radius_join(queries, points, radius, small_queries=small))
    assert cell == pairs(rj.radius_join(queries, points, radius, "nested"))
    assert cell and not [q for q, _ in cell if q in (40, 41)]


def test_circles_across_the_date_line(spark):
    points = spark.createDataFrame([(1, 0.0, 179.999), (2, 0.0, -179.999)], POINTS)
    queries = spark.createDataFrame([(1, 0.0, -179.9995, 1.0)], QUERIES)
    assert pairs(rj.radius_join(queries, points, 1.0)) == [(1, 1), (1, 2)]


def test_box_sides_are_exclusive(spark):
    points = spark.createDataFrame([(1, 1.0, 1.5), (2, 1.5, 1.5), (3, 2.0, 1.5), (4, None, 1.5)], POINTS)
    assert [r[0] for r in points.where(geo.Box(1, 1, 2, 2).contains()).select("id").collect()] == [2]


def test_cells_are_cut_towards_zero(spark):
    got = spark.createDataFrame([(1, -0.0019, 0.0029), (2, 59.9391, 30.3159)], POINTS).select(geo.area_cell()).collect()
    assert [r[0] for r in got] == [-1 + 2 * 10_000_000, 59939 + 30315 * 10_000_000]


def test_distance_of_a_point_to_itself_is_zero(spark):
    got = spark.createDataFrame([(1, 59.93, 30.31)], POINTS).select(geo.distance_km(F.col("lat"), F.col("lon"), F.col("lat"), F.col("lon"))).first()[0]
    assert got == 0 or got < 1e-3


def test_shuffled_join_has_no_nested_loop(spark):
    points, queries = frames(spark, 1, (59, 60), (30, 31), 1.0)
    plan = rj.radius_join(queries, points, 1.0, small_queries=False)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
