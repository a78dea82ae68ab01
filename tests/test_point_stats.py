from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from terravane.operators import point_stats


@pytest.mark.parametrize("few", [4, 1 << 14])
def test_selection_equals_sorting(spark, monkeypatch, few):
    monkeypatch.setattr(point_stats, "FEW", few)
    monkeypatch.setattr(point_stats, "BINS", 8)
    draw = random.Random(3)
    lists = [[draw.randint(-50, 50) for _ in range(300)], [7] * 200 + [1, 9], [draw.randint(-(1 << 62), 1 << 62) for _ in range(60)], [int(10 ** draw.uniform(0, 12)) for _ in range(200)], [5]]
    for own in lists:
        df = spark.createDataFrame([(v,) for v in [*own, None, None]], "v long").repartition(3)
        for k in {1, min(2, len(own)), max(1, len(own) // 2), len(own)}:
            assert point_stats.kth_largest(df, "v", k) == sorted(own, reverse=True)[k - 1]
        assert point_stats.kth_largest(df, "v", len(own) + 1) is None and point_stats.kth_largest(df, "v", 0) is None


def test_selection_of_doubles(spark, monkeypatch):
    monkeypatch.setattr(point_stats, "FEW", 3)
    own = [1e300, -1e300, 0.0, 1e-320, 2.5, 2.5, 2.5, math.inf, -math.inf, -math.inf, math.pi, 1e-5]
    df = spark.createDataFrame([(v,) for v in [*own, math.nan, None]], "v double")
    assert math.isnan(point_stats.kth_largest(df, "v", 1))
    assert [point_stats.kth_largest(df, "v", k + 2) for k in range(len(own))] == sorted(own, reverse=True)
    assert point_stats.kth_largest(df, "v", 14) is None and point_stats.kth_largest(df.limit(0), "v", 1) is None


def test_threshold_of_empty_and_single_tables(spark):
    df = spark.createDataFrame([(5,), (None,), (9,)], "f int")
    assert point_stats.robots_threshold(df, "f", 0.5).collect()[0]["threshold"] == 9
    assert point_stats.robots_threshold(df.limit(0), "f", 0.5).collect()[0]["threshold"] is None


def test_nearest_equals_all_distances(spark):
    draw = random.Random(4)
    points = [(i, 60 + draw.gauss(0, 0.02), 30 + draw.gauss(0, 0.04)) for i in range(400)] + [(1000 + i, 60.001, 30.002) for i in range(30)] + [(2000, None, 30.0), (2001, 10.0, 10.0)]
    queries = [(i, 60 + draw.gauss(0, 0.03), 30 + draw.gauss(0, 0.06)) for i in range(20)] + [(50, 60.001, 30.002), (51, 0.0, 0.0), (52, None, 1.0)]

    def km(a, b):
        x = math.sin(math.radians(a[1])) * math.sin(math.radians(b[1])) + math.cos(math.radians(a[1])) * math.cos(math.radians(b[1])) * math.cos(math.radians(a[2] - b[2]))
        return 6378 * math.acos(max(-1, min(1, x)))

    q, p = spark.createDataFrame(queries, "query_idx long, qlat double, qlon double"), spark.createDataFrame(points, "id long, lat double, lon double").repartition(3)
    for first in (0.05, None, 9.0):
        found = {}
        for r in point_stats.nearest(q, p, 7, 3.0, first).collect():
            found.setdefault(r["query_idx"], []).append((r["rank"], r["id"]))
        for own in queries:
            want = sorted((round(km(own, x), 9), x[0]) for x in points if None not in (*own, *x) and km(own, x) < 3.0)[:7]
            assert [i for _, i in sorted(found.get(own[0], []))] == [i for _, i in want], own
    assert point_stats.nearest(q.limit(0), p, 7, 3.0).count() == 0 and point_stats.nearest(q, p.limit(0), 7, 3.0).count() == 0
