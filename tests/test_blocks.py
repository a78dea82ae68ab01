from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from terravane.operators import area_features, blocks, point_stats
from terravane.operators import radius_join as rj
from terravane.plans import catalog, files  # noqa: F401


def tables(spark, lat=(59.8, 60.0), lon=(30.1, 30.4), radius=2.0, n=600, m=25):
    draw = random.Random(11)
    points = [(i, draw.choice([None, *range(20)]), draw.uniform(*lat), draw.uniform(*lon)) for i in range(n)] + [(n, 1, None, 30.0)]
    queries = [(i, draw.uniform(*lat), draw.uniform(*lon), radius * draw.choice([0.4, 1.0])) for i in range(m)] + [(m, None, 30.0, 1.0), (m + 1, *points[0][2:], 0.0)]
    return spark.createDataFrame(queries, "query_idx long, qlat double, qlon double, radius double"), spark.createDataFrame(points, "id long, user_id long, lat double, lon double")


@pytest.mark.parametrize("place", [{}, {"lat": (89.0, 90.0), "lon": (-180, 180), "radius": 60.0}, {"lat": (-0.2, 0.2), "lon": (179.6, 180.0), "radius": 20.0}, {"lat": (-80, 80), "lon": (-180, 180), "radius": 2500.0}])
def test_parts_of_blocks_add_up_to_the_pairs(spark, monkeypatch, place):
    monkeypatch.setattr(blocks, "PART_POINTS", 40)
    monkeypatch.setattr(blocks, "TOGETHER", 3)
    q, p = tables(spark, **place)
    near = rj.radius_join(q, p, 2.0, "nested").withColumn("odd", F.col("id") % 2 == 1)
    want = {r[0]: tuple(r)[1:] for r in near.groupBy("query_idx").agg(F.count(F.lit(1)), F.count_distinct("user_id"), F.count_if("odd"), F.count_distinct(F.when(F.col("odd"), F.col("user_id"))), F.sum("id")).collect()}
    found = blocks.totals(q, p, q.agg(F.max("radius")).first()[0], "query_idx", {"n": F.lit(True), "odd": F.col("id") % 2 == 1}, "user_id", F.col("id"))
    got = {r["query_idx"]: (r["n"], r["_u_n"], r["odd"], r["_u_odd"], r["_sum"]) for r in found.where("_every > 0").collect()}
    assert got == want and want


def test_ids_near_a_query(spark, monkeypatch):
    q, p = tables(spark)
    want = {r[0]: r[1] for r in rj.radius_join(q, p, 2.0, "nested").groupBy("query_idx").agg(F.sort_array(F.collect_list("id"))).collect()}
    assert {r["query_idx"]: r["ids"] for r in blocks.id_lists(q, p, 2.0).collect()} == want


def test_repeated_keys_and_named_users_are_counted_by_the_join(spark):
    q, p = tables(spark)
    twice = q.unionByName(q)
    n = {r[0]: r[1] for r in rj.radius_join(q, p, 2.0, "nested").groupBy("query_idx").count().collect()}
    assert {(r["query_idx"], r["n"]) for r in point_stats.nearby_count(twice, p, 2.0).collect()} == {(r["query_idx"], 2 * n.get(r["query_idx"], 0)) for r in q.collect()}
    named = area_features.area_counts(q, p.withColumn("user_id", F.concat(F.lit("u"), "user_id")), 2.0)
    assert sorted(map(tuple, named.collect())) == sorted(map(tuple, area_features.area_counts(q, p, 2.0).collect()))


@pytest.mark.parametrize("name", ["area_counts", "area_features_70", "area_features_pointwise", "points_nearby_count", "venue_category_counts", "nearest_filtered"])
def test_no_pair_is_joined(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(rj, "radius_join", None)
    for module in (area_features, point_stats):
        monkeypatch.setattr(module, "radius_join", None)
    assert catalog.QUERIES[name](spark, sf_dir).columns


@pytest.mark.parametrize("name", ["near_ids", "search_file_join"])
def test_lists_are_made_without_joining_pairs(spark, sf_dir, name, monkeypatch):
    monkeypatch.setattr(rj, "radius_join", None)
    assert catalog.QUERIES[name](spark, sf_dir).columns


def test_a_search_file_in_several_files(spark, tmp_path):
    """A scan takes large files first, so the order of lines is that of names and places."""
    from terravane.sources import readers

    (tmp_path / "part-0.txt").write_text("3\n7 1.0 2.0\n")
    (tmp_path / "part-1.txt").write_text("8 1.0 2.001\n9 5.0 6.0\n\n1\n0.5\n")
    (tmp_path / "part-2.txt").write_text("1.0 2.0\n")
    points, queries = readers.read_search(spark, str(tmp_path))
    assert sorted(r["id"] for r in points.collect()) == [7, 8, 9] and [tuple(r) for r in queries.collect()] == [(0, 1.0, 2.0, 0.5)]


def test_queries_of_joins_have_no_nested_loop(spark, sf_dir):
    plan = catalog.QUERIES["radius_join_nested"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("place", [{}, {"lat": (89.0, 90.0), "lon": (-180, 180), "radius": 60.0}, {"lat": (-80, 80), "lon": (-180, 180), "radius": 2500.0}])
def test_blocks_are_joined_like_all_pairs(spark, place):
    q, p = tables(spark, **place)
    found, want = (sorted(map(tuple, rj.radius_join(q, p, place.get("radius", 2.0), s).select("query_idx", "id").collect())) for s in ("blocks", "nested"))
    assert found == want and want


def test_pairs_of_blocks_are_those_of_the_join(spark, monkeypatch):
    monkeypatch.setattr(blocks, "PART_PAIRS", 20_000)
    q, p = tables(spark)
    assert sorted(map(tuple, blocks.id_pairs(q, p, 2.0).collect())) == sorted(map(tuple, rj.radius_join(q, p, 2.0, "nested").select("query_idx", "id").collect()))


def test_lists_of_names_are_looked_up_once(spark):
    from terravane.sources import readers

    places = spark.createDataFrame([(i, ["Bar", "Cafe"] if i % 2 else ["Park"]) for i in range(50)] + [(50, []), (51, None)], "id long, categories_names array<string>")
    out = readers.with_category_ids(places, spark.createDataFrame([('"Bar"', "b"), ("Park", "p")], "name string, fullCategory string"))
    assert out.count() == 52 and {tuple(r["categories_ids"]) for r in out.collect()} == {("b", None), ("p",), ()}
    assert "_key" not in out._jdf.queryExecution().toString()
