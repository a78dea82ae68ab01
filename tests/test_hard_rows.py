"""Nulls in any column, ties, repeated rows, empty tables and extra columns, for the operators over points and lists."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from terravane.functions import geo, times
from terravane.operators import area_features, boosting, movement, point_stats, ranking, tiles, timeseries, venues
from terravane.operators import radius_join as rj

POSTS = "id long, user_id long, ts timestamp_ntz, source string, lat double, lon double, cell long"
QUERIES = "query_idx long, qlat double, qlon double, radius double"
T = dt.datetime(2020, 1, 1, 12)


@pytest.fixture
def posts(spark):
    good = (1, 1, T, "Web", 1.0, 1.0, 5)
    rows = [good, good] + [tuple(None if i == k else v for i, v in enumerate(good)) for k in range(len(good))] + [(None,) * 7]
    return spark.createDataFrame(rows, POSTS)


@pytest.fixture
def queries(spark):
    good = (1, 1.0, 1.0, 0.5)
    return spark.createDataFrame([good] + [tuple(None if i == k else v for i, v in enumerate(good)) for k in range(1, 4)], QUERIES)


def test_joins_of_nulls_and_repeated_rows(posts, queries):
    cell, nested = (rj.radius_join(queries, posts, 0.5, s).count() for s in ("cell", "nested"))
    assert cell == nested == 7
    out = area_features.area_counts(queries.limit(1), posts, 0.5).first()
    assert (out["n"], out["users"]) == (7, 1)
    assert point_stats.nearby_count(queries.limit(1), posts, 0.5).first()["n"] == 7


def test_empty_tables(spark, posts, queries):
    none, nobody = posts.limit(0), queries.limit(0)
    assert rj.radius_join(queries, none, 0.5).count() == rj.radius_join(nobody, posts, 0.5).count() == 0
    assert area_features.area_features(nobody, posts, 0.5).count() == 0
    assert {r["n"] for r in area_features.area_counts(queries, none, 0.5).collect()} == {0}
    assert movement.passages_graph(none).count() == movement.vertices(movement.consecutive_edges(none)).count() == 0
    assert timeseries.period_map(timeseries.period_counts(none, "user_id", "ts", 7), "user_id", 7).count() == 0
    assert timeseries.upsert(none, none, "id", "ts").count() == timeseries.last_write(none, "id", "ts").count() == 0
    lists = spark.createDataFrame([], "query_id long, doc_id long, target double, prediction double, features array<double>")
    assert ranking.ndcg(lists).count() == ranking.pair_weights(lists).count() == ranking.feature_levels(lists).count() == 0
    assert boosting.fit(lists, boosting.Settings(iterations=1)).trees[0].features == ()
    assert rj.expanded_box(nobody, geo.Box(0, 0, 1, 1)).first()["min_lat"] == 0
    assert tiles.refine(none, geo.Box(0, 0, 1, 1), 2, 5).collect()[0]["n"] == 0
    empty = spark.createDataFrame([], "id string, parent_id string")
    assert venues.category_paths(empty.select("id"), empty).count() == 0


def test_movement_skips_nulls_and_takes_repeats(posts):
    assert movement.consecutive_edges(posts).count() == 0


def test_a_user_with_many_posts_over_many_spans(spark):
    hour = dt.timedelta(hours=1)
    rows = [(i, 1, T + 5 * i * hour, "Web", 0.0, 0.0, i % 3) for i in range(200)] + [(i, 2, T + 13 * i * hour, "Web", 0.0, 0.0, i % 3) for i in range(50)]
    out = movement.consecutive_edges(spark.createDataFrame(rows, POSTS)).groupBy("user_id").count().collect()
    assert {r["user_id"]: r["count"] for r in out} == {1: 199}


def test_ties_share_ranks_and_have_no_pairs(spark):
    lists = spark.createDataFrame([(1, i, 5.0, 1.0) for i in range(4)] + [(2, 0, None, None)], "query_id long, doc_id long, target double, prediction double")
    assert {r["rank"] for r in ranking.dense_ranks(lists).collect()} == {1}
    assert ranking.pairs(lists).count() == 0 and ranking.ndcg(lists, ties=("doc_id",)).where("query_id = 1").first()["ndcg"] == pytest.approx(1)


def test_extra_columns_pass_through(spark, posts, queries):
    more = queries.limit(1).withColumns({"n": F.lit(1), "users": F.lit(2)})
    assert area_features.area_counts(more, posts, 0.5).columns == ["query_idx", "n", "users"]


def test_part_names_of_null_times(posts):
    got = posts.where("ts is null").select(times.part_name(F.col("ts"), times.PROFILE_A).alias("p")).distinct().collect()
    assert [r["p"] for r in got] == [None]


def test_upsert_of_nulls(spark):
    df = spark.createDataFrame([(None, 1, "a"), (1, None, "b"), (1, 2, None)], "k long, t long, v string")
    assert sorted(map(tuple, timeseries.upsert(df.limit(0), df, "k", "t").select("k", "t").collect()), key=repr) == [(1, 2), (None, 1)]
