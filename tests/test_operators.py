from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import geo, osm, posts, times, trees
from terravane.operators import area_features, boosting, movement, point_stats, ranking, tiles, timeseries, venues

T0 = dt.datetime(2014, 11, 23, 10, 0, 0)


def at(ms: int) -> dt.datetime:
    return T0 + dt.timedelta(milliseconds=ms)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_edges_at_the_bounds(spark):
    own = "id long, user_id long, ts timestamp_ntz, cell long"
    minute = 60_000
    data = [
        (1, 1, at(0), 1), (2, 1, at(5 * minute), 2), (3, 1, at(10 * minute + 1), 3),
        (4, 2, at(0), 1), (5, 2, at(12 * 60 * minute), 2), (6, 3, at(0), 1), (7, 3, at(6 * minute), 1),
        (8, 4, at(0), 5), (9, 5, at(0), 1), (10, 5, at(599_999), 2), (11, None, at(0), 1), (12, None, at(6 * minute), 2), (13, 6, None, 1), (14, 6, at(0), 2),
    ]
    df = spark.createDataFrame(data, own)
    assert rows(movement.consecutive_edges(df).select("user_id", "src", "dst", "ms")) == [(1, 2, 3, 300_001), (5, 1, 2, 599_999)]
    assert rows(movement.minutes_graph(df)) == [(1, 2, 9.0), (2, 3, 5.0)]
    assert rows(movement.graph(movement.consecutive_edges(df).limit(0))) == []
    assert rows(movement.vertices(movement.consecutive_edges(df))) == [(1, 1.0), (2, 1.0), (3, 1.0)]
    three = spark.createDataFrame([(1, 1, at(0), 1), (2, 1, at(3 * 60 * minute), 2)], own)
    assert movement.minutes_graph(three).count() == 0 and movement.passages_graph(three).count() == 1


def test_equal_times_follow_ids(spark):
    df = spark.createDataFrame([(2, 1, at(0), 7), (1, 1, at(0), 5), (3, 1, at(400_000), 9)], "id long, user_id long, ts timestamp_ntz, cell long")
    assert rows(movement.consecutive_edges(df).select("src", "dst")) == [(7, 9)]


def test_parts_of_the_day_cover_it_once(spark):
    hours = spark.range(24).select(F.col("id").alias("h"), F.expr("timestamp_ntz'2020-01-01 00:00:00' + make_interval(0, 0, 0, 0, cast(id as int))").alias("ts"))
    for profile in (times.PROFILE_A, times.PROFILE_B):
        whole = next(n for n in profile if n.lower().startswith("all"))
        parts = [c.cast("int") for n, c in times.part_filters(F.col("ts"), profile).items() if n != whole]
        assert {r[0] for r in hours.select(sum(parts, F.lit(0))).collect()} == {1}


def test_seventy_features_of_an_empty_area(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0, 0.5), (2, 50.0, 50.0, 0.5)], "query_idx long, qlat double, qlon double, radius double")
    p = spark.createDataFrame([(7, T0, "iPhone", 0.0, 0.001), (7, T0, "foursquare", 0.0, 0.001), (None, T0, "Web", 0.0, 0.0)], "user_id long, ts timestamp_ntz, source string, lat double, lon double")
    out = {r["query_idx"]: r.asDict() for r in area_features.area_features(q, p, 0.5).collect()}
    assert len(out[1]) == 71 and set(list(out[2].values())[1:]) == {0}
    assert out[1]["AllDay_and_All"] == 3 and out[1]["unique_AllDay_and_All"] == 1 and out[1]["Morning_and_Apple"] == 1 and out[1]["Day_and_All"] == 0


def test_venue_ages_are_whole_days_in_long_arithmetic(spark):
    q = spark.createDataFrame([(1, 0.0, 0.0, 1.0), (2, 9.0, 9.0, 1.0)], "query_idx long, qlat double, qlon double, radius double")
    v = spark.range(30_000).select(F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.array(F.lit("m")).alias("categories"), F.lit(T0).cast("timestamp_ntz").alias("created"), F.lit(T0 + dt.timedelta(days=3, hours=20)).cast("timestamp_ntz").alias("seen"))
    assert rows(area_features.venue_features(q, v, 1.0, {"museum": "m", "none": "x"})) == [(1, 3, 30_000, 0), (2, 0, 0, 0)]


def test_category_tree_and_paths(spark):
    tree = spark.createDataFrame([([("a", [("b", [("c",)])]), ("z", [])],)], "categories array<struct<id: string, categories: array<struct<id: string, categories: array<struct<id: string>>>>>>")
    flat = venues.flatten_tree(tree)
    assert rows(flat) == [("a", None), ("b", "a"), ("c", "b"), ("z", None)]
    asked = spark.createDataFrame([("c",), ("z",), ("q",)], "id string")
    got = {r["id"]: (r["path"], r["main"]) for r in venues.category_paths(asked, flat).collect()}
    assert got == {"c": (["c", "b", "a"], "a"), "z": (["z"], "z"), "q": (["q", "?"], "?")}
    with pytest.raises(ValueError):
        venues.category_paths(spark.createDataFrame([("x",)], "id string"), spark.createDataFrame([("x", "y"), ("y", "x")], "id string, parent_id string"))
    v = spark.createDataFrame([(1, ["c", "q"]), (2, [])], "id long, categories array<string>")
    assert rows(venues.with_paths(v, venues.category_paths(asked, flat)).select("id", "category_paths")) == [(1, [["c", "b", "a"], ["q", "?"]]), (2, None)]


@pytest.mark.parametrize("fraction", [0.0, 0.01, 0.25, 1.0])
def test_robots_threshold_is_the_kth_largest(spark, fraction):
    values = [int(x) for x in np.random.default_rng(1).integers(0, 3000, 500)] + [9, 9, 9]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "f long")
    k = max(1, math.floor(504 * fraction))
    got = point_stats.robots_threshold(df, "f", fraction).first()[0]
    assert got == (sorted(values, reverse=True)[k - 1] if k <= len(values) else None)
    assert point_stats.robots_threshold(df.limit(0), "f", 0.1).first()[0] is None


def test_squares_include_their_sides(spark):
    q = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0)], "query_idx long, qlat double, qlon double")
    p = spark.createDataFrame([(1.0, 1.25), (0.75, 0.75), (1.0, 1.26)], "lat double, lon double")
    assert rows(point_stats.box_count(q, p, 0.25)) == [(1, 2), (2, 0)]


def test_upsert_keeps_what_a_newer_row_leaves_out(spark):
    old = spark.createDataFrame([(1, 1, "a", 5), (2, 1, "b", None)], "_id long, _timestamp long, name string, n long")
    new = spark.createDataFrame([(1, 2, None, 6), (3, 2, "c", None)], "_id long, _timestamp long, name string, n long")
    assert rows(timeseries.upsert(old, new, "_id", "_timestamp").select("_id", "name", "n")) == [(1, "a", 6), (2, "b", None), (3, "c", None)]
    assert rows(timeseries.last_write(old.unionByName(new), "_id", "_timestamp").select("_id", "name", "n")) == [(1, None, 6), (2, "b", None), (3, "c", None)]


@pytest.mark.parametrize("size,day,n", [(7, 6, 7), (31, 23, 31), (356, 327, 366)])
def test_periods_are_filled_with_zeros(spark, size, day, n):
    df = spark.createDataFrame([(1, T0), (1, T0)], "id long, ts timestamp_ntz")
    got = timeseries.period_map(timeseries.period_counts(df, "id", "ts", size), "id", size).first()
    assert len(got["days"]) == n and got["days"][day] == 2 and sum(got["days"].values()) == 2
    assert got["period"] == {7: "2014-11-17", 31: "2014-11-01", 356: "2014-01-01"}[size]


def test_unknown_period(spark):
    with pytest.raises(ValueError):
        times.day_of_period(F.lit(T0), 8)


def test_tiles_cover_the_box_and_quarters_cover_tiles(spark):
    box = geo.Box(59.829833, 30.178096, 60.029015, 30.520594)
    grid = tiles.tiles(spark, 0.75, box)
    side = grid.select(geo.distance_km(F.col("left_lat"), F.col("left_lon"), F.col("left_lat"), F.col("right_lon")).alias("x"), geo.distance_km(F.col("left_lat"), F.col("left_lon"), F.col("right_lat"), F.col("left_lon")).alias("y"))
    assert all(abs(r["x"] - 0.75) < 0.01 and abs(r["y"] - 0.75) < 0.01 for r in side.collect())
    far = grid.agg(F.max("right_lat"), F.max("right_lon")).first()
    assert far[0] >= box.max_lat and far[1] >= box.max_lon
    assert tiles.tiles(spark, 0.75, box, compat=True).count() > grid.count()
    quarters = tiles.quadrants(grid.limit(1))
    assert rows(quarters.select("part"))[0] == ("a",) and quarters.select("r").distinct().count() == 1
    assert quarters.agg(F.max("right_lat") - F.min("left_lat")).first()[0] == pytest.approx(grid.limit(1).select(F.col("right_lat") - F.col("left_lat")).first()[0])


def test_swapped_sides_are_put_right(spark):
    area = spark.createDataFrame([(1.0, 2.0, 9.0, 5.0)], "south double, north double, west double, east double")
    assert rows(tiles.split_area(area, 2, False).select("part", "west", "east")) == [(0, 5.0, 7.0), (1, 7.0, 9.0)]


def test_tag_policy_and_categories(spark):
    tags = [("amenity", "bench", False), ("amenity", "cafe", True), ("highway", "primary", False), ("highway", "bus_stop", True), ("charge", "yes", False), ("name", "x", True), ("name", None, False)]
    df = spark.createDataFrame(tags, "k string, v string, want boolean")
    assert df.where(osm.accepted(F.col("k"), F.col("v")) != F.col("want")).count() == 0
    keys = list(osm.RULES)
    place = spark.createDataFrame([tuple({"amenity": "language school", "shop": "beauty", "tourism": "museum"}.get(k) for k in keys), tuple(None for _ in keys)], ", ".join(f"{k} string" for k in keys))
    assert [r[0] for r in place.select(osm.categories()).collect()] == [["Arts & Entertainment", "Museum", "College & University", "Shop & Service"], []]


def test_source_order_matters(spark):
    df = spark.createDataFrame([("for Android Web",), ("instagram",), ("INSTAGRAM",), (None,)], "s string")
    assert [r[0] for r in df.select(posts.source_class(F.col("s"))).collect()] == ["Web", "instagram", "other", "other"]


LISTS = "query_id long, doc_id long, target double, prediction double"


def test_ndcg_of_a_perfect_order_is_one(spark):
    df = spark.createDataFrame([(1, i, float(i), float(i)) for i in range(5)] + [(2, 0, 1.0, 2.0), (2, 1, 2.0, 1.0)], LISTS)
    got = {r["query_id"]: r["ndcg"] for r in ranking.ndcg(df, 10, ties=("doc_id",)).collect()}
    gain = [2**1.0 - 1, 2**0.5 - 1]
    assert got[1] == pytest.approx(1) and got[2] == pytest.approx((gain[1] + gain[0] / math.log2(3)) / (gain[0] + gain[1] / math.log2(3)))


@pytest.mark.parametrize("kind", ["equal", "rank", "diff", "ndcg"])
def test_weights_sum_to_one(spark, kind):
    df = spark.createDataFrame([(q, i, float(i % 3), 0.0) for q in range(3) for i in range(5)], LISTS)
    got = ranking.pair_weights(df, kind).groupBy("query_id").agg(F.sum("w").alias("s"), F.min("w").alias("m")).collect()
    assert all(r["s"] == pytest.approx(1) and r["m"] > 0 for r in got) and len(got) == 3


def test_kappa(spark):
    agree = spark.createDataFrame([(0, 0), (1, 1), (2, 2)], "real int, predicted int")
    assert ranking.kappa(agree).first()[0] == pytest.approx(1)
    half = spark.createDataFrame([(0, 0), (0, 1), (1, 0), (1, 1)], "real int, predicted int")
    assert ranking.kappa(half).first()[0] == pytest.approx(0)
    assert ranking.kappa(agree.limit(0)).first()[0] is None


def test_means_and_levels(spark):
    df = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],)], "v array<double>")
    means = ranking.position_means(df, "v")
    assert rows(means) == [(0, 2.0), (1, 5.0)] and ranking.best_position(means).first()["position"] == 1
    assert rows(ranking.feature_levels(df.withColumnRenamed("v", "features"))) == [(0, 2), (1, 1)]
    assert [r[0] for r in df.select(ranking.row_means(df, "v")).collect()] == [3.0, 4.0]


def test_trees(spark):
    tree = trees.ObliviousTree((0, 1), (1.0, 1.0), (10.0, 20.0, 30.0, 40.0))
    df = spark.createDataFrame([([1.0, 1.0],), ([2.0, 1.0],), ([1.0, 2.0],), ([2.0, 2.0],)], "x array<double>")
    assert [r[0] for r in df.select(tree.value(F.col("x"))).collect()] == [10, 20, 30, 40]
    model = trees.Ensemble((tree, tree), 0.5)
    assert df.select(model.staged(F.col("x"))).first()[0] == [5.0, 10.0] and df.select(model.staged(F.col("x"), raw_first=True)).first()[0] == [10.0, 15.0]
    assert df.select(model.score(F.col("x"))).first()[0] == 10.0


def test_borders():
    assert boosting.median_borders(np.array([3.0, 1, 1, 2]), 16) == [1.0, 2.0]
    many = boosting.median_borders(np.arange(100.0), 4)
    assert len(many) == 4 and many == sorted(many) and 45 <= many[len(many) // 2] <= 76


def brute_tree(x, target, weights, borders, depth):
    """The same tree from whole matrices."""
    n = len(x)
    v, m = np.zeros(n), np.zeros((n, n))
    for i in range(n):
        for j in range(n):
            if weights[i, j]:
                g = weights[i, j] / (math.exp(target[i] - target[j]) + 1)
                v[i] -= g
                v[j] += g
                m[i, i] += weights[i, j]
                m[j, j] += weights[i, j]
                m[i, j] -= weights[i, j]
                m[j, i] -= weights[i, j]
    leaf, used, out = np.zeros(n, int), [], []
    for level in range(depth):
        best = None
        for f, ts in enumerate(borders):
            for t in ts if f not in used else []:
                own = leaf + (x[:, f] > t) * (1 << level)
                z = np.eye(1 << (level + 1))[own]
                c, s = boosting.solved(z.T @ m @ z, z.T @ v)
                if best is None or (round(s, 12), f, t) < best[:3]:
                    best = (round(s, 12), f, t, c, own)
        used.append(best[1])
        leaf = best[4]
        out.append(best[1:4])
    return [o[0] for o in out], [o[1] for o in out], out[-1][2]


def test_a_grown_tree_equals_the_one_from_whole_matrices(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(24, 4))
    target = 2 * x[:, 1] - x[:, 3] + 0.1 * draw.normal(size=24)
    docs = spark.createDataFrame([(1, i, x[i].tolist(), float(target[i])) for i in range(24)], "query_id long, doc_id long, features array<double>, target double")
    weights = ranking.pair_weights(docs)
    w = np.zeros((24, 24))
    for r in weights.collect():
        w[r["i"], r["j"]] = r["w"]
    borders = boosting.split_candidates(docs, 4, 8)
    assert borders == [boosting.median_borders(x[:, f], 8) for f in range(4)]
    tree = boosting.grow_tree(docs, boosting.gradients(docs.withColumn("score", F.lit(0.0)), weights), borders, 2)
    features, thresholds, leaves = brute_tree(x, np.zeros(24), w, borders, 2)
    assert list(tree.features) == features and list(tree.thresholds) == pytest.approx(thresholds) and list(tree.leaves) == pytest.approx(leaves.tolist(), abs=1e-6)


def test_borders_of_many_rows_are_the_exact_ones(spark):
    skewed = spark.range(100_001).select(F.array((F.col("id") % 10 > 0).cast("double"), (F.col("id") * 7919 % 1000).cast("double")).alias("features"))
    values = [[float(i % 10 > 0) for i in range(100_001)], [float(i * 7919 % 1000) for i in range(100_001)]]
    borders = boosting.split_candidates(skewed, 2, 4)
    assert borders[0] == [0.0] and borders == [boosting.median_borders(np.array(v), 4) for v in values]


def test_boosting_learns_and_validates(spark):
    draw = np.random.default_rng(5)
    x = draw.normal(size=(40, 3))
    docs = spark.createDataFrame([(1, i, x[i].tolist(), float(x[i, 0])) for i in range(40)], "query_id long, doc_id long, features array<double>, target double")
    model = boosting.fit(docs, boosting.Settings(iterations=3, step=0.5, depth=2, levels=6))
    stages = {r["iteration"]: r["ndcg"] for r in boosting.staged_ndcg(docs, model).collect()}
    assert set(stages) == {1, 2, 3} and stages[3] > 0.9 and all(0 < v <= 1 + 1e-9 for v in stages.values())
    shaken = boosting.fit(docs, boosting.Settings(iterations=1, depth=1, levels=4, bootstrap=True))
    assert len(shaken.trees) == 1
    found = boosting.cross_validate(spark, docs, boosting.Settings(iterations=1, depth=1, levels=4), rounds=2, test_share=0.5, test_queries=3, size=8)
    assert {(r["round"], r["iteration"]) for r in found.collect()} == {(1, 1), (2, 1)}


def test_samples_and_folds_repeat(spark):
    docs = spark.range(50).withColumnRenamed("id", "doc_id")
    a, b = (rows(boosting.sampled_queries(docs, 3, 5, 7)) for _ in range(2))
    assert a == b and len(a) == 15
    assert rows(boosting.folds(docs, 2, 0.3, 1)) == rows(boosting.folds(docs, 2, 0.3, 1))
    assert rows(ranking.shuffled(docs, "doc_id", 1)) != rows(ranking.shuffled(docs, "doc_id", 2))
