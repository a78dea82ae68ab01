from __future__ import annotations

import datetime as dt
import gzip
import json

import pytest
from pyspark.sql import functions as F

from terravane.functions import geo, osm
from terravane.operators import radius_join as rj
from terravane.operators import tiles
from terravane.sources import readers, writers
from terravane.streaming import posts as stream


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture
def put(tmp_path):
    def write(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    return write


def test_posts_whatever_the_order_of_their_fields(spark, put):
    path = put("p.json", "\n".join([
        '{"_id":1,"certain_coords":1,"created_at":1416740400000,"geo":{"type":"Point","coordinates":[30.31,59.93]},"source":"iPhone","text":"x","user":{"id":7,"more":1}}',
        '{"user":{"id":8},"source":"Web","geo":{"coordinates":[30.0,60.0],"type":"Point"},"created_at":1416740400000,"certain_coords":0,"_id":2}',
        '{"_id":3,"certain_coords":1,"created_at":1416740400000,"geo":{"type":"Point","coordinates":[1.0,2.0]}}',
    ]))
    got = readers.read_posts(spark, path).orderBy("id").collect()
    assert [(r["id"], r["user_id"], r["lat"], r["lon"], r["source"]) for r in got] == [(1, 7, 59.93, 30.31, "iPhone"), (3, None, 2.0, 1.0, None)]
    assert got[0]["ts"] == dt.datetime(2014, 11, 23, 11, 0) and readers.read_posts(spark, path, exact_only=False).count() == 3


def test_venues_take_all_paths(spark, put):
    path = put("v.json", '{"_id":"a","_geo":[30.0,60.0],"_categoryIds":[["x","y"],["z"]],"_timestamp":1400000000.5,"createdAt":1300000000}\n{"_id":"b","_geo":[1,2],"_categoryIds":[]}')
    got = readers.read_venues(spark, path).orderBy("id").collect()
    assert got[0]["categories"] == ["x", "y", "z"] and got[0]["lat"] == 60.0 and got[0]["seen"].timestamp() == 1400000001
    assert got[1]["categories"] == [] and got[1]["seen"] is None


def test_points_with_and_without_radius(spark, put):
    path = put("q.tsv", "1.5\t2.5\n3\t4\t0.75\nbad\n1\tx\n1\t2\t3\t4\n")
    assert rows(readers.read_points(spark, path).select("qlat", "qlon", "radius")) == [(1.5, 2.5, 0.5), (3.0, 4.0, 0.75)]
    assert len(rows(readers.rejects(spark, path))) == 3


def test_search_file(spark, put):
    path = put("s.txt", "2\n7 1.0 2.0\n8 1.0 2.001\n1\n0.5\n1.0 2.0\n")
    points, queries = readers.read_search(spark, path)
    assert rows(points) == [(7, 1.0, 2.0), (8, 1.0, 2.001)] and rows(queries) == [(0, 1.0, 2.0, 0.5)]
    got = writers.near_json(rj.radius_join(queries, points, 0.5)).first()["value"]
    assert json.loads(got) == {"lat": 1.0, "lon": 2.0, "ids": [7, 8]}
    same_line = put("s2.txt", "1\n7 1.0 2.0\n1 0.5\n1.0 2.0\n")
    assert rows(readers.read_search(spark, same_line)[1]) == [(0, 1.0, 2.0, 0.5)]


def test_ranking_files(spark, put):
    got = readers.read_matrix(spark, put("m", "2 3\n1 2 3 -1\n4 5 6 -2\n")).orderBy("doc_id").collect()
    assert [(r["features"], r["target"]) for r in got] == [([1.0, 2.0, 3.0], -1.0), ([4.0, 5.0, 6.0], -2.0)]
    assert readers.read_matrix(spark, put("t", "1 2 3 -1\n"), header=False).count() == 1
    docs, pairs = readers.read_ranking_queries(spark, put("r", "2 2\n2\n1 2 0.5\n3 4 0.25\n0 1\n0 0\n1\n9 9 1\n0\n"))
    assert rows(docs) == [(0, 0, [1.0, 2.0], 0.5), (0, 1, [3.0, 4.0], 0.25), (1, 0, [9.0, 9.0], 1.0)] and rows(pairs) == [(0, 0, 1, 1.0)]


NODES = """<osm><node id="1" lat="59.9" lon="30.3"><tag k="amenity" v="cafe"/><tag k="name" v="A"/><tag k="name" v="B"/></node>
<node id="2" lat="59.9" lon="30.3"/><node id="3" lat="59.9" lon="30.3"><tag k="amenity" v="bench"/><tag k="charge" v="1"/></node>
<node id="4" lat="59.8" lon="30.2"><tag k="highway" v="bus_stop"/><tag k="network" v="N"/></node><way id="9"><tag k="shop" v="x"/></way></osm>"""


def test_map_nodes_through_places_and_back(spark, put, tmp_path):
    nodes = readers.read_nodes(spark, put("n.xml", NODES))
    got = {r["id"]: r for r in nodes.collect()}
    assert set(got) == {"1", "4"} and got["1"]["name"] == "B" and nodes.columns == list(osm.COLUMNS)
    places = readers.places_of(nodes)
    ids = spark.createDataFrame([('"Food"', "f0"), ("Cafe", "f1")], "name string, fullCategory string")
    found = {r["id"]: r for r in readers.with_category_ids(places, ids).collect()}
    assert found["1"]["categories_names"] == ["Food", "Cafe"] and found["1"]["categories_ids"] == ["f0", "f1"]
    assert found["4"]["categories_ids"] == [None, None] and found["4"]["operator"] == "N"
    writers.write_nodes(nodes, str(tmp_path / "csv"))
    back = readers.read_node_csv(spark, str(tmp_path / "csv"))
    assert rows(back.select("id", "name", "shop")) == [("1", "B", None), ("4", None, None)]
    assert rows(readers.coordinates_of(back)) == [(30.2, 59.8), (30.3, 59.9)]


RAW = {"id": 5, "text": "t", "retweet_count": 1, "favorite_count": 0, "source": "Twitter Web for Android", "created_at": "Sun Nov 23 10:00:00 +0000 2014", "geo": None,
       "user": {"id": 7, "followers_count": 3, "friends_count": 1, "listed_count": 0, "favourites_count": 0, "created_at": "Mon Jan 06 00:00:00 +0000 2014"},
       "place": {"id": "p", "url": "u", "bounding_box": {"coordinates": [[[30.0, 59.0], [31.0, 59.0], [31.0, 60.0], [30.0, 60.0]]]}}, "entities": {"hashtags": [], "urls": []}}


def test_raw_posts_from_packed_lines(spark, tmp_path):
    exact = RAW | {"id": 6, "geo": {"coordinates": [59.5, 30.25]}, "place": None, "source": "instagram", "entities": {"hashtags": [], "urls": [{"expanded_url": "http://x"}]}}
    nowhere = RAW | {"id": 8, "place": None}
    with gzip.open(tmp_path / "raw.gz", "wt") as f:
        f.write("\n".join(json.dumps(x) for x in (RAW, exact, nowhere)))
    got = {r["_id"]: r for r in readers.read_raw_posts(spark, str(tmp_path / "raw.gz"), 2).collect()}
    assert (got[5]["lat"], got[5]["lon"], got[5]["certain_coords"], got[5]["source"], got[5]["user"]["id"]) == (59.5, 30.5, 0, "Web", 7)
    assert (got[6]["lat"], got[6]["lon"], got[6]["certain_coords"], got[6]["url"], got[6]["user"]["id"]) == (59.5, 30.25, 1, "http://x", None)
    assert got[8]["lat"] is None and got[5]["created_at"] == dt.datetime(2014, 11, 23, 10, 0)


def test_shell_json_by_days(spark, put, tmp_path):
    path = put("shell", '{"_id" : NumberLong(5), "created_at" : Date( 1400000000000 )}\n{"_id" : NumberLong("6"), "created_at" : Date( 1400100000000 )}')
    df = readers.read_shell_json(spark, path, "_id long, created_at long")
    assert rows(df.select("_id", "dt")) == [(5, "2014-05-13"), (6, "2014-05-14")]
    out = str(tmp_path / "days")
    writers.write_days(df.select("_id", "created_at"), out, F.col("created_at"), compression="gzip")
    writers.write_days(df.select("_id", "created_at"), out, F.col("created_at"), compression="gzip")
    kept = readers.read_days(spark, out, "2014-05-14", "2014-06-01", "_id long, created_at long")
    assert rows(kept.select("_id")) == [(6,), (6,)]
    writers.merge_days(kept, str(tmp_path / "merged"))
    assert spark.read.json(str(tmp_path / "merged")).count() == 2


def test_older_posts_in_the_present_form(spark):
    old = spark.createDataFrame([(1, ("Point", [59.0, 30.0]), 1400000000)], "_id long, geo struct<type: string, coordinates: array<double>>, created_at long")
    got = readers.reversed_posts(old).first()
    assert got["geo"]["coordinates"] == [30.0, 59.0] and got["created_at"].timestamp() == 1400000000


def test_saving_documents_is_an_upsert(spark, tmp_path):
    path = str(tmp_path / "store")
    frame = lambda data: spark.createDataFrame(data, "_id long, _timestamp long, a string, b long")
    writers.save_documents(spark, frame([(1, 1, "x", 1), (1, 2, "y", 2)]), path)
    writers.save_documents(spark, frame([(1, 3, None, 9), (2, 3, "n", None)]), path, by_field=True)
    assert rows(writers.saved(spark, path).select("_id", "a", "b")) == [(1, "y", 9), (2, "n", None)]
    writers.save_documents(spark, frame([(1, 4, None, 7)]), path)
    assert rows(writers.saved(spark, path).select("_id", "a", "b")) == [(1, None, 7), (2, "n", None)]


def test_text_sinks(spark, tmp_path):
    features = spark.createDataFrame([(2, 5, 1.5, 2.5, 3), (1, 6, 3.5, 4.5, 0)], "query_idx long, n long, qlat double, qlon double, mean long")
    writers.write_features(features.select("query_idx", "n"), str(tmp_path / "f"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "f")).columns == ["query_idx", "n"]
    assert rows(writers.venue_lines(features, ["n"])) == [("1.5 2.5\tmean=3\tn=5",), ("3.5 4.5\tmean=0\tn=6",)]
    edges = spark.createDataFrame([(1, 2, 3.0)], "src long, dst long, weight double")
    writers.write_edges(edges, str(tmp_path / "e"))
    assert spark.read.text(str(tmp_path / "e")).first()[0] == "1\t2\t3.0" and rows(writers.edge_lines(edges)) == [("1\t2\t3.0",)]
    assert rows(writers.vertex_lines(edges.select(F.col("src").alias("id"), "weight"))) == [("1\t3.0",)]
    grid = tiles.tiles(spark, 5, geo.Box(59.8, 30.1, 59.9, 30.2))
    writers.write_tiles(grid, str(tmp_path / "t"))
    assert spark.read.option("sep", " ").option("header", True).csv(str(tmp_path / "t")).columns == ["leftLat", "leftLon", "rightLat", "rightLon", "centerLat", "centerLon", "R"]
    assert set(json.loads(writers.tile_centers(grid).first()[0])) == {"lat", "lon"}
    staged = spark.createDataFrame([(1, 2, [0.5, 1.0]), (1, 1, [0.25, 2.0])], "query_id long, doc_id long, staged array<double>")
    assert rows(writers.prediction_lines(staged)) == [(1, 0, "0.25 0.5"), (1, 1, "2.0 1.0")]
    writers.write_lines(writers.edge_lines(edges), str(tmp_path / "l"))
    writers.back_up(edges, str(tmp_path / "b"))
    writers.replace_all(edges, str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "b")).count() == spark.read.parquet(str(tmp_path / "r")).count() == spark.read.text(str(tmp_path / "l")).count() == 1


def write_stream(folder, name, ids):
    with open(folder / name, "w") as f:
        for i in ids:
            day = 23 + i % 2
            f.write(json.dumps(RAW | {"id": i, "created_at": f"Sun Nov {day} 10:00:00 +0000 2014"}) + "\n")


def test_streams_equal_batches(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    write_stream(source, "a.json", [1, 2, 3])
    box = geo.Box(59, 30, 60, 31)
    state = str(tmp_path / "store")
    stream.save(stream.located(stream.raw_stream(spark, str(source), 1), box), state, str(tmp_path / "c1")).awaitTermination()
    write_stream(source, "b.json", [3, 4])
    stream.save(stream.located(stream.raw_stream(spark, str(source), 1), box), state, str(tmp_path / "c1")).awaitTermination()
    assert rows(writers.saved(spark, state).select("_id")) == [(1,), (2,), (3,), (4,)]
    stream.day_files(stream.once(stream.located(stream.raw_stream(spark, str(source)), box)), str(tmp_path / "days"), str(tmp_path / "c2")).awaitTermination()
    dated = spark.read.json(str(tmp_path / "days"))
    assert rows(dated.groupBy(F.col("dt").cast("string")).count()) == [("2014-11-23", 2), ("2014-11-24", 2)]

    counts = stream.weekly_counts(stream.located(stream.raw_stream(spark, str(source)), box), "source", "created_at")
    counts.writeStream.format("memory").queryName("weekly").outputMode("complete").option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start().awaitTermination()
    batch = readers.normalised_posts(spark.read.schema(readers.RAW_POST).json(str(source)))
    assert rows(spark.table("weekly").select("source", "week", "day", "n")) == rows(stream.weekly_counts_batch(batch, "source", "created_at").select("source", "week", "day", "n"))
