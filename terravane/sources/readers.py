"""Readers of posts, venues, map nodes, query points, ranking files and raw dumps.

Schemas are given, so files are read once and only the named columns are parsed. Lines or records that do not fit are dropped from the
result; where the format allows it, ``rejects`` returns them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import osm, posts, times
from terravane.sources import ranking_stream

POST = "_id long, certain_coords int, created_at long, geo struct<type: string, coordinates: array<double>>, source string, user struct<id: long>"
VENUE = "_id string, _geo array<double>, _categoryIds array<array<string>>, _timestamp double, createdAt long"
RAW_POST = (
    "id long, text string, retweet_count long, favorite_count long, source string, created_at string, geo struct<coordinates: array<double>>, "
    "user struct<id: long, followers_count: long, friends_count: long, listed_count: long, favourites_count: long, created_at: string>, "
    "place struct<id: string, url: string, bounding_box: struct<coordinates: array<array<array<double>>>>>, "
    "entities struct<hashtags: array<struct<text: string>>, urls: array<struct<expanded_url: string>>>"
)
NODE = "_id string, _lat string, _lon string, tag array<struct<_k: string, _v: string>>"
#: Fixed value: the radius in km of a query point that names none.
DEFAULT_RADIUS = 0.5


def posts_of(raw: DataFrame, ts_unit: str = "ms", exact_only: bool = True) -> DataFrame:
    """(id, user_id, lat, lon, source, ts) of stored posts; coordinates are stored longitude first."""
    ts = {"ms": F.timestamp_millis, "s": F.timestamp_seconds}[ts_unit]("created_at")
    rows = raw.where(F.col("certain_coords") == 1) if exact_only else raw
    return rows.select(F.col("_id").alias("id"), F.col("user.id").alias("user_id"), F.get("geo.coordinates", F.lit(1)).alias("lat"), F.get("geo.coordinates", F.lit(0)).alias("lon"), "source", ts.alias("ts"))


def read_posts(spark: SparkSession, path: str, ts_unit: str = "ms", exact_only: bool = True) -> DataFrame:
    return posts_of(spark.read.schema(POST).json(path), ts_unit, exact_only)


def venues_of(raw: DataFrame) -> DataFrame:
    """(id, lat, lon, categories, created, seen): all paths' categories; the time seen is rounded to whole seconds."""
    return raw.select(
        F.col("_id").alias("id"), F.get("_geo", F.lit(1)).alias("lat"), F.get("_geo", F.lit(0)).alias("lon"), F.array_distinct(F.flatten("_categoryIds")).alias("categories"),
        F.timestamp_seconds("createdAt").alias("created"), times.seconds_half_up(F.col("_timestamp")).alias("seen"),
    )


def read_venues(spark: SparkSession, path: str) -> DataFrame:
    return venues_of(spark.read.schema(VENUE).json(path))


def nodes_of(raw: DataFrame) -> DataFrame:
    """Map nodes with at least one accepted tag, one string column for each key; of a key's accepted values the last counts."""
    kept = F.filter(F.coalesce("tag", F.array().cast("array<struct<_k: string, _v: string>>")), lambda t: osm.accepted(t["_k"], t["_v"]))
    rows = raw.withColumn("_kept", kept).where(F.size("_kept") > 0)
    of = lambda key: F.try_element_at(F.filter("_kept", lambda t: t["_k"] == key), F.lit(-1))["_v"]
    return rows.select(F.col("_id").alias("id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"), *[of(k).alias(k) for k in osm.COLUMNS[3:]])


def read_nodes(spark: SparkSession, path: str) -> DataFrame:
    return nodes_of(spark.read.format("xml").option("rowTag", "node").schema(NODE).load(path))


def places_of(nodes: DataFrame) -> DataFrame:
    """(id, lat, lon, name, url, contact_phone, operator, categories_names) of map nodes."""
    rows = nodes.withColumn("transport", osm.transport_kind()).withColumn("operator", osm.run_by())
    return rows.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "name", "url", F.col("phone").alias("contact_phone"), "operator", osm.categories().alias("categories_names"))


def with_category_ids(places: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``places`` with categories_ids from ``ids`` (name, fullCategory), null where a name is missing; quotes in names are dropped.

    Lists of names are looked up once each, whatever number of places has them; both joins are broadcast by Spark if what they look up is small.
    """
    table = ids.select(F.translate("name", '"', "").alias("_name"), "fullCategory").groupBy("_name").agg(F.min("fullCategory").alias("_id"))
    lists = places.select(F.col("categories_names").alias("_names")).distinct()
    found = lists.select("_names", F.posexplode("_names").alias("_pos", "_name")).join(table, "_name", "left").groupBy("_names").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_id"))), lambda x: x["_id"]).alias("_ids"))
    joined = places.join(found, F.col("categories_names") == F.col("_names"), "left")
    return joined.withColumn("categories_ids", F.coalesce("_ids", F.array().cast("array<string>"))).drop("_names", "_ids")


def coordinates_of(table: DataFrame) -> DataFrame:
    """(lon, lat) of a node table, by name, without quotes."""
    return table.select(*[F.translate(c, '"', "").cast("double").alias(c) for c in ("lon", "lat")])


def read_node_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).option("nullValue", "NA").csv(path)


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).csv(path)


def _point_columns(lines: DataFrame) -> DataFrame:
    part = F.split("value", "\t")
    number = lambda i: F.get(part, F.lit(i)).try_cast("double")
    n = F.size(part)
    radius = F.when(n == 2, F.lit(DEFAULT_RADIUS)).when(n == 3, number(2))
    return lines.select("value", number(0).alias("qlat"), number(1).alias("qlon"), radius.alias("radius"), F.monotonically_increasing_id().alias("query_idx"))


def _whole_point() -> Column:
    return F.col("qlat").isNotNull() & F.col("qlon").isNotNull() & F.col("radius").isNotNull()


def points_of(lines: DataFrame) -> DataFrame:
    """Query points from a column ``value`` of lines."""
    return _point_columns(lines).where(_whole_point()).select("query_idx", "qlat", "qlon", "radius")


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """(query_idx, qlat, qlon, radius) from lines of latitude, longitude and, if there is one, radius in km."""
    return points_of(spark.read.text(path))


def rejects(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a file of query points that are none."""
    return _point_columns(spark.read.text(path)).where(~_whole_point()).select("value")


def _numbers(line: Column) -> Column:
    """Numbers between white space."""
    return F.transform(F.filter(F.split(line, r"\s+"), lambda x: x != ""), lambda x: x.try_cast("double"))


def numbered_lines(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(value, name): the lines that aren't blank with numbers from 0, files by their names and blocks by where they begin, whatever order a scan takes."""
    place = ["_file", "_block"]
    lines = spark.read.text(path).where(F.trim("value") != "").select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_id"))
    starts, at = [], 0
    for r in lines.groupBy(*place).agg(F.count(F.lit(1)).alias("n"), F.min("_id").alias("first")).orderBy(*place).collect():
        starts.append((r["_file"], r["_block"], at - r["first"]))
        at += r["n"]
    first = spark.createDataFrame(starts, "_file string, _block long, _start long")
    return lines.join(F.broadcast(first), place).select("value", (F.col("_id") + F.col("_start")).alias(name))


def read_search(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Points (id, lat, lon) and queries (query_idx, qlat, qlon, radius) of a search file: n, n points, m, a radius, m queries.

    The three header numbers stand at known lines, so they are found by line number; points and queries stay distributed. Lines are read again
    for each, not kept: a copy of all numbers would be larger than the file.
    """
    rows = numbered_lines(spark, path, "i").select(_numbers(F.col("value")).alias("x"), "i")
    n = int(rows.where("i = 0").first()["x"][0])
    after = [r["x"] for r in rows.where((F.col("i") > n) & (F.col("i") <= n + 2)).orderBy("i").collect()]
    head = [v for x in after for v in x]
    at = n + 2 if len(after[0]) > 1 else n + 3
    found = rows.where((F.col("i") >= 1) & (F.col("i") <= n)).select(F.get("x", 0).cast("long").alias("id"), F.get("x", 1).alias("lat"), F.get("x", 2).alias("lon"))
    asked = rows.where((F.col("i") >= at) & (F.col("i") < at + int(head[0]))).select((F.col("i") - at).alias("query_idx"), F.get("x", 0).alias("qlat"), F.get("x", 1).alias("qlon"), F.lit(float(head[1])).alias("radius"))
    return found, asked


def read_matrix(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """(doc_id, features, target) of a ranking matrix; ``header`` is a first line of two numbers. The last column is the target.

    Row numbers rise with the lines.
    """
    rows = spark.read.text(path).where(F.trim("value") != "").select(_numbers(F.col("value")).alias("x"), F.monotonically_increasing_id().alias("doc_id"))
    rows = rows.where(F.size("x") > 2) if header else rows
    return rows.select("doc_id", F.slice("x", F.lit(1), F.size("x") - 1).alias("features"), F.element_at("x", -1).alias("target"))


def read_ranking_queries(spark: SparkSession, path: str, piece: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Documents (query_id, doc_id, features, target) and pairs (query_id, i, j, w) of a queries file; see ``ranking_stream``."""
    return ranking_stream.read(spark, path, piece)


def normalised_posts(raw: DataFrame) -> DataFrame:
    """Raw stream records in the form in which they are stored, with named coordinates.

    Place and user fields are kept only if there is a place. Without exact coordinates a post is put at the mean of the corners of
    its place; without a place either, it has none.
    """
    placed = F.col("place").isNotNull()
    source = posts.source_class(F.col("source"))
    corners = F.get("place.bounding_box.coordinates", F.lit(0))
    exact = F.col("geo").isNotNull()
    user = posts.kept("user", posts.USER_FIELDS[:-1], placed)
    return raw.select(
        F.col("id").alias("_id"), "text", "retweet_count", "favorite_count",
        F.struct(*[user[f].alias(f) for f in posts.USER_FIELDS[:-1]], F.when(placed, times.post_time(F.col("user.created_at"))).alias("created_at")).alias("user"),
        posts.kept("place", posts.PLACE_FIELDS, placed).alias("place"), source.alias("source"), exact.cast("int").alias("certain_coords"),
        F.when(exact, F.get("geo.coordinates", F.lit(0))).otherwise(posts.corner_mean(corners, 1)).alias("lat"), F.when(exact, F.get("geo.coordinates", F.lit(1))).otherwise(posts.corner_mean(corners, 0)).alias("lon"),
        times.post_time(F.col("created_at")).alias("created_at"), F.col("entities.hashtags").alias("hashtags"), posts.first_url(source, F.col("entities.urls")).alias("url"),
    )


def read_raw_posts(spark: SparkSession, path: str, partitions: int | None = None) -> DataFrame:
    """Normal posts from lines of raw JSON, packed or not. Packed files are read by one task each, so rows are dealt out after it."""
    lines = spark.read.text(path)
    lines = lines.repartition(partitions) if partitions else lines
    return normalised_posts(lines.select(F.from_json("value", RAW_POST).alias("r")).select("r.*"))


def reversed_posts(old: DataFrame) -> DataFrame:
    """Older stored posts in the present form: coordinates the other way round, epoch seconds as timestamps."""
    return old.withColumns({"geo": F.col("geo").withField("coordinates", F.reverse("geo.coordinates")), "created_at": F.timestamp_seconds("created_at")})


def without_shell_calls(line: Column) -> Column:
    """``Date( n )`` and ``NumberLong(n)`` as plain numbers."""
    return F.regexp_replace(F.regexp_replace(line, r"Date\(\s*(-?\d+)\s*\)", "$1"), r"NumberLong\(\s*\"?(-?\d+)\"?\s*\)", "$1")


def read_shell_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with the line as plain JSON in ``line`` and, from created_at in ms, the day in ``dt``."""
    lines = spark.read.text(path).select(without_shell_calls(F.col("value")).alias("line"))
    return lines.withColumn("r", F.from_json("line", schema)).select("line", "r.*").withColumn("dt", times.day_name(F.col("created_at")))


def read_days(spark: SparkSession, path: str, first: str, last: str, schema: str | None = None, fmt: str = "json") -> DataFrame:
    """The day partitions from ``first`` to ``last``, both included; days that do not exist are not missed, others are not read."""
    reader = spark.read if schema is None else spark.read.schema(f"{schema}, dt date")
    return reader.format(fmt).load(path).where(F.col("dt").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
