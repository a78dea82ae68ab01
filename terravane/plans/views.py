"""Posts, query points, venues and rankings over the driver's tables, which have no coordinates of their own.

Each view is stated twice: as a DataFrame and as the text of a SQL common table expression with the same arithmetic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Corner and extent of the box in which coordinates are made.
LAT, LAT_SIZE, LON, LON_SIZE = 59.829833, 0.199182, 30.178096, 0.342498


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(key: str, factor: int, modulus: int, low: float, size: float) -> Column:
    return F.lit(low) + F.lit(size) * ((F.col(key) * factor) % modulus) / F.lit(float(modulus))


def _spread_sql(key: str, factor: int, modulus: int, low: float, size: float) -> str:
    return f"{low}e0 + {size}e0 * (({key} * {factor}) % {modulus}) / {modulus}e0"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    kinds = {"view": "Web", "click": "iPhone", "purchase": "Android", "signup": "instagram"}
    source = F.lit("foursquare")
    for kind, name in kinds.items():
        source = F.when(F.col("event_type") == kind, name).otherwise(source)
    return e.select(F.col("event_id").alias("id"), "user_id", "ts", "value", _spread("event_id", 7919, 100003, LAT, LAT_SIZE).alias("lat"), _spread("event_id", 104729, 100019, LON, LON_SIZE).alias("lon"), source.alias("source"))


POSTS = f"""posts as (select event_id as id, user_id, ts, value, {_spread_sql("event_id", 7919, 100003, LAT, LAT_SIZE)} as lat, {_spread_sql("event_id", 104729, 100019, LON, LON_SIZE)} as lon,
  case event_type when 'view' then 'Web' when 'click' then 'iPhone' when 'purchase' then 'Android' when 'signup' then 'instagram' else 'foursquare' end as source from events)"""


def query_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier")
    return s.select(F.col("s_suppkey").alias("query_idx"), _spread("s_suppkey", 7907, 1009, LAT, LAT_SIZE).alias("qlat"), _spread("s_suppkey", 6101, 1013, LON, LON_SIZE).alias("qlon"), F.lit(0.5).alias("radius"))


QUERY_POINTS = f"""query_points as (select s_suppkey as query_idx, {_spread_sql("s_suppkey", 7907, 1009, LAT, LAT_SIZE)} as qlat, {_spread_sql("s_suppkey", 6101, 1013, LON, LON_SIZE)} as qlon, 0.5e0 as radius from supplier)"""

NEAR = "sin(radians(lat)) * sin(radians(qlat)) + cos(radians(lat)) * cos(radians(qlat)) * cos(radians(lon - qlon)) > cos(radius / 6378e0)"


def venues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    times = o.groupBy(F.col("o_custkey").alias("id")).agg(F.min("o_orderdate").alias("created"), F.max("o_orderdate").alias("seen"))
    own = c.select(F.col("c_custkey").alias("id"), _spread("c_custkey", 7919, 100003, LAT, LAT_SIZE).alias("lat"), _spread("c_custkey", 104729, 100019, LON, LON_SIZE).alias("lon"), F.array("c_mktsegment").alias("categories"))
    return own.join(times, "id", "left")


VENUES = f"""venues as (select c_custkey as id, {_spread_sql("c_custkey", 7919, 100003, LAT, LAT_SIZE)} as lat, {_spread_sql("c_custkey", 104729, 100019, LON, LON_SIZE)} as lon, c_mktsegment as category, created, seen
  from customer left join (select o_custkey, min(o_orderdate) as created, max(o_orderdate) as seen from orders group by 1) o on o_custkey = c_custkey)"""


def cell_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Posts on forty cells, so that the movement graph is dense."""
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "ts", (F.col("event_id") % 40).alias("cell"))


CELL_EDGES = """p as (select user_id, ts, event_id % 40 as dst, lag(event_id % 40) over o as src, epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over o as ms from events window o as (partition by user_id order by ts, event_id)),
edges as (select * from p where src <> dst and ms > 300000 and ms < {most})"""


def supplier_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Large lists: a supplier's lines, target price, prediction quantity."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_suppkey").alias("query_id"), "l_orderkey", "l_linenumber", "l_partkey", F.col("l_extendedprice").alias("target"), F.col("l_quantity").alias("prediction"))


def order_rankings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Short lists: an order's lines."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("query_id"), F.col("l_linenumber").alias("doc_id"), F.col("l_extendedprice").alias("target"), F.array(F.col("l_quantity").cast("double"), F.col("l_discount").cast("double"), F.col("l_tax").cast("double")).alias("features"))


def category_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    up = n.join(r, n.n_regionkey == r.r_regionkey).select(F.col("n_name").alias("id"), F.col("r_name").alias("parent_id"))
    return up.unionByName(r.select(F.col("r_name").alias("id"), F.lit(None).cast("string").alias("parent_id")))


TREE = """tree as (select n_name as id, r_name as parent_id from nation join region on n_regionkey = r_regionkey union all select r_name, null from region)"""


def raw_posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as raw stream records: some without exact coordinates, some without a place."""
    e = table(spark, sf_dir, "events")
    k = F.col("event_id")
    client = F.element_at(F.array(*[F.lit(x) for x in ("Twitter Web Client", "Twitter for iPhone", "Twitter for Android Web", "instagram", "foursquare", "bot")]), (k % 6 + 1).cast("int"))
    corner = lambda a, b: F.array((30 + (k % 90) / 100.0 + a).cast("double"), (59 + (k % 80) / 100.0 + b).cast("double"))
    text = F.concat(F.date_format("ts", "EEE MMM dd HH:mm:ss"), F.lit(" +0000 "), F.date_format("ts", "yyyy"))
    box = F.array(F.array(corner(0.0, 0.0), corner(0.25, 0.0), corner(0.25, 0.5), corner(0.0, 0.5)))
    place = F.struct(F.concat(F.lit("p"), k % 7).alias("id"), F.lit("http://place").alias("url"), F.struct(box.alias("coordinates")).alias("bounding_box"))
    urls = F.array(F.struct(F.concat(F.lit("http://u/"), k).alias("expanded_url")))
    return e.select(
        k.alias("id"), F.lit("text").alias("text"), F.lit(1).cast("long").alias("retweet_count"), F.lit(2).cast("long").alias("favorite_count"), client.alias("source"), text.alias("created_at"),
        F.when(k % 3 != 0, F.struct(F.array((59 + (k % 50) / 64.0).cast("double"), (30 + (k % 40) / 64.0).cast("double")).alias("coordinates"))).alias("geo"),
        F.struct(F.col("user_id").alias("id"), (k % 1000).alias("followers_count"), F.lit(3).cast("long").alias("friends_count"), F.lit(4).cast("long").alias("listed_count"), F.lit(5).cast("long").alias("favourites_count"), text.alias("created_at")).alias("user"),
        F.when(k % 5 != 1, place).alias("place"),
        F.struct(F.array(F.struct(F.lit("tag").alias("text"))).alias("hashtags"), F.when(k % 2 == 0, urls).otherwise(F.slice(urls, 1, 0)).alias("urls")).alias("entities"),
    )
