"""Queries that write files, read them back and give what was read; with the SQL of the rows that went in.

Each query takes a new folder under the shared one. Streams run until all input is read (``availableNow``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.functions import geo, osm, paths, posts, times
from terravane.operators import point_stats, ranking, tiles, timeseries
from terravane.operators import venues as vn
from terravane.plans import catalog, views
from terravane.plans.catalog import ORACLES, query
from terravane.sources import docstore, readers, settings, shared, writers
from terravane.streaming import counters
from terravane.streaming import posts as stream

#: All coordinates; posts without any are outside.
EVERYWHERE = geo.Box(-90.0, -180.0, 90.0, 180.0)


def _folder(spark, label: str) -> str:
    return shared.work_dir(spark, label)


def _local_ms(ts: str):
    """Epoch ms at which this session's clock shows the given wall time."""
    return F.unix_millis(F.col(ts).cast("timestamp"))


# Posts and venues


@query(f"with {views.POSTS} select id, user_id, lat, lon, source, id * 1000 as ms from posts where id % 3 <> 0")
def tweet_json_scan(spark, d):
    p, path = views.posts(spark, d), _folder(spark, "posts")
    raw = p.select(F.col("id").alias("_id"), (F.col("id") % 3 != 0).cast("int").alias("certain_coords"), (F.col("id") * 1000).alias("created_at"), F.struct(F.lit("Point").alias("type"), F.array("lon", "lat").alias("coordinates")).alias("geo"), "source", F.struct(F.col("user_id").alias("id")).alias("user"), F.lit("x").alias("text"))
    writers.back_up(raw, path)
    return readers.read_posts(spark, path).select("id", "user_id", "lat", "lon", "source", F.unix_millis("ts").alias("ms"))


@query("select cast(c_custkey as varchar) as id, c_custkey % 90 + 0.5e0 as lat, c_custkey % 180 + 0.25e0 as lon, c_mktsegment || '|top' as categories, c_custkey * 10 as created, c_custkey + 1 as seen from customer")
def venue_json_scan(spark, d):
    k, path = F.col("c_custkey"), _folder(spark, "venues")
    raw = views.table(spark, d, "customer").select(k.cast("string").alias("_id"), F.array(k % 180 + 0.25, k % 90 + 0.5).alias("_geo"), F.array(F.array("c_mktsegment"), F.array(F.lit("top"), "c_mktsegment")).alias("_categoryIds"), (k + 0.5).cast("double").alias("_timestamp"), (k * 10).alias("createdAt"))
    writers.back_up(raw, path)
    return readers.read_venues(spark, path).select("id", "lat", "lon", F.array_join("categories", "|").alias("categories"), F.unix_seconds("created").alias("created"), F.unix_seconds("seen").alias("seen"))


@query(ORACLES["normalize_tweets"])
def gzip_raw_scan(spark, d):
    path = _folder(spark, "raw")
    views.raw_posts(spark, d).select(F.to_json(F.struct("*")).alias("value")).write.option("compression", "gzip").text(path)
    return catalog.shown_posts(readers.read_raw_posts(spark, path, 8))


@query("select event_id as id, event_id % 1000 as followers, cast(null as varchar) as missing, case when event_id % 5 <> 1 then 'p' || (event_id % 7) end as place from events")
def nested_lookup(spark, d):
    raw = views.raw_posts(spark, d)
    return raw.select("id", paths.at_path(raw.schema, "user.followers_count").alias("followers"), paths.at_path(raw.schema, "user.nothing.here").alias("missing"), paths.at_path(raw.schema, "place_id", "_").alias("place"))


@query("select event_id as id, user_id from events")
def nested_projection(spark, d):
    path = _folder(spark, "nested")
    writers.replace_all(views.raw_posts(spark, d), path)
    return spark.read.parquet(path).select("id", F.col("user.id").alias("user_id"))


@query("select distinct user_id as id from events order by 1 limit 50")
def first_ids(spark, d):
    return views.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct().orderBy("id").limit(50)


@query("select event_id as id, (event_id * 1000000 + 7000) / 1000000.0e0 as s, event_id * 1000 + 7 as ms from events")
def epoch_conversions(spark, d):
    at = F.timestamp_millis(F.col("event_id") * 1000 + 7)
    return views.table(spark, d, "events").select(F.col("event_id").alias("id"), times.epoch_seconds(at).alias("s"), F.unix_millis(at).alias("ms"))


@query(f"with {views.POSTS} select id from posts where hour(ts) >= 12 and hour(ts) < 19 and source in ('iPhone', 'iPad')")
def combined_filters(spark, d):
    both = posts.crossed(times.part_filters(F.col("ts"), times.PROFILE_A), posts.group_filters(F.col("source")), "_and_")
    return views.posts(spark, d).where(posts.all_of(both["Day_and_Apple"], EVERYWHERE.contains())).select("id")


# Map nodes

_ACCEPTED = "({k} in ('shop', 'office') or ({k} = 'amenity' and {v} <> 'bench') or ({k} = 'highway' and {v} = 'bus_stop') or ({k} = 'railway' and {v} = 'station') or ({k} = 'tourism' and {v} <> 'yes') or ({k} = 'emergency' and {v} = 'phone'))"
_NODES = f"""t as (select p_partkey as n, {list(catalog._KEYS)!r}[p_partkey % 8 + 1] as k, {list(catalog._VALUES)!r}[(p_partkey // 8) % 7 + 1] as v from part),
nodes as (select cast(n as varchar) as id, 59 + n % 128 / 128.0e0 as lat, 30 + n % 64 / 64.0e0 as lon, case when n % 2 = 0 and {_ACCEPTED.format(k="k", v="'cafe'")} then 'cafe' when {_ACCEPTED.format(k="k", v="v")} then v end as tag from t)"""


def _nodes(spark, d) -> DataFrame:
    """Nodes as they are read from map XML; every second one has its key twice."""
    n, path = F.col("p_partkey"), _folder(spark, "xml")
    head = F.concat(F.lit('<node id="'), n, F.lit('" lat="'), 59 + n % 128 / 128.0, F.lit('" lon="'), 30 + n % 64 / 64.0, F.lit('">'))
    tag = lambda v: F.concat(F.lit('<tag k="'), F.col("k"), F.lit('" v="'), v, F.lit('"/>'))
    body = catalog._tags(spark, d).select(F.lit(1).alias("part"), F.concat(head, tag(F.col("v")), F.when(n % 2 == 0, tag(F.lit("cafe"))).otherwise(""), F.lit("</node>")).alias("value"))
    ends = spark.createDataFrame([(0, "<osm>"), (2, "</osm>")], "part int, value string")
    writers.write_lines(body.unionByName(ends).orderBy("part").select("value").coalesce(1), path)
    return readers.read_nodes(spark, path)


def _shown_nodes(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), F.coalesce(*catalog._KEYS).alias("tag"))


@query(f"with {_NODES} select * from nodes where tag is not null")
def osm_node_scan(spark, d):
    return _shown_nodes(_nodes(spark, d))


@query(f"with {_NODES} select * from nodes where tag is not null")
def osm_csv_round_trip(spark, d):
    path = _folder(spark, "nodes")
    writers.write_nodes(_nodes(spark, d), path)
    return _shown_nodes(readers.read_node_csv(spark, path))


@query(f"with {_NODES} select lon, lat from nodes where tag is not null")
def csv_coordinates(spark, d):
    path = _folder(spark, "coordinates")
    writers.write_nodes(_nodes(spark, d), path)
    return readers.coordinates_of(readers.read_node_csv(spark, path))


_GIVEN_IDS = ", ".join(f"case when {c} then 'c{osm.CATEGORIES.index(n)}' end" for n, c in catalog._GIVEN.items() if n != "Bar")


@query(f"""with p as (select p_partkey as k, {catalog._sql_list(catalog._AMENITY)}[p_partkey % 6 + 1] as a, {catalog._sql_list(catalog._SHOP)}[(p_partkey // 6) % 4 + 1] as s, {catalog._sql_list(catalog._TOURISM)}[(p_partkey // 24) % 2 + 1] as t, {catalog._sql_list(catalog._TRANSPORT)}[(p_partkey // 48) % 3 + 1] as x from part)
select k as p_partkey, concat_ws('|', {_GIVEN_IDS}) as ids, cast(coalesce(a = 'bar', false) as int) as unknown from p""")
def category_ids(spark, d):
    """Ids of the categories from a CSV table with quoted names, in which one name is missing."""
    path = _folder(spark, "categories")
    table = spark.createDataFrame([(f'"{n}"', f"c{i}") for i, n in enumerate(osm.CATEGORIES) if n != "Bar"], "name string, fullCategory string")
    table.write.option("header", True).csv(path)
    places = catalog._places(spark, d).select("p_partkey", osm.categories().alias("categories_names"))
    found = readers.with_category_ids(places, readers.read_categories(spark, path), "p_partkey")
    return found.select("p_partkey", F.array_join("categories_ids", "|").alias("ids"), F.size(F.filter("categories_ids", lambda x: x.isNull())).alias("unknown"))


@query(f"with {views.TREE} select id, parent_id from tree")
def tree_flatten(spark, d):
    """A nested category tree; a region has a handful of nations."""
    r, n = views.table(spark, d, "region"), views.table(spark, d, "nation")
    below = n.groupBy("n_regionkey").agg(F.collect_list(F.struct(F.col("n_name").alias("id"))).alias("categories"))
    top = r.join(below, r.r_regionkey == below.n_regionkey, "left").select(F.struct(F.col("r_name").alias("id"), F.coalesce("categories", F.array().cast("array<struct<id: string>>")).alias("categories")).alias("c"))
    return vn.flatten_tree(top.select(F.array("c").alias("categories")))


_DEEP = """k as (select distinct l_orderkey as o, l_partkey as p, l_orderkey || '-' || l_partkey || '-' || l_suppkey as key from lineitem)
select distinct 'o' || o as id, null::varchar as parent_id, 0 as depth from k union all select 'l' || key, 'o' || o, 1 from k union all select 'p' || key, 'l' || key, 2 from k where p % 2 = 0
union all select 'b' || key, 'p' || key, 3 from k where p % 4 = 0 union all select 'm' || key, 'b' || key, 4 from k where p % 8 = 0"""


@query(f"with {_DEEP}")
def record_tree(spark, d):
    """Trees of five uneven levels from JSON lines whose schema is never stated: orders, lines, and below them as far as the part number says."""
    path, k = _folder(spark, "records"), F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey")
    lines = views.table(spark, d, "lineitem").select("l_orderkey", "l_partkey", k.alias("k"))
    node = lambda letter, below: F.concat(F.lit(f'{{"id":"{letter}'), "k", F.lit('"'), below, F.lit("}"))
    inner = F.lit("")
    for letter, every in (("m", 8), ("b", 4), ("p", 2)):
        inner = F.when(F.col("l_partkey") % every == 0, F.concat(F.lit(',"categories":['), node(letter, inner), F.lit("]"))).otherwise(F.lit(""))
    orders = lines.groupBy("l_orderkey").agg(F.array_join(F.collect_set(node("l", inner)), ",").alias("below"))
    writers.write_lines(orders.select(F.concat(F.lit('{"categories":[{"id":"o'), "l_orderkey", F.lit('","categories":['), "below", F.lit("]}]}")).alias("value")), path)
    return vn.flatten_records(spark.read.text(path), "value")


@query("select event_id as id, event_id % 1000 as followers, cast(null as varchar) as missing, case when event_id % 5 <> 1 then 'p' || (event_id % 7) end as place from events")
def record_lookup(spark, d):
    """Fields of raw posts by their paths, without a schema."""
    path = _folder(spark, "variants")
    writers.back_up(views.raw_posts(spark, d), path)
    raw = spark.read.text(path).select(F.try_parse_json("value").alias("r"))
    return raw.select(paths.in_record("r", "id", "long").alias("id"), paths.in_record("r", "user.followers_count", "long").alias("followers"), paths.in_record("r", "user.nothing.here").alias("missing"), paths.in_record("r", "place_id", joint="_").alias("place"))


# Feature tables and graphs


@query(ORACLES["points_nearby_count"])
def feature_table_file(spark, d):
    path = _folder(spark, "features")
    writers.write_features(point_stats.nearby_count(views.query_points(spark, d), views.posts(spark, d), 0.5), path)
    return spark.read.option("sep", "\t").option("header", True).schema("query_idx long, n long").csv(path)


@query("select '(' || cast(s_suppkey + 0.5e0 as varchar) || ', ' || cast(s_suppkey % 50 + 0.25e0 as varchar) || ')' as point, s_suppkey % 7 as n from supplier")
def indexed_table_file(spark, d):
    k, path = F.col("s_suppkey"), _folder(spark, "indexed")
    writers.write_indexed(views.table(spark, d, "supplier").select((k + 0.5).alias("qlat"), (k % 50 + 0.25).alias("qlon"), (k % 7).alias("n")), path)
    return spark.read.option("sep", "\t").option("header", True).schema("point string, n long").csv(path)


@query("select cast(s_suppkey + 0.5e0 as varchar) || ' ' || cast(s_suppkey + 0.25e0 as varchar) || chr(9) || 'mean=' || (s_suppkey % 7) || chr(9) || 'Food=' || (s_suppkey % 3) as value from supplier")
def venue_lines_file(spark, d):
    k, path = F.col("s_suppkey"), _folder(spark, "lines")
    rows = views.table(spark, d, "supplier").select((k + 0.5).alias("qlat"), (k + 0.25).alias("qlon"), (k % 7).alias("mean"), (k % 3).alias("Food"))
    writers.write_lines(writers.venue_lines(rows, ["Food"]), path)
    return spark.read.text(path)


@query(ORACLES["tile_grid"])
def tile_file(spark, d):
    path = _folder(spark, "tiles")
    writers.write_tiles(catalog.posts_tiles(spark, d), path)
    names = {"leftLat": "left_lat", "leftLon": "left_lon", "rightLat": "right_lat", "rightLon": "right_lon", "R": "r"}
    back = spark.read.option("sep", " ").option("header", True).csv(path)
    return back.select(*[F.round(F.col(a).cast("double"), 9).alias(b) for a, b in names.items()])


@query(ORACLES["tile_grid"].rsplit("select", 1)[0] + "select round(degrees(lat + dy / 2), 6) as lat, round(degrees(lon + dx / 2), 6) as lon from t")
def tile_center_file(spark, d):
    path = _folder(spark, "centers")
    writers.write_lines(writers.tile_centers(catalog.posts_tiles(spark, d)), path)
    back = spark.read.schema("lat double, lon double").json(path)
    return back.select(F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"))


_WINDOWS = f"""{catalog.TILES.format(side=3)}, tile as (select row || '-' || col as tile, degrees(lat) as y0, degrees(lon) as x0, degrees(lat + dy) as y1, degrees(lon + dx) as x1, 0.6e0 * sqrt(2e0) * 3e0 as r from t),
placed as (select id, lat, lon, epoch_us(ts) as us, ((1704844800000000 - epoch_us(ts) - 1) // 86400000000)::int as back from posts where epoch_us(ts) < 1704844800000000 and epoch_us(ts) >= 1704844800000000 - 7 * 86400000000),
w0 as (select tile, '' as path, y0, x0, y1, x1, r from tile),
h0 as (select tile, path, back, id, us from w0 join placed on {{near}}),
f0 as (select tile, path, back from h0 group by all having count(*) >= 4),
q as (select unnest(['a', 'b', 'c', 'd']) as part, unnest([0, 0, 1, 1]) as up, unnest([0, 1, 0, 1]) as right_),
w1 as (select tile, path || part as path, back, case up when 0 then y0 else (y0 + y1) / 2 end as y0, case right_ when 0 then x0 else (x0 + x1) / 2 end as x0,
  case up when 0 then (y0 + y1) / 2 else y1 end as y1, case right_ when 0 then (x0 + x1) / 2 else x1 end as x1, r / 2 as r from w0 join f0 using (tile, path), q),
h1 as (select tile, path, w.back, id, us from w1 w join placed p on w.back = p.back and {{near}}),
f1 as (select tile, path, back from h1 group by all having count(*) >= 4)
select *, false as cut from h0 where (tile, path, back) not in (select (tile, path, back) from f0) union all select *, false from h1 where (tile, path, back) not in (select (tile, path, back) from f1)
union all select tile, path, back, id, us, true from (select *, row_number() over (partition by tile, path, back order by us desc, id) as p from h1 where (tile, path, back) in (select (tile, path, back) from f1)) where p <= 4""".format(
    near="sin(radians(lat)) * sin(radians((y0 + y1) / 2)) + cos(radians(lat)) * cos(radians((y0 + y1) / 2)) * cos(radians(lon - (x0 + x1) / 2)) > cos(r / 6378e0)"
)


@query(f"with {_WINDOWS}")
def backward_windows(spark, d):
    """What tiles give day by day for the seven days before a time, full windows asked again by quarters."""
    p = views.posts(spark, d).withColumn("us", catalog.micros("ts"))
    grid = catalog.posts_tiles(spark, d, 3).withColumn("tile", F.concat_ws("-", "row", "col"))
    return tiles.fetch_windows(p, grid, 1704844800, 7, 4, 1)


@query(f"with {views.POSTS}, {views.QUERY_POINTS}, q as (select *, row_number() over (order by query_idx) - 1 as i from query_points) select i as query_idx, string_agg(cast(id as varchar), ',' order by id) as ids from q join posts on {views.NEAR} group by 1")
def search_file_join(spark, d):
    """Points and queries from one search file, joined; the ids near each query."""
    p, q, path = views.posts(spark, d), views.query_points(spark, d), _folder(spark, "search")
    line = lambda *c: F.concat_ws(" ", *[F.col(x).cast("string") for x in c])
    head = lambda df, n: df.agg(F.count(F.lit(1)).cast("string").alias("value")).select(F.lit(n).alias("part"), F.lit(0).cast("long").alias("at"), "value")
    parts = [head(p, 0), p.select(F.lit(1).alias("part"), F.col("id").alias("at"), line("id", "lat", "lon").alias("value")), head(q, 2), spark.range(1).select(F.lit(3).alias("part"), F.col("id").alias("at"), F.lit("0.5").alias("value")), q.select(F.lit(4).alias("part"), F.col("query_idx").alias("at"), line("qlat", "qlon").alias("value"))]
    writers.write_lines(timeseries.merge_days(parts).orderBy("part", "at").select("value"), path)
    found, asked = readers.read_search(spark, path)
    near = writers.near_lists(asked, found, 0.5)
    return near.select("query_idx", F.array_join(F.from_json("value", "lat double, lon double, ids array<long>")["ids"], ",").alias("ids"))


@query(f"with {views.QUERY_POINTS} select n_name as job, row_number() over (partition by n_name order by s_suppkey) - 1 as query_idx, qlat, qlon, 0.25e0 + n_nationkey / 16e0 as radius, 0.01e0 as robots_threshold from query_points join supplier on s_suppkey = query_idx join nation on n_nationkey = s_nationkey")
def job_settings(spark, d):
    """Settings of one job for each nation, whose points are its suppliers, from their files."""
    path = _folder(spark, "settings")
    s = views.table(spark, d, "supplier").select(F.col("s_suppkey").alias("query_idx"), F.col("s_nationkey").alias("n_nationkey"))
    own = views.query_points(spark, d).join(s, "query_idx").join(views.table(spark, d, "nation"), "n_nationkey")
    gps = F.transform(F.array_sort(F.collect_list(F.struct("query_idx", F.array("qlat", "qlon").alias("at")))), lambda x: x["at"])
    jobs = own.groupBy("n_nationkey", F.col("n_name").alias("job")).agg(gps.alias("gps"))
    writers.write_lines(jobs.select(F.to_json(F.struct("job", (0.25 + F.col("n_nationkey") / 16.0).alias("search_radius"), "gps", F.lit(0.01).alias("robots_threshold"), F.lit("r.tsv").alias("result_file"))).alias("value")), path)
    return settings.job_points(spark, path).select("job", "query_idx", "qlat", "qlon", "radius", "robots_threshold")


# Days and documents


@query(ORACLES["merge_days"])
def day_files_read(spark, d):
    path = _folder(spark, "days")
    writers.write_days(views.table(spark, d, "events").select("event_id", _local_ms("ts").alias("ms")), path, F.col("ms"), compression="gzip")
    return readers.read_days(spark, path, "2024-01-03", "2024-01-05", "event_id long").select("event_id", F.col("dt").cast("string").alias("dt"))


@query("select c_custkey, c_name, c_acctbal from customer")
def backup_round_trip(spark, d):
    path = _folder(spark, "backup")
    rows = views.table(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal")
    writers.back_up(rows, path)
    return spark.read.schema(rows.schema).json(path)


@query("select c_custkey, c_name from customer where c_custkey % 2 = 0")
def full_replace(spark, d):
    rows, path = views.table(spark, d, "customer").select("c_custkey", "c_name"), _folder(spark, "replaced")
    writers.replace_all(rows.where("c_custkey % 2 = 1"), path)
    writers.replace_all(rows.where("c_custkey % 2 = 0"), path)
    return spark.read.parquet(path)


@query(ORACLES["last_write"])
def saved_documents(spark, d):
    """Documents saved in three batches; the latest of each key is read back."""
    e, path = views.table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), _folder(spark, "saved")
    for k in range(3):
        writers.save_documents(spark, e.where(F.col("event_id") % 3 == k), path, "user_id", "event_id")
    return writers.saved(spark, path).select("user_id", "event_id", "event_type", "value")


@query(f"select * from ({ORACLES['last_write']}) x where user_id in (1, 2, 3, 5, 8, 13, 21, 34) and event_id > 100")
def store_scan(spark, d):
    """Some users' documents from the store by its own source, which takes the filters over."""
    path = _folder(spark, "scanned")
    writers.save_documents(spark, views.table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), path, "user_id", "event_id")
    docstore.register(spark)
    return spark.read.format("terravane_store").option("path", path).load().where(F.col("user_id").isin(1, 2, 3, 5, 8, 13, 21, 34) & (F.col("event_id") > 100))


@query("select user_id, cast(day(ts) as int) as day, count(*) as n from events where date_trunc('month', ts) = timestamp '2024-01-01 00:00:00' group by 1, 2")
def timeseries_saved(spark, d):
    """Counts of a month, saved in two parts of the rows; zeros stand for days without any."""
    e, path = views.posts(spark, d), _folder(spark, "series")
    for part in (0, 1):
        writers.save_period(spark, timeseries.period_counts(e.where(F.col("user_id") % 2 == part), "user_id", "ts", 31), path, "user_id", 31)
    every = writers.saved(spark, path).where("period = '2024-01-01'").select("user_id", F.explode("days").alias("day", "n"))
    return every.where("n > 0")


@query("select cast(c_custkey as varchar) as id, 'ids' as file from customer union all select cast(c_custkey as varchar) || ':' || c_name, 'full' from customer")
def ids_and_full_files(spark, d):
    rows, path = views.table(spark, d, "customer").select(F.col("c_custkey").alias("_id"), "c_name"), _folder(spark, "storage")
    writers.write_ids_and_full(rows, path)
    ids = spark.read.schema("_id long").json(f"{path}/ids").select(F.col("_id").cast("string").alias("id"), F.lit("ids").alias("file"))
    return ids.unionByName(spark.read.schema(rows.schema).json(f"{path}/full").select(F.concat_ws(":", "_id", "c_name").alias("id"), F.lit("full").alias("file")))


# Rankings


@query("select l_quantity as f1, l_discount as f2, l_extendedprice as target from lineitem")
def ranking_matrix_scan(spark, d):
    x, path = views.table(spark, d, "lineitem"), _folder(spark, "matrix")
    body = x.select(F.concat_ws(" ", *[F.col(c).cast("double").cast("string") for c in ("l_quantity", "l_discount", "l_extendedprice")]).alias("value"))
    writers.write_lines(spark.createDataFrame([("60000 2",)], "value string").unionByName(body), path)
    return readers.read_matrix(spark, path).select(F.col("features")[0].alias("f1"), F.col("features")[1].alias("f2"), "target")


_S1, _S2 = f"0.5e0 * [1e0, 2e0, -1e0, 0.5e0][{catalog._LEAF1} + 1]", f"0.5e0 * [0.25e0, -0.5e0, 0.125e0, 3e0][{catalog._LEAF2} + 1]"


@query(f"""with s as (select l_orderkey as q, l_linenumber as doc, {_S1} as s1, {_S1} + {_S2} as s2 from lineitem)
select q as query_id, 0 as iteration, string_agg(cast(s1 as varchar), ' ' order by doc, s1) as value from s group by 1 union all select q, 1, string_agg(cast(s2 as varchar), ' ' order by doc, s2) from s group by 1""")
def prediction_file(spark, d):
    path = _folder(spark, "predictions")
    lines = writers.prediction_lines(views.order_rankings(spark, d).withColumn("staged", catalog.MODEL.staged(F.col("features"))))
    writers.write_lines(lines.select(F.concat_ws("\t", "query_id", "iteration", "value").alias("value")), path)
    part = F.split("value", "\t")
    return spark.read.text(path).select(part[0].cast("long").alias("query_id"), part[1].cast("int").alias("iteration"), part[2].alias("value"))


@query("select distinct c_custkey, ('0x' || substr(md5('7:' || c_custkey), 1, 8))::bigint / 4294967296e0 as draw from customer")
def shuffled_rows(spark, d):
    """The draw of each row, by which rows are in a shuffled order that any engine can repeat."""
    return ranking.shuffled(views.table(spark, d, "customer").select("c_custkey").distinct(), "c_custkey", 7)


# Streams


def _raw_files(spark, d, label: str) -> str:
    path = _folder(spark, label)
    writers.back_up(views.raw_posts(spark, d), path)
    return path


_PLACED = "not (event_id % 3 = 0 and event_id % 5 = 1)"


@query(f"select event_id as id, {catalog._CLIENT} as source from events where {_PLACED}")
def stream_saved(spark, d):
    """A stream of raw posts, filtered by area and upserted by id."""
    home = _folder(spark, "stream")
    located = stream.located(stream.raw_stream(spark, _raw_files(spark, d, "stream-in")), EVERYWHERE)
    stream.save(located, f"{home}/store", f"{home}/checkpoint").awaitTermination()
    return writers.saved(spark, f"{home}/store").select(F.col("_id").alias("id"), "source")


@query(f"select event_id as id, strftime(ts, '%Y-%m-%d') as dt from events where {_PLACED}")
def stream_day_files(spark, d):
    """Packed day files of a stream in which every post comes twice; each is written once."""
    home, source = _folder(spark, "stream-days"), _raw_files(spark, d, "stream-days-in")
    views.raw_posts(spark, d).write.mode("append").option("compression", "gzip").json(source)
    located = stream.once(stream.located(stream.raw_stream(spark, source, 1000), EVERYWHERE), "400 days")
    stream.day_files(located, f"{home}/days", f"{home}/checkpoint").awaitTermination()
    return spark.read.schema("_id long, dt string").json(f"{home}/days").select(F.col("_id").alias("id"), "dt")


@query(f"select {catalog._CLIENT} as source, strftime(date_trunc('week', ts), '%Y-%m-%d') as week, cast(isodow(ts) - 1 as int) as day, count(*) as n from events where {_PLACED} group by 1, 2, 3")
def stream_weekly_counts(spark, d):
    home = _folder(spark, "stream-weeks")
    located = stream.located(stream.raw_stream(spark, _raw_files(spark, d, "stream-weeks-in"), 1000), EVERYWHERE)
    counts = stream.weekly_counts(located, "source", "created_at")
    put = lambda batch, _: batch.write.mode("overwrite").parquet(f"{home}/counts")
    counts.writeStream.outputMode("complete").foreachBatch(put).option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("source string, week string, day int, n long").parquet(f"{home}/counts")


@query("""with w as (select user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') as period, cast(isodow(ts) - 1 as int) as day, count(*) as n from events group by all)
select k.user_id, k.period, k.day, coalesce(n, 0) as n from (select distinct user_id, period, unnest([0, 1, 2, 3, 4, 5, 6]) as day from w) k left join w on w.user_id = k.user_id and w.period = k.period and w.day = k.day""")
def stream_closed_weeks(spark, d):
    """Day counters of every user as keyed state; a week comes out, zeros filled in, when it is closed. A last record far ahead closes all weeks."""
    home, e = _folder(spark, "stream-closed"), views.table(spark, d, "events").select("user_id", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    last = e.agg((F.max(F.to_timestamp("at")) + F.expr("interval 60 days")).alias("at")).select(F.lit(-1).cast("long").alias("user_id"), F.date_format("at", "yyyy-MM-dd HH:mm:ss").alias("at"))
    writers.back_up(e, f"{home}/in")
    last.write.mode("append").json(f"{home}/in")
    rows = spark.readStream.schema("user_id long, at string").json(f"{home}/in").withColumn("at", F.to_timestamp("at"))
    closed = counters.closed_periods(rows, "user_id", "at", 7)
    closed.writeStream.format("parquet").option("path", f"{home}/weeks").option("checkpointLocation", f"{home}/checkpoint").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("user_id long, period string, day int, n long").parquet(f"{home}/weeks")


#: Posts of which each part of ``stream_saved_twice`` has a packed file, as one task reads such a file.
PACKED = 100_000


def _files_of(rows: int) -> int:
    """How many files a part has, so that files are bounded and batches are as many for a large table."""
    return max(1, -(-rows // PACKED))


@query(f"select event_id as id, {catalog._CLIENT} as source from events where {_PLACED}")
def stream_saved_twice(spark, d):
    """Every post comes twice, in parts of other sizes and in another order, by two streams into one table."""
    home, source = _folder(spark, "stream-twice"), _folder(spark, "stream-twice-in")
    raw = views.raw_posts(spark, d)
    files = _files_of(raw.count())
    for k, (parts, order) in enumerate(((3, F.col("id")), (2, F.desc("id")))):
        writers.back_up(raw.repartitionByRange(parts * files, order), f"{source}/{k}")
        located = stream.located(stream.raw_stream(spark, f"{source}/{k}", (1 + k) * files), EVERYWHERE)
        stream.save(located, f"{home}/store", f"{home}/checkpoint-{k}").awaitTermination()
    return writers.saved(spark, f"{home}/store").select(F.col("_id").alias("id"), "source")
