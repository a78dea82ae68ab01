"""All queries of the engine with the SQL that states the same results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import geo, osm, posts, times
from terravane.functions.trees import Ensemble, ObliviousTree
from terravane.operators import area_features as af
from terravane.operators import blocks, boosting, movement, point_stats, ranking, tiles, timeseries
from terravane.operators import radius_join as rj
from terravane.operators import venues as vn
from terravane.plans import views
from terravane.sources import readers, shared, writers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

CENTER = (59.93, 30.35)
BOX = geo.Box(59.88, 30.25, 59.98, 30.45)


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL if there is any."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# Points and areas


@query(f"with {views.POSTS} select id from posts where lat > 59.88e0 and lat < 59.98e0 and lon > 30.25e0 and lon < 30.45e0")
def bbox_filter(spark, d):
    return views.posts(spark, d).where(BOX.contains()).select("id")


@query(f"with {views.POSTS} select id, cast(trunc(lat * 1000) as bigint) + cast(trunc(lon * 1000) as bigint) * 10000000 as cell from posts")
def cell_id(spark, d):
    return views.posts(spark, d).select("id", geo.area_cell().alias("cell"))


@query(f"with {views.POSTS} select id, round(6378e0 * acos(least(1e0, sin(radians(lat)) * sin(radians(59.93e0)) + cos(radians(lat)) * cos(radians(59.93e0)) * cos(radians(lon - 30.35e0)))), 6) as km from posts")
def distance_km(spark, d):
    return views.posts(spark, d).select("id", F.round(geo.distance_km(F.col("lat"), F.col("lon"), F.lit(CENTER[0]), F.lit(CENTER[1])), 6).alias("km"))


_JOIN = f"with {views.POSTS}, {views.QUERY_POINTS} select query_idx, id from query_points join posts on {views.NEAR}"


@query(_JOIN)
def radius_join_nested(spark, d):
    return rj.radius_join(views.query_points(spark, d), views.posts(spark, d).select("id", "lat", "lon"), 0.5, "blocks").select("query_idx", "id")


@query(_JOIN)
def radius_join_cell(spark, d):
    return blocks.id_pairs(views.query_points(spark, d), views.posts(spark, d).select("id", "lat", "lon"), 0.5)


@query(f"with {views.POSTS}, {views.QUERY_POINTS}, n as (select query_idx, user_id from query_points join posts on {views.NEAR}) select q.query_idx, count(n.query_idx) as n, count(distinct user_id) as users from query_points q left join n on n.query_idx = q.query_idx group by 1")
def area_counts(spark, d):
    return af.area_counts(views.query_points(spark, d), views.posts(spark, d).select("user_id", "lat", "lon"), 0.5)


def _part_sql(profile) -> str:
    rest = " ".join(f"when hour(ts) >= {a} {'and' if a <= b else 'or'} hour(ts) < {b} then '{n}'" for n, (a, b) in profile.items() if n not in ("AllDay", "all"))
    return f"select event_id as id, case {rest} end as part from events"


@query(_part_sql(times.PROFILE_A))
def daypart_profile_a(spark, d):
    return views.posts(spark, d).select("id", times.part_name(F.col("ts"), times.PROFILE_A).alias("part"))


@query(_part_sql(times.PROFILE_B))
def daypart_profile_b(spark, d):
    return views.posts(spark, d).select("id", times.part_name(F.col("ts"), times.PROFILE_B).alias("part"))


@query(f"with {views.POSTS} " + " union all ".join(f"select '{g}' as grp, count(*) as n, count(distinct user_id) as users from posts where source in ({', '.join(repr(m) for m in members)})" for g, members in posts.GROUPS.items()))
def source_groups(spark, d):
    p = views.posts(spark, d)
    member = F.array_compact(F.array(*[F.when(c, F.lit(g)) for g, c in posts.group_filters(F.col("source")).items()]))
    each = p.select("user_id", F.explode(member).alias("grp"))
    by_user = each.groupBy("grp", "user_id").agg(F.count(F.lit(1)).alias("k"))
    counted = by_user.groupBy("grp").agg(F.sum("k").alias("n"), F.count("user_id").alias("users"))
    names = spark.createDataFrame([(g,) for g in posts.GROUPS], "grp string")
    return names.join(counted, "grp", "left").select("grp", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("users", F.lit(0).cast("long")).alias("users"))


def _features_sql(profile, names) -> str:
    cols = []
    for t, (a, b) in profile.items():
        when = f"(hour(ts) >= {a} {'and' if a <= b else 'or'} hour(ts) < {b})"
        for g, members in posts.GROUPS.items():
            cond = f"{when} and source in ({', '.join(repr(m) for m in members)})"
            cols += [f'count(*) filter (where {cond}) as "{names[0].format(t, g)}"', f'count(distinct user_id) filter (where {cond}) as "{names[1].format(t, g)}"']
    return f"with {views.POSTS}, {views.QUERY_POINTS}, n as (select query_idx, user_id, ts, source from query_points join posts on {views.NEAR}) select q.query_idx, {', '.join(cols)} from query_points q left join n on n.query_idx = q.query_idx group by 1"


@query(_features_sql(times.PROFILE_A, af.NAMES_A))
def area_features_70(spark, d):
    return af.area_features(views.query_points(spark, d), views.posts(spark, d), 0.5)


@query(_features_sql(times.PROFILE_B, af.NAMES_B))
def area_features_pointwise(spark, d):
    return af.area_features(views.query_points(spark, d), views.posts(spark, d), 0.5, times.PROFILE_B, af.NAMES_B)


@query(f"with {views.POSTS}, {views.QUERY_POINTS}, n as (select query_idx from query_points join posts on {views.NEAR}) select q.query_idx, count(n.query_idx) as n from query_points q left join n on n.query_idx = q.query_idx group by 1")
def points_nearby_count(spark, d):
    return point_stats.nearby_count(views.query_points(spark, d), views.posts(spark, d), 0.5)


@query(f"with {views.QUERY_POINTS} select least(59.9e0, min(qlat)) as min_lat, least(30.2e0, min(qlon)) as min_lon, greatest(59.95e0, max(qlat)) as max_lat, greatest(30.6e0, max(qlon)) as max_lon from query_points")
def bbox_expand(spark, d):
    return rj.expanded_box(views.query_points(spark, d), geo.Box(59.9, 30.2, 59.95, 30.6))


@query(f"with {views.POSTS}, {views.QUERY_POINTS}, n as (select query_idx, id from query_points join posts on {views.NEAR}) select query_idx, string_agg(cast(id as varchar), ',' order by id) as ids from n group by 1")
def near_ids(spark, d):
    return writers.near_lists(views.query_points(spark, d), views.posts(spark, d).select("id", "lat", "lon"), 0.5).select("query_idx", F.array_join(F.from_json("value", "lat double, lon double, ids array<long>")["ids"], ",").alias("ids"))


# Movement


@query("with " + views.CELL_EDGES.format(most=43200000) + " select user_id, src, dst, ms, 1e0 as weight from edges")
def edges_consecutive(spark, d):
    return movement.consecutive_edges(views.cell_posts(spark, d))


@query("with " + views.CELL_EDGES.format(most=43200000) + " select src, dst, cast(count(*) as double) as weight from edges group by 1, 2")
def graph_sum(spark, d):
    return movement.passages_graph(views.cell_posts(spark, d))


@query("with " + views.CELL_EDGES.format(most=10800000) + " select src, dst, round(avg(ms // 60000), 9) as weight from edges group by 1, 2")
def graph_mean_minutes(spark, d):
    return movement.minutes_graph(views.cell_posts(spark, d)).withColumn("weight", F.round("weight", 9))


@query("with " + views.CELL_EDGES.format(most=43200000) + " select id, 1e0 as weight from (select src as id from edges union select dst from edges) x")
def vertex_weights(spark, d):
    return movement.vertices(movement.consecutive_edges(views.cell_posts(spark, d)))


@query("with " + views.CELL_EDGES.format(most=43200000) + " select src || chr(9) || dst || chr(9) || count(*) || '.0' as value from edges group by src, dst")
def edge_list(spark, d):
    return writers.edge_lines(movement.passages_graph(views.cell_posts(spark, d)))


# Venues

SEGMENTS = {"automobile": "AUTOMOBILE", "building": "BUILDING", "furniture": "FURNITURE", "machinery": "MACHINERY", "household": "HOUSEHOLD"}
_VENUES = f"with {views.VENUES}, {views.QUERY_POINTS}, n as (select query_idx, category, created, seen from query_points join venues on {views.NEAR}) select q.query_idx, "
_VENUES_END = " from query_points q left join n on n.query_idx = q.query_idx group by 1"


@query(_VENUES + "case when count(n.query_idx) = 0 then 0 else cast(coalesce(sum((epoch_us(seen) // 1000 - epoch_us(created) // 1000) // 1000), 0) as bigint) // (count(n.query_idx) * 86400) end as mean" + _VENUES_END)
def venue_mean_age_days(spark, d):
    return af.venue_features(views.query_points(spark, d), views.venues(spark, d), 0.5, {}).select("query_idx", "mean")


@query(_VENUES + ", ".join(f"count(*) filter (where category = '{c}') as {n}" for n, c in SEGMENTS.items()) + _VENUES_END)
def venue_category_counts(spark, d):
    return af.venue_features(views.query_points(spark, d), views.venues(spark, d), 0.5, SEGMENTS).select("query_idx", *SEGMENTS)


@query(f"with {views.VENUES}, {views.QUERY_POINTS}, n as (select query_idx, v.lat from query_points join venues v on abs(lat - qlat) <= 0.004e0 and abs(lon - qlon) <= 0.004e0) select q.query_idx, count(n.query_idx) as n, round(max(n.lat), 9) as northmost from query_points q left join n on n.query_idx = q.query_idx group by 1")
def box_count(spark, d):
    out = point_stats.box_count(views.query_points(spark, d), views.venues(spark, d).select("lat", "lon"), 0.004, {"northmost": F.max("lat")})
    return out.withColumn("northmost", F.round("northmost", 9))


def _paths(spark, d):
    asked = views.category_tree(spark, d).select("id").unionByName(views.table(spark, d, "customer").select(F.col("c_mktsegment").alias("id")).distinct())
    return vn.category_paths(asked, views.category_tree(spark, d))


_PATHS = f"""with recursive {views.TREE}, asked as (select id from tree union select distinct c_mktsegment from customer),
up as (select id, id as node, id as path from asked union all select up.id, parent_id, path || '>' || parent_id from up join tree on tree.id = up.node where parent_id is not null),
ended as (select up.id as id, up.node as node, up.path as path, case when tree.id is null then 1 else 0 end as missing from up left join tree on tree.id = up.node where tree.id is null or tree.parent_id is null) """


@query(_PATHS + "select id, case when missing = 1 then path || '>?' else path end as path from ended")
def category_paths(spark, d):
    return _paths(spark, d).select("id", F.array_join("path", ">").alias("path"))


@query(_PATHS + "select id, case when missing = 1 then '?' else node end as main from ended")
def main_category(spark, d):
    return _paths(spark, d).select("id", "main")


# Point statistics

_FOLLOWERS = "(event_id * 7907) % 5003"


@query(f"select max(v) as threshold from (select {_FOLLOWERS} as v, row_number() over (order by {_FOLLOWERS} desc) as r, count(*) over () as n from events) x where r = greatest(1, n // 100)")
def robots_threshold(spark, d):
    return point_stats.robots_threshold(views.table(spark, d, "events").select(F.expr(_FOLLOWERS).alias("followers")), "followers", 0.01)


@query(f"""with {views.POSTS}, {views.QUERY_POINTS}, f as (select id, {_FOLLOWERS.replace('event_id', 'id')} as followers, * exclude (id) from posts),
t as (select followers as most from (select followers, row_number() over (order by followers desc) as r, count(*) over () as n from f) x where r = greatest(1, n // 100)),
k as (select f.* from f, t where followers <= most and ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-25 00:00:00'),
n as (select query_idx, user_id from query_points join k on {views.NEAR})
select q.query_idx, count(n.query_idx) as n, count(distinct user_id) as users from query_points q left join n on n.query_idx = q.query_idx group by 1""")
def point_stats_filtered(spark, d):
    p = views.posts(spark, d).withColumn("followers", F.expr(_FOLLOWERS.replace("event_id", "id")))
    most = point_stats.robots_threshold(p, "followers", 0.01)
    kept = p.join(F.broadcast(most), F.col("followers") <= F.col("threshold")).where(point_stats.post_filter(F.col("ts"), _ntz("2024-01-05 00:00:00"), _ntz("2024-01-25 00:00:00")))
    return af.area_counts(views.query_points(spark, d), kept.select("user_id", "lat", "lon"), 0.5)


@query(f"""with {views.POSTS}, {views.QUERY_POINTS}, f as (select id, {_FOLLOWERS.replace('event_id', 'id')} as followers, * exclude (id) from posts),
t as (select followers as most from (select followers, row_number() over (order by followers desc) as r, count(*) over () as n from f) x where r = greatest(1, n // 100)),
k as (select f.* from f, t where followers <= most and ts between timestamp '2024-01-05 00:00:00' and timestamp '2024-01-25 00:00:00'),
m as (select query_idx, id, 6378e0 * acos(least(1e0, sin(radians(lat)) * sin(radians(qlat)) + cos(radians(lat)) * cos(radians(qlat)) * cos(radians(lon - qlon)))) as km from query_points, k),
r as (select *, cast(row_number() over (partition by query_idx order by km, id) as int) as rank from m where km < 2e0)
select query_idx, rank, id, round(km, 6) as km from r where rank <= 8""")
def nearest_filtered(spark, d):
    """The eight posts nearest to each point, nearest first, among those of a span of time whose authors aren't robots."""
    p = views.posts(spark, d).withColumn("followers", F.expr(_FOLLOWERS.replace("event_id", "id")))
    most = point_stats.robots_threshold(p, "followers", 0.01)
    kept = p.join(F.broadcast(most), F.col("followers") <= F.col("threshold")).where(point_stats.post_filter(F.col("ts"), _ntz("2024-01-05 00:00:00"), _ntz("2024-01-25 00:00:00")))
    found = point_stats.nearest(views.query_points(spark, d), kept.select("id", "lat", "lon"), 8, 2.0, 0.25)
    return found.select("query_idx", "rank", "id", F.round("km", 6).alias("km"))


def _ntz(text: str):
    return F.lit(text).cast("timestamp_ntz")


def micros(ts: str):
    """Epoch microseconds of a wall time, whatever the session's time zone."""
    return F.timestamp_diff("MICROSECOND", _ntz("1970-01-01 00:00:00"), F.col(ts).cast("timestamp_ntz"))


# Upserts and time series


@query("select event_id as id, strftime(date_trunc('week', ts), '%Y-%m-%d') as week from events")
def week_suffix(spark, d):
    return views.posts(spark, d).select("id", times.week_suffix(F.col("ts")).alias("week"))


@query("select user_id, strftime(date_trunc('week', ts), '%Y-%m-%d') as week, " + ", ".join(f"count(*) filter (where isodow(ts) = {k + 1}) as d{k}" for k in range(7)) + " from events group by 1, 2")
def timeseries_week_map(spark, d):
    counts = timeseries.period_counts(views.posts(spark, d), "user_id", "ts", 7)
    return timeseries.period_map(counts, "user_id", 7).select("user_id", F.col("period").alias("week"), *[F.col("days")[k].alias(f"d{k}") for k in range(7)])


@query("select user_id, strftime(date_trunc('month', ts), '%Y-%m-%d') as period, cast(day(ts) as int) as day, count(*) as n from events group by 1, 2, 3")
def timeseries_month(spark, d):
    return timeseries.period_counts(views.posts(spark, d), "user_id", "ts", 31)


@query("""with e as (select user_id, event_id, case when event_id % 3 <> 0 then value end as a, case when event_id % 4 <> 0 then event_type end as b from events)
select user_id, max(event_id) as event_id, arg_max(a, event_id) filter (where a is not null) as a, arg_max(b, event_id) filter (where b is not null) as b from e group by 1""")
def upsert_latest(spark, d):
    e = views.table(spark, d, "events").select("user_id", "event_id", F.when(F.col("event_id") % 3 != 0, F.col("value")).alias("a"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("b"))
    return timeseries.upsert(e.where(F.col("event_id") % 2 == 0), e.where(F.col("event_id") % 2 == 1), "user_id", "event_id")


@query("select user_id, max(event_id) as event_id, arg_max(event_type, event_id) as event_type, arg_max(value, event_id) as value from events group by 1")
def last_write(spark, d):
    return timeseries.last_write(views.table(spark, d, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("select c_custkey as id from customer where c_custkey not in (select o_custkey from orders where o_custkey % 5 <> 0)")
def new_ids_anti(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return timeseries.new_ids(c, views.table(spark, d, "orders").where("o_custkey % 5 <> 0").select(F.col("o_custkey").alias("id")), "id")


@query("select c_custkey as id from customer where c_custkey in (select o_custkey from orders)")
def known_ids_semi(spark, d):
    c = views.table(spark, d, "customer").select(F.col("c_custkey").alias("id"))
    return timeseries.known_ids(c, views.table(spark, d, "orders").select(F.col("o_custkey").alias("id")), "id")


@query("select strftime(ts, '%Y-%m-%d') as dt, count(*) as n from events group by 1")
def day_partitions(spark, d):
    day = times.day_name(F.unix_millis(F.col("ts").cast("timestamp")))  # the session's clock on both ways
    return views.table(spark, d, "events").groupBy(day.alias("dt")).agg(F.count(F.lit(1)).alias("n"))


@query("select event_id, strftime(ts, '%Y-%m-%d') as dt from events where ts >= timestamp '2024-01-03 00:00:00' and ts < timestamp '2024-01-06 00:00:00'")
def merge_days(spark, d):
    e = views.table(spark, d, "events").select("event_id", F.date_format("ts", "yyyy-MM-dd").alias("dt"))
    return timeseries.merge_days([e.where(F.col("dt") == day) for day in ("2024-01-03", "2024-01-04", "2024-01-05")])


# Raw records

_CLIENT = "case event_id % 6 when 0 then 'Web' when 1 then 'iPhone' when 2 then 'Web' when 3 then 'instagram' when 4 then 'foursquare' else 'other' end"


@query(f"select event_id as id, {_CLIENT} as source from events")
def source_class(spark, d):
    return views.raw_posts(spark, d).select("id", posts.source_class(F.col("source")).alias("source"))


_MEAN_LAT, _MEAN_LON = "59 + (event_id % 80) / 100.0e0 + 0.25e0", "30 + (event_id % 90) / 100.0e0 + 0.125e0"


@query(f"""select event_id as id, {_CLIENT} as source, cast(event_id % 3 <> 0 as int) as certain_coords,
  round(case when event_id % 3 <> 0 then 59 + (event_id % 50) / 64.0e0 when event_id % 5 <> 1 then {_MEAN_LAT} end, 9) as lat,
  round(case when event_id % 3 <> 0 then 30 + (event_id % 40) / 64.0e0 when event_id % 5 <> 1 then {_MEAN_LON} end, 9) as lon,
  case when event_id % 5 <> 1 then event_id % 1000 else -1 end as followers, case when event_id % 5 <> 1 then 'p' || (event_id % 7) end as place,
  case when event_id % 6 in (3, 4) and event_id % 2 = 0 then 'http://u/' || event_id end as url, strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at from events""")
def normalize_tweets(spark, d):
    return shown_posts(readers.normalised_posts(views.raw_posts(spark, d)))


def shown_posts(n: DataFrame) -> DataFrame:
    at = F.date_format(F.to_utc_timestamp("created_at", F.current_timezone()), "yyyy-MM-dd HH:mm:ss")
    return n.select(F.col("_id").alias("id"), "source", "certain_coords", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"), F.coalesce("user.followers_count", F.lit(-1).cast("long")).alias("followers"), F.col("place.id").alias("place"), "url", at.alias("created_at"))


@query(f"select event_id as id, round({_MEAN_LAT}, 9) as lat, round({_MEAN_LON}, 9) as lon from events where event_id % 5 <> 1")
def bbox_centroid(spark, d):
    corners = F.get("place.bounding_box.coordinates", F.lit(0))
    return views.raw_posts(spark, d).where("place is not null").select("id", F.round(posts.corner_mean(corners, 1), 9).alias("lat"), F.round(posts.corner_mean(corners, 0), 9).alias("lon"))


@query("select event_id as id, epoch_us(ts) // 1000 as created_at from events")
def parse_shell_json(spark, d):
    ms = F.expr("timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', ts)")
    line = F.concat(F.lit('{"_id" : NumberLong('), F.col("event_id"), F.lit('), "created_at" : Date( '), ms, F.lit(" )}"))
    rows = views.table(spark, d, "events").select(readers.without_shell_calls(line).alias("line"))
    return rows.select(F.from_json("line", "_id long, created_at long").alias("r")).select(F.col("r._id").alias("id"), "r.created_at")


@query("select distinct user_id as id from events")
def distinct_ids(spark, d):
    return views.table(spark, d, "events").select(F.col("user_id").alias("id")).distinct()


@query("select s_suppkey as id, case when s_suppkey % 3 = 0 then 0.75e0 else 0.5e0 end as radius, s_suppkey + 0.5e0 as qlat from supplier where s_suppkey % 4 <> 0")
def point_lines(spark, d):
    k = F.col("s_suppkey")
    line = F.when(k % 4 == 0, F.lit("bad\tline")).otherwise(F.concat_ws("\t", (k + 0.5).cast("string"), k.cast("string"), F.when(k % 3 == 0, "0.75")))
    points = readers.points_of(views.table(spark, d, "supplier").select(line.alias("value")))
    return points.select(F.col("qlon").cast("long").alias("id"), "radius", "qlat")


@query("select event_id as id, event_id % 90 + 0.5e0 as lat, event_id % 180 + 0.25e0 as lon, event_id * 1000 as ms from events")
def reversed_posts(spark, d):
    k = F.col("event_id")
    old = views.table(spark, d, "events").select(k.alias("_id"), F.struct(F.lit("Point").alias("type"), F.array(k % 90 + 0.5, k % 180 + 0.25).alias("coordinates")).alias("geo"), k.alias("created_at"))
    return readers.reversed_posts(old).select(F.col("_id").alias("id"), F.col("geo.coordinates")[1].alias("lat"), F.col("geo.coordinates")[0].alias("lon"), F.unix_millis("created_at").alias("ms"))


# Map places

_KEYS = ("amenity", "highway", "railway", "tourism", "shop", "charge", "emergency", "office")
_VALUES = ("bench", "bus_stop", "station", "hotel", "yes", "phone", "cafe")


def _tags(spark, d):
    of = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (k % len(names) + 1).cast("int"))
    return views.table(spark, d, "part").select("p_partkey", of(_KEYS, F.col("p_partkey")).alias("k"), of(_VALUES, F.floor(F.col("p_partkey") / 8)).alias("v"))


@query(f"""with t as (select p_partkey, {list(_KEYS)!r}[p_partkey % 8 + 1] as k, {list(_VALUES)!r}[(p_partkey // 8) % 7 + 1] as v from part)
select p_partkey, (k in ('shop', 'office')) or (k = 'amenity' and v <> 'bench') or (k = 'highway' and v = 'bus_stop') or (k = 'railway' and v = 'station') or (k = 'tourism' and v <> 'yes') or (k = 'emergency' and v = 'phone') as accepted from t""")
def osm_accept(spark, d):
    return _tags(spark, d).select("p_partkey", osm.accepted(F.col("k"), F.col("v")).alias("accepted"))


_AMENITY = ("bar", "language school", "fast_food", "beauty", None, "university")
_SHOP, _TOURISM, _TRANSPORT = (None, "convenience", "beauty", "bakery"), (None, "museum"), (None, "platform", "subway")


def _places(spark, d):
    k = F.col("p_partkey")
    of = lambda names, n: F.element_at(F.array(*[F.lit(x).cast("string") for x in names]), (n % len(names) + 1).cast("int"))
    cols = {"amenity": of(_AMENITY, k), "shop": of(_SHOP, F.floor(k / 6)), "tourism": of(_TOURISM, F.floor(k / 24)), "transport": of(_TRANSPORT, F.floor(k / 48)), "atm": F.when(k % 11 == 0, "yes"), "craft": F.when(k % 13 == 0, "any"), "office": F.when(k % 17 == 0, "any"), "leisure": F.when(k % 19 == 0, "sports_centre")}
    return views.table(spark, d, "part").select("p_partkey", *[c.alias(n) for n, c in cols.items()])


def _sql_list(names) -> str:
    return "[" + ", ".join("null" if n is None else f"'{n}'" for n in names) + "]"


_GIVEN = {
    "Arts & Entertainment": "t = 'museum'", "Museum": "t = 'museum'", "College & University": "a in ('language school', 'university')", "Food": "a = 'fast_food'", "Bakery": "s = 'bakery'", "Fast Food Restaurant": "a = 'fast_food'",
    "Professional & Other Places": "k % 17 = 0", "Office": "k % 17 = 0", "Nightlife Spot": "a = 'bar'", "Bar": "a = 'bar'", "Shop & Service": "s is not null or a = 'beauty' or k % 11 = 0 or k % 13 = 0 or k % 19 = 0",
    "Arts & Crafts Store": "k % 13 = 0", "ATM": "k % 11 = 0", "Convenience Store": "s = 'convenience'", "Gym / Fitness Center": "k % 19 = 0", "Travel & Transport": "x is not null", "Subway": "x = 'subway'", "Train Station": "x = 'platform'", "Platform": "x = 'platform'",
}


@query(f"""with p as (select p_partkey as k, {_sql_list(_AMENITY)}[p_partkey % 6 + 1] as a, {_sql_list(_SHOP)}[(p_partkey // 6) % 4 + 1] as s, {_sql_list(_TOURISM)}[(p_partkey // 24) % 2 + 1] as t, {_sql_list(_TRANSPORT)}[(p_partkey // 48) % 3 + 1] as x from part)
select k as p_partkey, concat_ws('|', {", ".join(f"case when {c} then '{n}' end" for n, c in _GIVEN.items())}) as categories from p""")
def osm_categories(spark, d):
    return _places(spark, d).select("p_partkey", F.array_join(osm.categories(), "|").alias("categories"))


@query("select p_partkey, coalesce(case when p_partkey % 3 = 0 then 'h' end, case when p_partkey % 5 = 0 then 't' end, case when p_partkey % 7 = 0 then 's' end, case when p_partkey % 2 = 0 then 'r' end, case when p_partkey % 11 = 0 then 'p' end) as transport, coalesce(case when p_partkey % 4 = 0 then 'n' end, p_brand) as operator from part")
def osm_transport(spark, d):
    when = lambda n, v: F.when(F.col("p_partkey") % n == 0, v)
    p = views.table(spark, d, "part").select("p_partkey", when(3, "h").alias("highway"), when(5, "t").alias("transport"), when(7, "s").alias("station"), when(2, "r").alias("railway"), when(11, "p").alias("public_transport"), when(4, "n").alias("network"), F.col("p_brand").alias("operator"))
    return p.select("p_partkey", osm.transport_kind().alias("transport"), osm.run_by().alias("operator"))


# Tiles


TILES = f"""{views.POSTS}, c as (select radians(min(lat)) as south, radians(max(lat)) as north, radians(min(lon)) as west, radians(max(lon)) as east, {{side}}e0 / 6378e0 as dy from posts),
r as (select i as row, south + i * dy as lat, dy, west, east, dy / cos(south + i * dy) as dx from c, range(0, 64) t(i) where i <= floor((north - south) / dy)),
t as (select row, j as col, lat, dy, dx, west + j * dx as lon from r, range(0, 128) u(j) where j <= floor((east - west) / dx))"""


def posts_tiles(spark, d, side_km: float = 0.75) -> DataFrame:
    """Tiles over the extent of all posts."""
    return tiles.tiles(spark, side_km, tiles.extent(views.posts(spark, d)))


@query(f"with {TILES.format(side=0.75)} select round(degrees(lat), 9) as left_lat, round(degrees(lon), 9) as left_lon, round(degrees(lat + dy), 9) as right_lat, round(degrees(lon + dx), 9) as right_lon, round(0.6e0 * sqrt(2e0) * 0.75e0, 9) as r from t")
def tile_grid(spark, d):
    return posts_tiles(spark, d).select(*[F.round(c, 9).alias(c) for c in ("left_lat", "left_lon", "right_lat", "right_lon", "r")])


@query(f"with {views.QUERY_POINTS} select query_idx, part, round(qlat - 0.1e0 + part * 0.05e0, 9) as south, round(qlat - 0.1e0 + (part + 1) * 0.05e0, 9) as north, round(qlon - 0.1e0, 9) as west, round(qlon + 0.1e0, 9) as east from query_points, (select unnest([0, 1, 2, 3]) as part) p")
def split_area(spark, d):
    q = views.query_points(spark, d).select("query_idx", (F.col("qlat") - 0.1).alias("south"), (F.col("qlat") + 0.1).alias("north"), (F.col("qlon") - 0.1).alias("west"), (F.col("qlon") + 0.1).alias("east"))
    return tiles.split_area(q, 4, True).select("query_idx", "part", *[F.round(c, 9).alias(c) for c in ("south", "north", "west", "east")])


@query(f"""with {views.QUERY_POINTS}, q as (select *, unnest(['a', 'b', 'c', 'd']) as part from query_points)
select query_idx, part, round(qlat + case when part in ('c', 'd') then 0.1e0 else 0e0 end, 9) as left_lat, round(qlon + case when part in ('b', 'd') then 0.2e0 else 0e0 end, 9) as left_lon, 0.25e0 as r from q""")
def quadrants(spark, d):
    q = views.query_points(spark, d).select("query_idx", F.col("qlat").alias("left_lat"), F.col("qlon").alias("left_lon"), (F.col("qlat") + 0.2).alias("right_lat"), (F.col("qlon") + 0.4).alias("right_lon"), F.lit(0.0).alias("center_lat"), F.lit(0.0).alias("center_lon"), F.col("radius").alias("r"))
    return tiles.quadrants(q).select("query_idx", "part", F.round("left_lat", 9).alias("left_lat"), F.round("left_lon", 9).alias("left_lon"), "r")


_REFINE = f"""{views.POSTS}, g as (select s::int as depth, pow(3e0, s)::bigint as k from range(0, 7) r(s)),
cells as (select depth, k, least(floor((lat - {views.LAT}e0) / {views.LAT_SIZE}e0 * k), k - 1)::bigint as y, least(floor((lon - {views.LON}e0) / {views.LON_SIZE}e0 * k), k - 1)::bigint as x, count(*) as n
  from posts, g where lat between {views.LAT}e0 and {views.LAT}e0 + {views.LAT_SIZE}e0 and lon between {views.LON}e0 and {views.LON}e0 + {views.LON_SIZE}e0 group by all),
boxes as (select 0 as depth, 0::bigint as y, 0::bigint as x union all select depth + 1, y * 3 + a, x * 3 + b from cells, range(0, 3) p(a), range(0, 3) q(b) where n >= 50 and depth < 6),
found as (select boxes.depth, boxes.y, boxes.x, coalesce(n, 0) as n, pow(3e0, boxes.depth) as k from boxes left join cells on cells.depth = boxes.depth and cells.y = boxes.y and cells.x = boxes.x)
select round({views.LAT}e0 + y * ({views.LAT_SIZE}e0 / k), 9) as south, round({views.LAT}e0 + (y + 1) * ({views.LAT_SIZE}e0 / k), 9) as north, round({views.LON}e0 + x * ({views.LON_SIZE}e0 / k), 9) as west, round({views.LON}e0 + (x + 1) * ({views.LON_SIZE}e0 / k), 9) as east,
  depth, n from found where n < 50 or depth = 6"""


@query(f"with {_REFINE}")
def adaptive_refine(spark, d):
    box = geo.Box(views.LAT, views.LON, views.LAT + views.LAT_SIZE, views.LON + views.LON_SIZE)
    out = tiles.refine(views.posts(spark, d), box, 3, 50)
    return out.select(*[F.round(c, 9).alias(c) for c in ("south", "north", "west", "east")], "depth", "n")


# Ranking


@query("select l_suppkey as query_id, l_orderkey, l_linenumber, cast(dense_rank() over (partition by l_suppkey order by l_extendedprice) as int) as rank from lineitem")
def dense_rank_asc(spark, d):
    return ranking.dense_ranks(views.supplier_rankings(spark, d)).select("query_id", "l_orderkey", "l_linenumber", "rank")


_TIES = ("l_orderkey", "l_linenumber", "l_partkey", "target")


@query("""with r as (select l_suppkey as query_id, dense_rank() over (partition by l_suppkey order by l_extendedprice) as rank, count(*) over (partition by l_suppkey) as n,
  row_number() over (partition by l_suppkey order by l_quantity, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as p, row_number() over (partition by l_suppkey order by l_extendedprice) as b from lineitem),
g as (select query_id, p, b, pow(2e0, (n - rank + 1) / cast(n as double)) - 1 as g from r)
select query_id, round(sum(case when p <= 10 then g / log2(p + 1) end) / sum(case when b <= 10 then g / log2(b + 1) end), 9) as ndcg from g group by 1""")
def ndcg_at_k(spark, d):
    return ranking.ndcg(views.supplier_rankings(spark, d), 10, ties=_TIES).select("query_id", F.round("ndcg", 9).alias("ndcg"))


def _weights_sql(w: str) -> str:
    return f"""with r as (select l_orderkey as q, l_linenumber as doc, l_extendedprice as t, dense_rank() over (partition by l_orderkey order by l_extendedprice) as rank from lineitem),
p as (select a.q as query_id, a.doc as i, b.doc as j, {w} as w from r a join r b on a.q = b.q and a.t < b.t)
select query_id, i, j, round(w / sum(w) over (partition by query_id), 9) as w from p"""


def _weights(spark, d, kind):
    return ranking.pair_weights(views.order_rankings(spark, d), kind).withColumn("w", F.round("w", 9))


@query(_weights_sql("1e0"))
def weights_equal(spark, d):
    return _weights(spark, d, "equal")


@query(_weights_sql("ln(1e0 + b.rank - a.rank)"))
def weights_rank(spark, d):
    return _weights(spark, d, "rank")


@query(_weights_sql("ln(1e0 + b.t - a.t)"))
def weights_diff(spark, d):
    return _weights(spark, d, "diff")


@query("""with r as (select l_orderkey as q, l_linenumber as doc, l_extendedprice as t, dense_rank() over (partition by l_orderkey order by l_extendedprice) as rank, count(*) over (partition by l_orderkey) as n,
  row_number() over (partition by l_orderkey order by l_extendedprice, l_linenumber) as p from lineitem),
g as (select *, pow(2e0, (n - rank + 1) / cast(n as double)) - 1 as g, 1 / log2(p + 1) as d from r),
o as (select *, sum(g * d) over (partition by q) as ideal from g),
w as (select a.q as query_id, a.doc as i, b.doc as j, exp(-(1 - (a.ideal - a.g * a.d - b.g * b.d + a.g * b.d + b.g * a.d) / a.ideal)) as w from o a join o b on a.q = b.q and a.t < b.t)
select query_id, i, j, round(w / sum(w) over (partition by query_id), 9) as w from w""")
def weights_ndcg(spark, d):
    return _weights(spark, d, "ndcg")


@query("""with c as (select cast(l_quantity as bigint) % 3 as a, cast(floor(l_quantity * (1 + l_discount * 10) + 0.25e0) as bigint) % 3 as b from lineitem), n as (select count(*) as t, count(*) filter (where a = b) as s from c),
e as (select sum(x.n * y.n) as pairs from (select a, count(*) as n from c group by 1) x join (select b, count(*) as n from c group by 1) y on x.a = y.b)
select round((s / cast(t as double) - pairs / (cast(t as double) * t)) / (1 - pairs / (cast(t as double) * t)), 9) as kappa from n, e""")
def kappa(spark, d):
    c = views.table(spark, d, "lineitem").select((F.col("l_quantity").cast("long") % 3).alias("real"), (F.floor(F.col("l_quantity") * (1 + F.col("l_discount") * 10) + 0.25) % 3).alias("predicted"))
    return ranking.kappa(c).select(F.round("kappa", 9).alias("kappa"))


@query("select feature, count(distinct v) as levels from (select 0 as feature, l_quantity as v from lineitem union all select 1, l_discount from lineitem union all select 2, l_tax from lineitem) x group by 1")
def feature_levels(spark, d):
    return ranking.feature_levels(views.order_rankings(spark, d))


@query("select position, round(avg(v), 9) as mean from (select 0 as position, l_quantity as v from lineitem union all select 1, l_discount from lineitem union all select 2, l_tax from lineitem) x group by 1")
def position_means(spark, d):
    return ranking.position_means(views.order_rankings(spark, d), "features").withColumn("mean", F.round("mean", 9))


@query("select l_orderkey as query_id, l_linenumber as doc_id, round((l_quantity + l_discount + l_tax) / 3, 9) as mean from lineitem")
def row_means(spark, d):
    o = views.order_rankings(spark, d)
    return o.select("query_id", "doc_id", F.round(ranking.row_means(o, "features"), 9).alias("mean"))


@query("with m as (select cast(unnest([0, 1, 2]) as int) as position, unnest([avg(l_quantity), avg(l_discount), avg(l_tax)]) as mean from lineitem) select position, round(mean, 9) as mean from m order by mean desc, position limit 1")
def best_position(spark, d):
    best = ranking.best_position(ranking.position_means(views.order_rankings(spark, d), "features"))
    return best.withColumn("mean", F.round("mean", 9))


@query("select query_id, l_orderkey, l_linenumber, position from (select l_suppkey as query_id, l_orderkey, l_linenumber, cast(row_number() over (partition by l_suppkey order by l_quantity, l_orderkey, l_linenumber, l_partkey, l_extendedprice) as int) as position from lineitem) x where position <= 10")
def top_by_prediction(spark, d):
    order = ["prediction", "l_orderkey", "l_linenumber", "l_partkey", "target"]
    return ranking.positions(views.supplier_rankings(spark, d), order).where(F.col("position") <= 10).select("query_id", "l_orderkey", "l_linenumber", "position")


MODEL = Ensemble((ObliviousTree((0, 1), (25.0, 0.05), (1.0, 2.0, -1.0, 0.5)), ObliviousTree((2, 0), (0.04, 10.0), (0.25, -0.5, 0.125, 3.0))), 0.5)
_LEAF1, _LEAF2 = "(cast(l_quantity > 25 as int) + 2 * cast(l_discount > 0.05e0 as int))", "(cast(l_tax > 0.04e0 as int) + 2 * cast(l_quantity > 10 as int))"


@query(f"select l_orderkey as query_id, l_linenumber as doc_id, [1e0, 2e0, -1e0, 0.5e0][{_LEAF1} + 1] as value from lineitem")
def oblivious_tree_predict(spark, d):
    return views.order_rankings(spark, d).select("query_id", "doc_id", MODEL.trees[0].value(F.col("features")).alias("value"))


@query(f"select l_orderkey as query_id, l_linenumber as doc_id, 0.5e0 * [1e0, 2e0, -1e0, 0.5e0][{_LEAF1} + 1] as s1, 0.5e0 * [1e0, 2e0, -1e0, 0.5e0][{_LEAF1} + 1] + 0.5e0 * [0.25e0, -0.5e0, 0.125e0, 3e0][{_LEAF2} + 1] as s2 from lineitem")
def staged_predict(spark, d):
    s = views.order_rankings(spark, d).withColumn("s", MODEL.staged(F.col("features")))
    return s.select("query_id", "doc_id", F.col("s")[0].alias("s1"), F.col("s")[1].alias("s2"))


@query()
def boost_fit_ndcg(spark, d):
    docs = views.order_rankings(spark, d)
    model = boosting.fit(docs, boosting.Settings())
    return boosting.staged_ndcg(docs, model)
