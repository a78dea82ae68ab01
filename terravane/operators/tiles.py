"""Tiles of a box, strips of an area, quadrants of a tile, and refinement of cells that hold too much."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.functions import geo
from terravane.operators import radius_join
from terravane.sources import shared

#: Fixed value: a tile's circle reaches a little beyond its corners.
COVER = 0.6 * math.sqrt(2)


def tiles(spark: SparkSession, side_km: float, box: geo.Box, compat: bool = False) -> DataFrame:
    """Tiles of about ``side_km`` over the box: left_lat, left_lon, right_lat, right_lon, center_lat, center_lon, r, row, col.

    Rows go up from the south in equal steps of latitude; a row's step of longitude follows from its latitude. ``compat`` steps
    by side / (2 pi R) and by side / R * cos(lat) instead of side / R and side / (R cos(lat)).
    """
    south, north, west, east = (math.radians(x) for x in (box.min_lat, box.max_lat, box.min_lon, box.max_lon))
    dy = side_km / (2 * math.pi * geo.EARTH_KM) if compat else side_km / geo.EARTH_KM
    rows = spark.range(math.floor(abs(north - south) / dy) + 1).select(F.col("id").alias("row"), (F.lit(south) + F.col("id") * F.lit(dy)).alias("lat"))
    dx = F.lit(side_km / geo.EARTH_KM) * F.cos("lat") if compat else F.lit(side_km / geo.EARTH_KM) / F.cos("lat")
    rows = rows.withColumn("dx", dx)
    rows = rows.withColumn("col", F.explode(F.sequence(F.lit(0).cast("long"), F.floor(F.lit(abs(east - west)) / F.col("dx"))))).withColumn("lon", F.lit(west) + F.col("dx") * F.col("col"))
    deg = F.degrees
    return rows.select(
        deg("lat").alias("left_lat"), deg("lon").alias("left_lon"), deg(F.col("lat") + dy).alias("right_lat"), deg(F.col("lon") + F.col("dx")).alias("right_lon"),
        deg(F.col("lat") + dy / 2).alias("center_lat"), deg(F.col("lon") + F.col("dx") / 2).alias("center_lon"), F.lit(COVER * side_km).alias("r"), "row", "col",
    )


def extent(points: DataFrame, lat: str = "lat", lon: str = "lon") -> geo.Box:
    """The smallest box that holds all points: one scan with map-side minima and maxima."""
    r = points.agg(F.min(lat), F.min(lon), F.max(lat), F.max(lon)).first()
    if r[0] is None or r[1] is None:
        raise ValueError("there is no point with coordinates")
    return geo.Box(*map(float, r))


def quadrants(tiles: DataFrame) -> DataFrame:
    """The four quarters of each tile, of half the radius; part is a (south-west), b (south-east), c (north-west) or d."""
    mid_lat, mid_lon = (F.col("left_lat") + F.col("right_lat")) / 2, (F.col("left_lon") + F.col("right_lon")) / 2
    low, high = (F.col("left_lat"), mid_lat), (mid_lat, F.col("right_lat"))
    left, right = (F.col("left_lon"), mid_lon), (mid_lon, F.col("right_lon"))

    def quarter(part: str, lat, lon):
        return F.struct(
            F.lit(part).alias("part"), lat[0].alias("left_lat"), lon[0].alias("left_lon"), lat[1].alias("right_lat"), lon[1].alias("right_lon"),
            ((lat[0] + lat[1]) / 2).alias("center_lat"), ((lon[0] + lon[1]) / 2).alias("center_lon"), (F.col("r") / 2).alias("r"),
        )

    rest = [c for c in tiles.columns if c not in ("left_lat", "left_lon", "right_lat", "right_lon", "center_lat", "center_lon", "r")]
    return tiles.select(*rest, F.explode(F.array(quarter("a", low, left), quarter("b", low, right), quarter("c", high, left), quarter("d", high, right))).alias("q")).select(*rest, "q.*")


def split_area(areas: DataFrame, parts: int, horizontal: bool) -> DataFrame:
    """Strips of areas (south, north, west, east): rows if ``horizontal``, columns otherwise; part counts from the south or west."""
    low, high = ("south", "north") if horizontal else ("west", "east")
    first, last = F.least(low, high), F.greatest(low, high)
    step = (last - first) / parts
    rows = areas.withColumns({"_first": first, "_step": step}).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumns({low: F.col("_first") + F.col("part") * F.col("_step"), high: F.col("_first") + (F.col("part") + 1) * F.col("_step")}).drop("_first", "_step")


def backward_windows(tiles: DataFrame, end: int, days: int) -> DataFrame:
    """Each tile with the windows of one day that end at ``end`` (epoch seconds), one day before it, and so on: back, since, until."""
    back = F.explode(F.sequence(F.lit(0), F.lit(days - 1))).alias("back")
    until = (F.lit(end) - F.col("back") * 86_400).cast("long")
    return tiles.select("*", back).withColumn("since", until - 86_400).withColumn("until", until)


_TILE = ["left_lat", "left_lon", "right_lat", "right_lon", "center_lat", "center_lon", "r"]


def fetch_windows(posts: DataFrame, tiles: DataFrame, end: int, days: int, limit: int, splits: int = 2, us: str = "us", key: str = "id", tile: str = "tile") -> DataFrame:
    """(tile, path, back, id, us, cut): what asking every tile for every day before ``end`` gives, from the last day back.

    A window is a tile's circle and a day, [until - 1 day, until) in epoch microseconds. One that holds ``limit`` posts or more is full: what it gives may not be
    all, so its quarters are asked in its place, and theirs, up to ``splits`` times; ``path`` has the quarters' letters. A window that is still
    full then gives its latest ``limit`` posts and is marked as cut. Circles overlap, so a post can come from several windows; a save by id keeps one.

    Posts get the cell of a grid and a day by arithmetic and meet tiles by an equi-join on both. Only tiles with posts make rows, and only full
    windows are asked again; each level counts its windows with map-side sums, and no window is gathered in one task but for its latest posts, which Spark limits
    before they are shuffled.
    """
    home, spark = shared.work_dir(posts.sparkSession, "windows"), posts.sparkSession
    day = 86_400_000_000
    back = F.floor((F.lit(end * 1_000_000) - F.col(us) - 1) / F.lit(day)).cast("int")
    placed = posts.select(F.col(key).alias("id"), F.col(us).alias("us"), "lat", "lon", back.alias("back")).where(F.col("back").between(0, days - 1) & F.col("lat").isNotNull() & F.col("lon").isNotNull())
    open_ = tiles.select(F.col(tile).alias("tile"), F.lit("").alias("path"), *_TILE)
    window, largest, done = ["tile", "path", "back"], tiles.agg(F.max("r")).first()[0] or 1.0, []
    for level in range(splits + 1):
        height = radius_join.cell_height(largest / 2**level)
        asked = radius_join.reached_cells(open_, height, "center_lat", "center_lon", "r").select(*[c for c in open_.columns if c in (*window, "center_lat", "center_lon", "r")], "_row", "_cell")
        met = radius_join.with_cells(placed, height).join(asked, ["_row", "_cell", "back"] if level else ["_row", "_cell"])
        hits = shared.stored(met.where(geo.within_km(F.col("lat"), F.col("lon"), F.col("center_lat"), F.col("center_lon"), F.col("r"))).select(*window, "id", "us"), f"{home}/{level}")
        full = hits.groupBy(*window).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= limit).drop("n")
        done.append(hits.join(full, window, "left_anti").withColumn("cut", F.lit(False)))
        if level == splits:
            latest = Window.partitionBy(*window).orderBy(F.desc("us"), "id")
            rest = hits.join(full, window, "left_semi").withColumn("_p", F.row_number().over(latest)).where(F.col("_p") <= limit).drop("_p")
            done.append(rest.withColumn("cut", F.lit(True)))
        else:
            open_ = shared.stored(quadrants(open_.join(full, window[: 3 if level else 2])).withColumn("path", F.concat("path", "part")).drop("part"), f"{home}/open-{level + 1}")
    return reduce(DataFrame.unionByName, done)


def refine(points: DataFrame, area: geo.Box, parts: int, limit: int, smallest: float = 0.001, max_depth: int = 20) -> DataFrame:
    """(south, north, west, east, depth, n): areas that hold fewer than ``limit`` points, or are too small to be split.

    An area that holds as many is split into parts by parts areas. Points are counted once, in the cells of the finest grid; a cell's
    number has the numbers of all areas around it as prefixes, so sums over prefixes give every level. An area is one of the
    result if the one around it is full and it isn't, so no level waits for the one before: one scan, whatever the depth. A point on a
    border belongs to the area north or east of it; points on the far borders of the whole belong to the last areas.
    """
    height, width, depth = area.max_lat - area.min_lat, area.max_lon - area.min_lon, 0
    while depth < max_depth and not (height / parts**depth < smallest and width / parts**depth < smallest) and parts ** (depth + 1) < 1 << 53:
        depth += 1
    n = parts**depth
    at = lambda c, low, size: F.least(F.floor((F.col(c) - low) / size * n), F.lit(n - 1)).cast("long")
    inside = points.where(F.col("lat").between(area.min_lat, area.max_lat) & F.col("lon").between(area.min_lon, area.max_lon))
    finest = inside.select(at("lat", area.min_lat, height).alias("y"), at("lon", area.min_lon, width).alias("x")).groupBy("y", "x").agg(F.count(F.lit(1)).alias("n"))
    level = F.array(*[F.struct(F.lit(k).alias("depth"), F.lit(parts ** (depth - k)).cast("long").alias("size")) for k in range(depth + 1)])
    each = finest.withColumn("l", F.explode(level)).select(F.col("l.depth").alias("depth"), F.expr("y div l.size").alias("y"), F.expr("x div l.size").alias("x"), "n")
    counted = each.groupBy("depth", "y", "x").agg(F.sum("n").alias("n"))
    child = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long")))
    full = counted.where((F.col("n") >= limit) & (F.col("depth") < depth))
    below = full.withColumn("dy", child).withColumn("dx", child).select((F.col("depth") + 1).alias("depth"), (F.col("y") * parts + F.col("dy")).alias("y"), (F.col("x") * parts + F.col("dx")).alias("x"))
    whole = points.sparkSession.range(1).select(F.lit(0).alias("depth"), F.col("id").alias("y"), F.col("id").alias("x"))
    now = whole.unionByName(below).join(counted, ["depth", "y", "x"], "left").withColumn("n", F.coalesce("n", F.lit(0).cast("long")))
    ended, size = now.where((F.col("n") < limit) | (F.col("depth") == depth)), F.pow(F.lit(float(parts)), F.col("depth"))
    side = lambda low, of, k: F.lit(low) + k * (F.lit(of) / size)
    return ended.select(
        side(area.min_lat, height, F.col("y")).alias("south"), side(area.min_lat, height, F.col("y") + 1).alias("north"), side(area.min_lon, width, F.col("x")).alias("west"), side(area.min_lon, width, F.col("x") + 1).alias("east"), "depth", "n",
    )
