"""Statistics of single points: robots, filters and nearby counts."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType, LongType, StructField, StructType

from terravane.functions import geo
from terravane.operators import blocks
from terravane.operators.radius_join import radius_join
from terravane.sources import shared


#: Bins of a pass of ``kth_largest``, and the number of values that may be sorted at its end.
BINS = 1 << 14
FEW = 1 << 14


def kth_largest(rows: DataFrame, value: str, k: int) -> int | float | None:
    """The k-th largest value, counted with repeats; null without so many. Nulls don't count, NaN is the largest double.

    Selection by narrowing: a pass counts the values of a range in ``BINS`` equal parts, a map-side sum, and goes on in the part that holds the
    k-th. Whole numbers below 2**62 take at most five passes. No task sorts more than ``FEW`` values, and the driver gets one row for each bin.
    """
    own = rows.where(F.col(value).isNotNull()).select(F.col(value).alias("v"))
    if isinstance(own.schema["v"].dataType, (DoubleType, FloatType)):
        ends = {r["v"]: r["n"] for r in own.where(F.isnan("v") | (F.abs("v") == math.inf)).groupBy(F.col("v").cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).collect()}
        for name, v in (("NaN", math.nan), ("Infinity", math.inf)):
            if 1 <= k <= ends.get(name, 0):
                return v
            k -= ends.get(name, 0)
        finite = own.where(~F.isnan("v") & (F.abs("v") < math.inf))
        if ends.get("-Infinity") and finite.count() < k <= finite.count() + ends["-Infinity"]:
            return -math.inf
        own, whole = finite, False
    else:
        own, whole = own.select(F.col("v").cast("long").alias("v")), True
    low, high, n = own.agg(F.min("v"), F.max("v"), F.count(F.lit(1))).first()
    if not 1 <= k <= n:
        return None
    while low < high:
        inside = own.where(F.col("v").between(F.lit(low), F.lit(high)))
        if n <= FEW:
            return sorted((r["v"] for r in inside.collect()), reverse=True)[k - 1]
        if whole:
            width = -(-(high - low + 1) // BINS)
            part = F.floor((F.col("v").cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)")) if high - low >= 1 << 52 else F.floor((F.col("v") - low) / width)
        else:
            width = max(high / BINS - low / BINS, math.ulp(0.0))
            part = F.least(F.floor((F.col("v") - low) / width), F.lit(BINS - 1))
        counted = inside.groupBy(part.cast("int").alias("part")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).collect()
        for r in sorted(counted, key=lambda r: -r["part"]):
            if k <= r["n"]:
                low, high, n = r["low"], r["high"], r["n"]
                break
            k -= r["n"]
    return low


def robots_threshold(posts: DataFrame, followers: str, fraction: float) -> DataFrame:
    """One row: the k-th largest number of followers, k the fraction of all rows and at least 1; null for an empty table."""
    k = max(1, math.floor(posts.count() * fraction))
    kind = posts.schema[followers].dataType
    return posts.sparkSession.createDataFrame([(kth_largest(posts, followers, k),)], StructType([StructField("threshold", DoubleType() if isinstance(kind, (DoubleType, FloatType)) else LongType())]))


def post_filter(ts: Column, start, end, followers: Column | None = None, threshold: Column | None = None) -> Column:
    """Times from start to end, both inclusive, and no more followers than the threshold."""
    out = ts.between(F.lit(start), F.lit(end))
    return out if followers is None or threshold is None else out & (followers <= threshold)


def nearby_count(queries: DataFrame, points: DataFrame, max_radius_km: float, key: str = "query_idx") -> DataFrame:
    """(key, n): points within each query's radius, 0 included."""
    longest, by_key = blocks.longest_radius(queries, key)
    if by_key:
        n = blocks.totals(queries, points, longest or max_radius_km, key, {}).select(key, F.col("_every").alias("n"))
    else:
        n = radius_join(queries, points.select("lat", "lon"), max_radius_km).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    return queries.select(key).join(n, key, "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"))


def box_count(queries: DataFrame, points: DataFrame, half_side: float, features: dict[str, Column] | None = None, key: str = "query_idx", lat: str = "qlat", lon: str = "qlon") -> DataFrame:
    """For each query the points in the square around it, and named aggregates over them; squares include their sides.

    Both sides get the cell of a grid as high as a square, so a query meets three by three cells.
    """
    side = max(2 * half_side, 1e-9)
    reach = lambda c: F.explode(F.sequence(F.floor((F.col(c) - half_side) / side), F.floor((F.col(c) + half_side) / side)))
    asked = queries.withColumn("_y", reach(lat)).withColumn("_x", reach(lon))
    placed = points.withColumn("_y", F.floor(F.col("lat") / side)).withColumn("_x", F.floor(F.col("lon") / side))
    inside = placed.join(asked, ["_y", "_x"]).where((F.abs(F.col("lat") - F.col(lat)) <= half_side) & (F.abs(F.col("lon") - F.col(lon)) <= half_side))
    aggregates = {"n": F.count(F.lit(1))} | (features or {})
    counted = inside.groupBy(key).agg(*[a.alias(n) for n, a in aggregates.items()])
    return queries.select(key).join(counted, key, "left").select(key, F.coalesce("n", F.lit(0).cast("long")).alias("n"), *(features or {}))


def nearest(queries: DataFrame, points: DataFrame, k: int, max_radius_km: float, first_km: float | None = None, key: str = "query_idx", tie: str = "id") -> DataFrame:
    """(query, columns of points, km, rank): the k points nearest to each query within the radius, nearest first; equal distances by ``tie``.

    The search goes in rings: circles of ``first_km``, then of twice that. A query that has k points in its circle is done, as no point
    outside is nearer; only the others are asked again. A part of a block (``blocks``) gives the k points nearest to a query and those that rounding may put before
    them, so a crowded place sends few, and exact distances rank these.
    """
    home, done = shared.work_dir(queries.sparkSession, "nearest"), []
    open_ = queries.select(key, "qlat", "qlon")
    radius = min(first_km or max_radius_km / 16, max_radius_km)
    km = geo.distance_km(F.col("lat"), F.col("lon"), F.col("qlat"), F.col("qlon"))
    while True:
        met = blocks.nearest_candidates(open_, points, k, radius, key).withColumn("km", km)
        order = Window.partitionBy(key).orderBy("km", tie)
        found = met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(key, *points.columns, "km", "rank")
        found = shared.stored(found, f"{home}/{len(done)}")
        last = radius >= max_radius_km
        full = found.where(F.col("rank") == k).select(key)
        done.append(found if last else found.join(full, key, "left_semi"))
        if last:
            return reduce(DataFrame.unionByName, done)
        open_, radius = shared.stored(open_.join(full, key, "left_anti"), f"{home}/open-{len(done)}"), min(2 * radius, max_radius_km)
        if open_.isEmpty():
            return reduce(DataFrame.unionByName, done)
