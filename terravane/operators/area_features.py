"""Counts over the areas around query points: posts by time of day and source, and venues.

Areas without a post or venue are in the result, with zeros. Distinct users are exact: they are counted in each
block of the grid, where an area has all its points (``blocks``), so no row is made for a pair of a query and a post. Tables whose query keys repeat, or whose
users aren't whole numbers, take the join instead: rows are counted for each (area, user), with map-side sums, and a second aggregation counts users.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from terravane.functions import posts, times
from terravane.operators import blocks
from terravane.operators.radius_join import radius_join

#: Profile A and B name a feature and its distinct users differently.
NAMES_A = ("{}_and_{}", "unique_{}_and_{}")
NAMES_B = ("{}_{}", "unique_users_{}_{}")


def feature_filters(ts: Column, source: Column, profile: Mapping[str, tuple[int, int]]) -> dict[tuple[str, str], Column]:
    """Each part of the day with each group of sources."""
    return {(t, g): x & y for t, x in times.part_filters(ts, dict(profile)).items() for g, y in posts.group_filters(source).items()}


def counts_with_users(joined: DataFrame, keys: list[str], user: str, filters: Mapping[str, Column], unique: Mapping[str, str]) -> DataFrame:
    """For each filter the rows and the distinct users of each key; null users are no user."""
    names = list(filters)
    by_user = joined.groupBy(*keys, user).agg(*[F.count_if(filters[n]).alias(f"_{i}") for i, n in enumerate(names)])
    out = []
    for i, n in enumerate(names):
        out += [F.sum(f"_{i}").alias(n), F.count_if((F.col(f"_{i}") > 0) & F.col(user).isNotNull()).alias(unique[n])]
    return by_user.groupBy(*keys).agg(*out)


def _with_empty(queries: DataFrame, counted: DataFrame, key: str) -> DataFrame:
    names = [c for c in counted.columns if c != key]
    return queries.select(key).join(counted, key, "left").select(key, *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in names])


def area_counts(queries: DataFrame, points: DataFrame, max_radius_km: float, key: str = "query_idx", user: str = "user_id", strategy: str = "cell") -> DataFrame:
    """Posts and distinct users of each area."""
    return _counts(queries, points, max_radius_km, key, user, {"n": F.lit(True)}, {"n": "users"}, strategy)


def _counts(queries: DataFrame, points: DataFrame, max_radius_km: float, key: str, user: str, filters: Mapping[str, Column], unique: Mapping[str, str], strategy: str = "cell") -> DataFrame:
    longest, by_key = blocks.longest_radius(queries, key)
    if strategy != "cell" or not by_key or points.schema[user].dataType.simpleString() not in ("tinyint", "smallint", "int", "bigint"):
        return _with_empty(queries, counts_with_users(radius_join(queries, points, max_radius_km, strategy), [key], user, filters, unique), key)
    found = blocks.totals(queries, points, longest or max_radius_km, key, dict(filters), user)
    return _with_empty(queries, found.select(key, *[c for n in filters for c in (n, F.col(f"_u_{n}").alias(unique[n]))]), key)


def area_features(queries: DataFrame, points: DataFrame, max_radius_km: float, profile: Mapping[str, tuple[int, int]] = times.PROFILE_A, names: tuple[str, str] = NAMES_A, key: str = "query_idx", user: str = "user_id", ts: str = "ts", source: str = "source") -> DataFrame:
    """The 70 columns: posts and distinct users of each area for 5 parts of the day and 7 groups of sources."""
    filters = feature_filters(F.col(ts), F.col(source), profile)
    count = {names[0].format(*k): c for k, c in filters.items()}
    unique = {names[0].format(*k): names[1].format(*k) for k in filters}
    return _counts(queries, points.select(user, ts, source, "lat", "lon"), max_radius_km, key, user, count, unique)


def venue_features(queries: DataFrame, venues: DataFrame, max_radius_km: float, categories: Mapping[str, str], key: str = "query_idx", created: str = "created", seen: str = "seen", of: str = "categories") -> DataFrame:
    """Mean age of an area's venues in whole days (0 without venues) and the number of venues of each category.

    An age counts in whole seconds, cut towards zero; the sum is divided as a whole number. A venue without both times adds
    nothing to the sum and counts as a venue.
    """
    age = F.expr(f"(unix_millis(cast({seen} as timestamp)) - unix_millis(cast({created} as timestamp))) div 1000")
    mean = F.expr("coalesce(_sum, 0) div (_every * 86400)").alias("mean")
    count = {n: F.array_contains(of, c) for n, c in categories.items()}
    longest, by_key = blocks.longest_radius(queries, key)
    if by_key:
        found = blocks.totals(queries, venues, longest or max_radius_km, key, count, add=age)
    else:
        near = radius_join(queries, venues, max_radius_km).withColumn("_age", age)
        found = near.groupBy(key).agg(F.sum("_age").alias("_sum"), F.count(F.lit(1)).alias("_every"), *[F.count_if(c).alias(n) for n, c in count.items()])
    return _with_empty(queries, found.where(F.col("_every") > 0).select(key, mean, *count), key)


#: Categories counted by default.
VENUE_CATEGORIES = {
    "art and entertainment": "4d4b7104d754a06370d81259",
    "movie theatre": "4bf58dd8d48988d17f941735",
    "museum": "4bf58dd8d48988d181941735",
    "stadium": "4bf58dd8d48988d184941735",
}
