"""Sources of posts, groups of sources, and the normal form of a raw post as Columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Known clients in the order in which they are looked for, and the groups that are counted.
SOURCES = ("Web", "iPhone", "iPad", "Android", "instagram", "foursquare")
OTHER = "other"
GROUPS = {
    "Apple": ("iPhone", "iPad"),
    "Android": ("Android",),
    "All": ("Web", "iPhone", "iPad", "Android", "instagram", "foursquare", "other"),
    "4sq": ("foursquare",),
    "instagram": ("instagram",),
    "Mobile": ("iPhone", "iPad", "Android"),
    "Social": ("foursquare", "instagram"),
}
#: Fields that a normal post keeps.
MAIN_FIELDS = ("id", "text", "retweet_count", "favorite_count")
USER_FIELDS = ("id", "followers_count", "friends_count", "listed_count", "favourites_count", "created_at")
PLACE_FIELDS = ("id", "url", "bounding_box")


def source_class(source: Column) -> Column:
    """The first known client whose name occurs in the raw source (case matters), else other."""
    return F.coalesce(*[F.when(F.contains(source, F.lit(x)), F.lit(x)) for x in SOURCES], F.lit(OTHER))


def group_filters(source: Column) -> dict[str, Column]:
    return {name: source.isin(*members) for name, members in GROUPS.items()}


def crossed(first: dict[str, Column], second: dict[str, Column], joint: str = "_and_") -> dict[str, Column]:
    """Every pair of conditions under a joined name, the second varying faster."""
    return {f"{a}{joint}{b}": x & y for a, x in first.items() for b, y in second.items()}


def all_of(*conditions: Column) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def corner_mean(corners: Column, axis: int) -> Column:
    """Mean of the four corners' coordinate (0: longitude, 1: latitude) of ``array<array<double>>``."""
    return F.aggregate(F.slice(corners, 1, 4), F.lit(0.0), lambda s, c: s + c[axis]) / 4


def kept(struct: str, fields: tuple[str, ...], condition: Column) -> Column:
    """A struct with some fields only, of nulls where the condition fails."""
    return F.struct(*[F.when(condition, F.col(f"{struct}.{f}")).alias(f) for f in fields])


def first_url(source: Column, urls: Column) -> Column:
    """The first expanded address of a post from the two social clients."""
    return F.when(source.isin("instagram", "foursquare") & (F.size(urls) > 0), F.try_element_at(urls, F.lit(1))["expanded_url"])
