"""Category trees and paths of venues."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.sources import shared

#: Ends a path whose category is not in the tree.
UNKNOWN = "?"
#: Levels of nested records that are opened in one pass.
LEVELS = 8


def flatten_tree(tree: DataFrame, children: str = "categories", levels: int | None = None) -> DataFrame:
    """(id, parent_id) of nested structs {id, categories: [...]}; the top has null parents.

    The depth is that of the schema, so it takes one pass for each level.
    """
    level = tree.select(F.explode(children).alias("c")).select("c.*", F.lit(None).cast("string").alias("parent_id"))
    out = None
    depth = 0
    while True:
        own = level.select("id", "parent_id")
        out = own if out is None else out.unionByName(own)
        depth += 1
        if children not in level.columns or (levels is not None and depth >= levels):
            return out
        level = level.select(F.col("id").alias("parent_id"), F.explode(children).alias("c")).select("c.*", "parent_id")


def flatten_records(trees: DataFrame, column: str, children: str = "categories", name: str = "id", max_depth: int = 100) -> DataFrame:
    """(id, parent_id, depth) of nested records whose schema nobody knows: ``column`` is a VARIANT, or JSON text, with a list of children at any depth.

    A pass opens ``LEVELS`` levels and stores their rows, with the records of the last level that have children still, from which the next pass
    goes on; so the records are read once, and what lies below a row is stored once in so many levels. Branches may be of different depth, and
    records may lack an id (null) or have other fields. The top has null parents. Text that isn't JSON has no records.
    """
    home = shared.work_dir(trees.sparkSession, "records")
    own = F.col(column) if trees.schema[column].dataType.simpleString() == "variant" else F.try_parse_json(F.col(column).cast("string"))
    below, none = F.try_variant_get("_r", f"$.{children}", "array<variant>"), F.lit(None).cast("variant")
    left = trees.select(own.alias("_r"), F.lit(None).cast("string").alias("id"))
    out, depth = None, 0
    while depth < max_depth:
        rows = left.select(F.explode(below).alias("_r"), F.col("id").alias("parent_id")).where(~F.is_variant_null("_r"))
        rows = rows.select("_r", F.try_variant_get("_r", f"$.{name}", "string").alias("id"), "parent_id", F.lit(depth).alias("depth"))
        last = min(depth + LEVELS, max_depth) - 1
        for _ in range(depth, last):  # a row itself, which is done then, and what lies below it
            rows = rows.select("id", "parent_id", "depth", F.posexplode(F.concat(F.array(none), F.coalesce(below, F.array().cast("array<variant>")))).alias("_at", "_r"))
            done = F.col("_at") == 0
            rows = rows.where(done | ~F.is_variant_null("_r")).select("_r", F.when(done, F.col("id")).otherwise(F.try_variant_get("_r", f"$.{name}", "string")).alias("id"), F.when(done, F.col("parent_id")).otherwise(F.col("id")).alias("parent_id"), (F.col("depth") + F.when(done, 0).otherwise(1)).alias("depth"))
        rows = shared.stored(rows.select("id", "parent_id", "depth", F.when(F.size(below) > 0, F.col("_r")).alias("_r")), f"{home}/{depth}")
        found = rows.select("id", "parent_id", "depth")
        out = found if out is None else out.unionByName(found)
        left, depth = rows.where(F.col("_r").isNotNull()).select("_r", "id"), last + 1
        if depth < max_depth and left.isEmpty():
            return out
    if rows.where(F.col("depth") == max_depth - 1).isEmpty():
        return out
    raise ValueError(f"records are nested more than {max_depth} deep")


def category_paths(categories: DataFrame, tree: DataFrame, max_depth: int = 32) -> DataFrame:
    """(id, path, main): the path from each of ``categories`` (id) up to the top of ``tree`` (id, parent_id), and its top.

    A category that is missing from the tree ends a path with '?', and its main category is '?'. One broadcast-sized or
    shuffled join for each level, as many as the tree is deep, on the stored paths of the level before; a cycle ends at ``max_depth`` with an error.
    """
    known = tree.select(F.col("id").alias("at"), "parent_id", F.lit(True).alias("known")).dropDuplicates(["at"])
    home = shared.work_dir(categories.sparkSession, "paths")
    known = shared.stored(known, f"{home}/tree")
    open_ = categories.select("id").distinct().select("id", F.col("id").alias("at"), F.array("id").alias("path"))
    done = None
    for turn in range(max_depth):
        step = shared.stored(open_.join(known, "at", "left"), f"{home}/{turn}")
        ended = step.where(F.col("known").isNull() | F.col("parent_id").isNull())
        unknown = F.col("known").isNull()
        own = ended.select("id", F.when(unknown, F.concat("path", F.array(F.lit(UNKNOWN)))).otherwise(F.col("path")).alias("path"), F.when(unknown, F.lit(UNKNOWN)).otherwise(F.col("at")).alias("main"))
        done = own if done is None else done.unionByName(own)
        open_ = step.where(F.col("parent_id").isNotNull()).select("id", F.col("parent_id").alias("at"), F.concat("path", F.array("parent_id")).alias("path"))
        if not open_.limit(1).count():
            return done
    raise ValueError(f"a category path is longer than {max_depth}; is there a cycle?")


def with_paths(venues: DataFrame, paths: DataFrame, categories: str = "categories", key: str = "id") -> DataFrame:
    """``venues`` with the array of the paths of their categories, in the order of the categories."""
    each = venues.select(F.col(key).alias("_v"), F.posexplode(categories).alias("_pos", "_cat"))
    found = each.join(paths.select(F.col("id").alias("_cat"), "path"), "_cat", "left")
    lists = found.groupBy("_v").agg(F.transform(F.array_sort(F.collect_list(F.struct("_pos", "path"))), lambda x: x["path"]).alias("category_paths"))
    return venues.join(lists, F.col(key) == F.col("_v"), "left").drop("_v")
