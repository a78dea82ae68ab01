"""Writers of feature tables, graphs, tiles, map tables, predictions and stored documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.functions import osm, times, trees
from terravane.operators import blocks, radius_join, timeseries
from terravane.sources import store


def write_features(features: DataFrame, path: str, key: str = "query_idx") -> None:
    """Tab-separated columns with a header, rows in the order of the queries, with their key in front."""
    rest = [c for c in features.columns if c != key]
    features.select(key, *rest).orderBy(key).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def venue_lines(features: DataFrame, names: list[str], lat: str = "qlat", lon: str = "qlon") -> DataFrame:
    """Lines of ``lat lon``, then name=value for the mean and each category, with tabs between."""
    parts = [F.concat(F.lit(f"{n}="), F.col(n).cast("string")) for n in ["mean", *names]]
    return features.select(F.concat_ws("\t", F.concat_ws(" ", lat, lon), *parts).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.mode("overwrite").text(path)


def edge_lines(edges: DataFrame) -> DataFrame:
    return edges.select(F.concat_ws("\t", "src", "dst", "weight").alias("value"))


def vertex_lines(vertices: DataFrame) -> DataFrame:
    return vertices.select(F.concat_ws("\t", "id", "weight").alias("value"))


def write_edges(edges: DataFrame, path: str) -> None:
    edges.select("src", "dst", "weight").write.mode("overwrite").option("sep", "\t").csv(path)


def near_json(joined: DataFrame, key: str = "query_idx") -> DataFrame:
    """One JSON value for each query: its point and the sorted ids of what lies near. A query's ids make one value, as the format asks."""
    return joined.groupBy(key, "qlat", "qlon").agg(F.array_sort(F.collect_list("id")).alias("ids")).select(key, F.to_json(F.struct(F.col("qlat").alias("lat"), F.col("qlon").alias("lon"), "ids")).alias("value"))


def near_lists(queries: DataFrame, points: DataFrame, longest_km: float, key: str = "query_idx") -> DataFrame:
    """``near_json`` of the points near each query, whose lists are made where its points meet it; a query that repeats a key is joined."""
    longest, by_key = blocks.longest_radius(queries, key)
    if not by_key or points.schema["id"].dataType.simpleString() not in ("int", "bigint"):
        return near_json(radius_join.radius_join(queries, points, longest_km))
    lists = blocks.id_lists(queries, points, longest or longest_km, key)
    return lists.select(key, F.to_json(F.struct(F.col("qlat").alias("lat"), F.col("qlon").alias("lon"), "ids")).alias("value"))


def write_nodes(nodes: DataFrame, path: str) -> None:
    """All columns as quoted text with a header; what is missing is NA."""
    nodes.select(*osm.COLUMNS).na.fill("NA").write.mode("overwrite").option("header", True).option("quoteAll", True).csv(path)


def write_tiles(tiles: DataFrame, path: str) -> None:
    """Space-separated with a header."""
    names = {"left_lat": "leftLat", "left_lon": "leftLon", "right_lat": "rightLat", "right_lon": "rightLon", "center_lat": "centerLat", "center_lon": "centerLon", "r": "R"}
    tiles.select(*[F.col(a).alias(b) for a, b in names.items()]).write.mode("overwrite").option("sep", " ").option("header", True).csv(path)


def tile_centers(tiles: DataFrame) -> DataFrame:
    """One JSON value for each tile centre, named coordinates."""
    return tiles.select(F.to_json(F.struct(F.col("center_lat").alias("lat"), F.col("center_lon").alias("lon"))).alias("value"))


def saved(spark: SparkSession, path: str) -> DataFrame:
    """A table that ``save_documents`` or ``save_period`` has written."""
    return store.read(spark, path)


def save_documents(spark: SparkSession, new: DataFrame, path: str, key: str = "_id", order: str = "_timestamp", by_field: bool = False, stream: str | None = None, batch: int = -1) -> int:
    """Upserts documents into the table at ``path``: whole documents, or field by field. Read it with ``saved``.

    Only the buckets of the keys that come are written anew; a job that fails at any point leaves the table as it was.
    """

    def merge(old: DataFrame | None, rows: DataFrame) -> DataFrame:
        if old is None:
            return timeseries.last_write(rows, key, order)
        return timeseries.upsert(old, rows, key, order) if by_field else timeseries.last_write(old.unionByName(rows, allowMissingColumns=True), key, order)

    return store.save(spark, new, path, key, merge, stream=stream, batch=batch)


def save_period(spark: SparkSession, counts: DataFrame, path: str, key: str, size: int, stream: str | None = None, batch: int = -1) -> int:
    """Upserts (key, period, day, n) into a table of day maps, zeros where there is nothing; the new number of a day replaces the old one."""

    def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
        rows = new.select(key, "period", "day", F.col("n").cast("long").alias("n"), F.lit(1).alias("_new"))
        if old is not None:
            rows = rows.unionByName(old.select(key, "period", F.explode("days").alias("day", "n"), F.lit(0).alias("_new")))
        return timeseries.period_map(rows.groupBy(key, "period", "day").agg(F.max_by("n", "_new").alias("n")), key, size)

    return store.save(spark, counts, path, key, merge, stream=stream, batch=batch)


def write_ids_and_full(rows: DataFrame, path: str, key: str = "_id") -> None:
    """Two JSON tables: the keys alone, and whole rows."""
    rows.select(key).write.mode("overwrite").json(f"{path}/ids")
    rows.write.mode("overwrite").json(f"{path}/full")


def write_indexed(features: DataFrame, path: str, lat: str = "qlat", lon: str = "qlon") -> None:
    """Tab-separated with a header; the point, as ``(lat, lon)``, is the index in front."""
    point = F.concat(F.lit("("), F.col(lat).cast("string"), F.lit(", "), F.col(lon).cast("string"), F.lit(")")).alias("point")
    features.select(point, *[c for c in features.columns if c not in (lat, lon)]).write.mode("overwrite").option("sep", "\t").option("header", True).csv(path)


def write_days(rows: DataFrame, path: str, ms: Column, mode: str = "append", compression: str = "none", fmt: str = "json") -> None:
    """One partition for each day of the given epoch ms."""
    rows.withColumn("dt", times.day_name(ms)).write.partitionBy("dt").mode(mode).option("compression", compression).format(fmt).save(path)


def merge_days(days: DataFrame, path: str, files: int = 1) -> None:
    """The rows of chosen days in so many packed files."""
    days.coalesce(files).write.mode("overwrite").option("compression", "gzip").json(path)


def back_up(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").option("compression", "gzip").json(path)


def replace_all(table: DataFrame, path: str) -> None:
    table.write.mode("overwrite").parquet(path)


def prediction_lines(staged: DataFrame, query: str = "query_id", doc: str = "doc_id", scores: str = "staged") -> DataFrame:
    """(query, iteration, value): for each query and iteration the scores of its documents in order, with spaces between."""
    each = staged.select(query, doc, F.posexplode(scores).alias("iteration", "s"))
    return each.groupBy(query, "iteration").agg(trees.joined_numbers(F.transform(F.array_sort(F.collect_list(F.struct(doc, "s"))), lambda x: x["s"])).alias("value"))


def write_predictions(staged: DataFrame, path: str, query: str = "query_id", doc: str = "doc_id", scores: str = "staged") -> None:
    """Lines in order: the numbers of queries and iterations, then for each query and iteration the scores of its documents.

    Queries are dealt by ranges, so the files in order of their names are one whole; only the head line comes from two small counts.
    """
    lines = prediction_lines(staged, query, doc, scores)
    head = staged.agg(F.count_distinct(query).alias("q"), F.coalesce(F.max(F.size(scores)), F.lit(0)).alias("n")).select(F.lit(None).cast(lines.schema[query].dataType).alias(query), F.lit(-1).alias("iteration"), F.concat_ws(" ", "q", "n").alias("value"))
    write_lines(head.unionByName(lines).orderBy(F.asc_nulls_first(query), "iteration").select("value"), path)
