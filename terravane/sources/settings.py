"""Settings of a job over points, from a JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Settings:
    search_radius: float
    gps: tuple[tuple[float, float], ...]
    robots_threshold: float = 0.0
    start_date: int | None = None
    end_date: int | None = None
    result_file: str | None = None


def read_settings(spark: SparkSession, path: str) -> Settings:
    """One small JSON object, wherever Spark can read it; keys that are not settings are passed over."""
    text = "\n".join(r["value"] for r in spark.read.text(path, wholetext=True).collect())
    given = {k: v for k, v in json.loads(text).items() if k in {f.name for f in fields(Settings)}}
    return Settings(**given | {"gps": tuple((float(a), float(b)) for a, b in given["gps"])})


def points(spark: SparkSession, settings: Settings) -> DataFrame:
    """(query_idx, qlat, qlon, radius) of the points that the settings name."""
    rows = [(i, lat, lon, float(settings.search_radius)) for i, (lat, lon) in enumerate(settings.gps)]
    return spark.createDataFrame(rows, "query_idx long, qlat double, qlon double, radius double")


def job_points(spark: SparkSession, path: str) -> DataFrame:
    """(job, query_idx, qlat, qlon, radius and the other settings) of any number of settings files, one object in a line; read by Spark."""
    rest = "robots_threshold double, start_date long, end_date long, result_file string"
    rows = spark.read.schema(f"job string, search_radius double, gps array<array<double>>, {rest}").json(path)
    each = rows.select("job", F.col("search_radius").alias("radius"), "robots_threshold", "start_date", "end_date", "result_file", F.posexplode("gps").alias("at", "p"))
    return each.select("job", F.col("at").cast("long").alias("query_idx"), F.get("p", F.lit(0)).alias("qlat"), F.get("p", F.lit(1)).alias("qlon"), "radius", "robots_threshold", "start_date", "end_date", "result_file")
