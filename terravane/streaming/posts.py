"""Streams of posts: normal form, idempotent storage, day files and weekly counts.

A stream that ends for any reason goes on from its checkpoint when it is started again. Late records count as long as the
watermark lets them; the counts and results then equal those of the same records in a batch.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from terravane.functions import geo, times
from terravane.operators import timeseries
from terravane.sources import readers, writers


def raw_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Raw records from JSON files as they arrive."""
    return spark.readStream.schema(readers.RAW_POST).option("maxFilesPerTrigger", files_per_trigger).json(path)


def located(raw: DataFrame, box: geo.Box) -> DataFrame:
    """Normal posts inside the box."""
    return readers.normalised_posts(raw).where(box.contains())


def once(posts: DataFrame, late: str = "1 day") -> DataFrame:
    """The first of the posts with one id; state older than the watermark is dropped."""
    return posts.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["_id"])


def each_batch(posts: DataFrame, checkpoint: str, work: Callable[[DataFrame, int], None]) -> StreamingQuery:
    return posts.writeStream.foreachBatch(work).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def save(posts: DataFrame, path: str, checkpoint: str, order: str = "created_at") -> StreamingQuery:
    """Upserts each micro-batch by id into the buckets of its ids; a batch that is repeated after a failure is known by its number and changes nothing."""
    return each_batch(posts, checkpoint, lambda batch, number: writers.save_documents(batch.sparkSession, batch, path, "_id", order, stream=checkpoint, batch=number))


def day_files(posts: DataFrame, path: str, checkpoint: str, ts: str = "created_at") -> StreamingQuery:
    """Packed JSON files, one folder for each day of the posts' own time."""
    dated = posts.withColumn("dt", F.date_format(ts, "yyyy-MM-dd"))
    return dated.writeStream.partitionBy("dt").format("json").option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def weekly_counts(posts: DataFrame, key: str, ts: str, late: str = "8 days") -> DataFrame:
    """(key, week, day, n): records of each key and day of the week, weeks from Monday. Event time, with a watermark."""
    dated = posts.withWatermark(ts, late)
    return dated.groupBy(F.window(ts, "1 day"), key).agg(F.count(F.lit(1)).alias("n")).select(
        key, times.week_suffix(F.col("window.start")).alias("week"), F.weekday("window.start").alias("day"), "n"
    )


def weekly_counts_batch(posts: DataFrame, key: str, ts: str) -> DataFrame:
    return timeseries.period_counts(posts, key, ts, 7).withColumnRenamed("period", "week")
