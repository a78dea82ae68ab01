from __future__ import annotations

import json

from pyspark.sql import functions as F

from terravane.streaming import counters


def run(spark, tmp_path, size=7, late="7 days"):
    rows = spark.readStream.schema("id string, at timestamp").option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    closed = counters.closed_periods(rows, "id", "at", size, late)
    q = closed.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return {(r["id"], r["period"], r["day"]): r["n"] for r in spark.read.schema("id string, period string, day int, n long").parquet(str(tmp_path / "out")).collect()}


def put(tmp_path, name, rows):
    (tmp_path / "in").mkdir(exist_ok=True)
    (tmp_path / "in" / name).write_text("".join(json.dumps({"id": i, "at": at}) + "\n" for i, at in rows))


def week(key, period, counts):
    return {(key, period, d): counts.get(d, 0) for d in range(7)}


def test_a_week_is_closed_once_across_restarts(spark, tmp_path):
    put(tmp_path, "1.json", [("a", "2024-01-01 10:00:00"), ("a", "2024-01-03 10:00:00"), ("b", "2024-01-07 23:59:59"), (None, "2024-01-02 00:00:00")])
    assert run(spark, tmp_path) == {}  # nothing is closed yet
    put(tmp_path, "2.json", [("a", "2024-01-03 11:00:00"), ("a", "2024-01-08 00:00:00"), (None, "2024-01-02 00:00:01")])
    assert run(spark, tmp_path) == {}  # the state of the first run goes on
    put(tmp_path, "3.json", [("z", "2024-01-16 00:00:00")])
    want = week("a", "2024-01-01", {0: 1, 2: 2}) | week("b", "2024-01-01", {6: 1}) | week(None, "2024-01-01", {1: 2})
    assert run(spark, tmp_path) == want
    put(tmp_path, "4.json", [("a", "2024-01-04 10:00:00"), ("z", "2024-02-20 00:00:00")])  # too late: its week is closed
    assert run(spark, tmp_path) == want | week("a", "2024-01-08", {0: 1}) | week("z", "2024-01-15", {1: 1})


def test_months_have_31_days(spark, tmp_path):
    put(tmp_path, "1.json", [("a", "2024-02-29 10:00:00"), ("a", "2024-05-01 00:00:00")])
    got = run(spark, tmp_path, 31)
    assert {k: n for k, n in got.items() if n} == {("a", "2024-02-01", 29): 1} and len(got) == 31


def test_partial_counts_add_up(spark):
    rows = spark.createDataFrame([("a", 1, "p", 0, 5), (None, 1, "p", 0, 6), ("a", 1, "p", 0, 9)], "id string, ends long, period string, day int, s long").withColumn("ts", F.timestamp_seconds("s")).drop("s").coalesce(1)
    out = rows.mapInPandas(counters._partial("id"), "id string, ends long, period string, day int, ts timestamp, n long")
    assert {(r["id"], r["n"]) for r in out.collect()} == {("a", 2), (None, 1)}
