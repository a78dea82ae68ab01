from __future__ import annotations

import glob
import os
import threading

import pytest
from pyspark.sql import functions as F

from terravane.sources import store, writers

DOCS = "_id long, _timestamp long, a string"


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def docs(spark, made):
    return spark.createDataFrame(made, DOCS)


def size_of(path):
    return {f: os.path.getsize(f) for f in glob.glob(f"{path}/data/**/*.parquet", recursive=True)}


@pytest.mark.parametrize("marked", ["true", "false"])
def test_saves_add_up_with_and_without_files_of_success(spark, tmp_path, marked):
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", marked)
    try:
        path = str(tmp_path / "t")
        writers.save_documents(spark, docs(spark, [(i, 0, f"x{i}") for i in range(50)]), path)
        writers.save_documents(spark, docs(spark, [(i, 1, f"y{i}") for i in range(40, 60)]), path)
        writers.save_documents(spark, docs(spark, [(0, -1, "late"), (None, 1, "none")]), path)
        want = {i: f"x{i}" for i in range(40)} | {i: f"y{i}" for i in range(40, 60)} | {None: "none"}
        assert {r["_id"]: r["a"] for r in writers.saved(spark, path).collect()} == want and writers.saved(spark, path).count() == 61
        assert store.read(spark, path, 0).count() == 50
    finally:
        conf.set("mapreduce.fileoutputcommitter.marksuccessfuljobs", "true")


def test_a_save_of_one_percent_of_the_keys_writes_one_percent_of_the_bytes(spark, tmp_path):
    path = str(tmp_path / "t")
    whole = spark.range(200_000).select(F.col("id").alias("_id"), F.lit(0).cast("long").alias("_timestamp"), F.md5(F.col("id").cast("string")).alias("a"))
    store.save(spark, whole, path, "_id", lambda old, new: new, buckets=100)
    before = size_of(path)
    some = whole.where(F.pmod(F.xxhash64("_id"), F.lit(100)) == 7).withColumn("_timestamp", F.lit(1).cast("long"))
    assert 1500 < some.count() < 2500
    writers.save_documents(spark, some, path)
    added = {f: n for f, n in size_of(path).items() if f not in before}
    assert sum(added.values()) < 0.02 * sum(before.values())
    kept = store.manifest(path, 1)["files"]
    assert sum(kept[b] == own for b, own in store.manifest(path, 0)["files"].items()) == 99
    assert writers.saved(spark, path).groupBy("_timestamp").count().orderBy("_timestamp").collect()[1]["count"] == some.count()


def test_what_no_manifest_names_is_never_read(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.save_documents(spark, docs(spark, [(1, 0, "x"), (2, 0, "y")]), path)
    docs(spark, [(1, 9, "uncommitted")]).withColumn("__bucket", F.lit(3)).write.partitionBy("__bucket").parquet(f"{path}/data/left-behind")
    open(f"{path}/manifests/half.new", "w").close()
    assert rows(writers.saved(spark, path)) == [(1, 0, "x"), (2, 0, "y")]
    writers.save_documents(spark, docs(spark, [(2, 1, "z")]), path)
    assert store.vacuum(path, keep=1) >= 2
    assert rows(writers.saved(spark, path)) == [(1, 0, "x"), (2, 1, "z")] and store.versions(path) == [1]


def test_a_failed_save_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    writers.save_documents(spark, docs(spark, [(1, 0, "x")]), path)

    def broken(*_):
        raise OSError("the driver dies here")

    monkeypatch.setattr(store, "_commit", broken)
    with pytest.raises(OSError, match="dies"):
        writers.save_documents(spark, docs(spark, [(1, 1, "new")]), path)
    monkeypatch.undo()
    assert rows(writers.saved(spark, path)) == [(1, 0, "x")]


def test_two_writers_lose_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    writers.save_documents(spark, docs(spark, [(0, 0, "x")]), path)
    made = [docs(spark, [(k * 100 + i, 1, f"w{k}") for i in range(20)]) for k in (1, 2)]
    threads = [threading.Thread(target=writers.save_documents, args=(spark, m, path)) for m in made]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert store.versions(path) == [0, 1, 2] and writers.saved(spark, path).count() == 41


def test_a_taken_number_is_not_overwritten(tmp_path):
    path = str(tmp_path / "t")
    assert store._commit(path, {"version": 0, "who": 1}) and not store._commit(path, {"version": 0, "who": 2})
    assert store.manifest(path, 0)["who"] == 1 and os.listdir(f"{path}/manifests") == ["000000000000.json"]


def test_a_batch_counts_once(spark, tmp_path):
    path = str(tmp_path / "t")
    for number, a in ((0, "first"), (0, "again"), (1, "second"), (0, "late")):
        writers.save_documents(spark, docs(spark, [(number, 5, a)]), path, stream="s", batch=number)
    assert rows(writers.saved(spark, path)) == [(0, 5, "first"), (1, 5, "second")] and store.versions(path) == [0, 1]
    writers.save_documents(spark, docs(spark, [(7, 5, "other")]), path, stream="t", batch=0)
    assert writers.saved(spark, path).count() == 3


def test_new_columns_empty_saves_and_missing_tables(spark, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(FileNotFoundError):
        writers.saved(spark, path)
    writers.save_documents(spark, docs(spark, []), path)
    assert writers.saved(spark, path).columns == ["_id", "_timestamp", "a"] and writers.saved(spark, path).count() == 0
    writers.save_documents(spark, docs(spark, [(i, 0, "x") for i in range(300)]), path)
    writers.save_documents(spark, spark.createDataFrame([(1, 1, "n", 5.0)], DOCS + ", b double"), path)
    got = writers.saved(spark, path)
    assert got.count() == 300 and [r["b"] for r in got.where("_id in (1, 2)").orderBy("_id").collect()] == [5.0, None]
