from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In
from pyspark.sql.types import IntegerType, LongType, StringType, TimestampType

from terravane.sources import docstore, store, writers

DOCS = "_id long, _timestamp long, a string, b double, at timestamp"


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    docstore.register(spark)
    path = str(tmp_path_factory.mktemp("store"))
    rows = [(i, i % 7, f"x{i % 5}" if i % 11 else None, i / 4 if i % 3 else None, datetime.datetime(2024, 1, 1 + i % 28)) for i in range(500)]
    writers.save_documents(spark, spark.createDataFrame([*rows, (None, 1, "none", 0.5, None)], DOCS), path)
    writers.save_documents(spark, spark.createDataFrame([(3, 100, "new", 1.0, None, 5)], DOCS + ", c int"), path)
    return path


def test_buckets_are_those_of_the_store(spark):
    for kind, values in ((LongType(), [0, -5, 1 << 40]), (IntegerType(), [7, -1]), (StringType(), ["", "é", "long " * 20])):
        df = spark.createDataFrame([(v,) for v in values], f"v {kind.simpleString()}").select(store._bucket("v", 64).alias("b"))
        assert [r["b"] for r in df.collect()] == [docstore.bucket_of(v, kind, 64) for v in values]
    assert docstore.bucket_of(None, TimestampType(), 64) is None


@pytest.mark.parametrize("where", ["_id = 3", "_id in (3, 4, 499, 7000)", "_id > 490", "a = 'x1' and b >= 10", "a is null", "_id is null", "b is not null and _timestamp <= 2", "_id = 3 or _id = 4", "a like 'x%'", "c = 5", "at = timestamp '2024-01-05'", "true"])
def test_filters_give_what_a_plain_read_gives(spark, path, where):
    found = spark.read.format("terravane_store").option("path", path).load()
    plain = writers.saved(spark, path)
    assert found.schema == plain.schema
    key = lambda df: sorted((tuple(r) for r in df.where(where).collect()), key=repr)
    assert key(found) == key(plain) and (key(plain) or where == "never")
    assert found.where(where).select("a").count() == plain.where(where).count()


def test_a_filter_on_the_key_leaves_one_bucket(spark, path):
    body = store.manifest(path, 1)
    schema = writers.saved(spark, path).schema
    for taken, most in (([EqualTo(("_id",), 3)], 1), ([In(("_id",), (3, 4))], 2), ([GreaterThan(("_id",), 3)], 64), ([EqualTo(("a",), "x1")], 64)):
        reader = docstore.StoreReader(path, body, schema, body["key"])
        assert list(reader.pushFilters(taken)) == [] and reader.taken == taken
        files = sum(len(body["files"].get(str(b), [])) for b in reader.buckets())
        assert len(reader.partitions()) == files and len(reader.buckets()) <= most


def test_versions_and_missing_tables(spark, path, tmp_path):
    assert spark.read.format("terravane_store").option("path", path).option("version", "0").load().where("_id = 3").first()["a"] == "x3"
    with pytest.raises(Exception, match="nothing is saved"):
        spark.read.format("terravane_store").option("path", str(tmp_path)).load()
    empty = str(tmp_path / "e")
    writers.save_documents(spark, spark.createDataFrame([], DOCS), empty)
    assert spark.read.format("terravane_store").option("path", empty).load().agg(F.count(F.lit(1)).alias("n")).first()["n"] == 0
