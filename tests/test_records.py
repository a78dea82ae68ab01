from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from terravane.functions import paths
from terravane.operators import venues


def test_trees_of_any_depth_without_a_schema(spark):
    deep = '{"id": "leaf"}'
    for k in range(12):
        deep = f'{{"id": "n{k}", "categories": [{deep}], "other": {k}}}'
    rows = ['{"categories": [{"id": "a", "categories": [{"id": "b"}, {"categories": [{"id": "c"}]}, null, {"id": 7, "categories": "none"}]}, {"id": "d", "categories": []}]}', f'{{"categories": [{deep}]}}', "not json", None, "{}", '{"categories": 5}']
    df = spark.createDataFrame([(r, "x") for r in rows], "value string, id string")
    found = sorted(map(tuple, venues.flatten_records(df, "value").collect()), key=repr)
    want = [("a", None, 0), ("d", None, 0), ("b", "a", 1), (None, "a", 1), ("7", "a", 1), ("c", None, 2), ("n11", None, 0), *((f"n{k}", f"n{k + 1}", 11 - k) for k in range(11)), ("leaf", "n0", 12)]
    assert found == sorted(want, key=repr)
    again = venues.flatten_records(df.select(F.try_parse_json("value").alias("v")), "v")
    assert sorted(map(tuple, again.collect()), key=repr) == found
    assert venues.flatten_records(df.limit(0), "value").count() == 0
    with pytest.raises(ValueError, match="deep"):
        venues.flatten_records(df, "value", max_depth=5)


def test_paths_into_records(spark):
    rows = ['{"a": {"b c": [10, {"d": "x"}]}, "n": null, "it\'s": 1}', '{"a": 5}', None]
    df = spark.createDataFrame([(r,) for r in rows], "value string").select(F.try_parse_json("value").alias("r"))
    got = df.select(paths.in_record("r", "a.b c.0", "int").alias("x"), paths.in_record("r", "a/b c/1/d", joint="/").alias("y"), paths.in_record("r", "n").alias("n"), paths.in_record("r", "a", "int").alias("a"), paths.in_record("r", "it's", "int").alias("q")).collect()
    assert [tuple(r) for r in got] == [(10, "x", None, None, 1), (None, None, None, 5, None), (None,) * 5]


def test_a_cycle_is_an_error_and_unknown_ends_a_path(spark):
    tree = spark.createDataFrame([("a", "b"), ("b", "a"), ("x", None), ("y", "x"), ("z", "gone")], "id string, parent_id string")
    with pytest.raises(ValueError, match="cycle"):
        venues.category_paths(tree.where("id = 'a'"), tree, 4)
    got = {r["id"]: (r["path"], r["main"]) for r in venues.category_paths(tree.where("id in ('y', 'z')"), tree).collect()}
    assert got == {"y": (["y", "x"], "x"), "z": (["z", "gone", "?"], "?")}
