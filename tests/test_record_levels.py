from __future__ import annotations

import glob

import pytest

from terravane.operators import venues
from terravane.sources import shared


def _rows(spark):
    deep = '{"id": "leaf"}'
    for k in range(9):
        deep = f'{{"id": "n{k}", "categories": [{deep}, null, 5, {{"id": {k}, "categories": {{}}}}]}}'
    return spark.createDataFrame([(f'{{"categories": [{deep}, {{"id": "a", "categories": []}}, "text"]}}',), ("{}",), (None,)], "value string")


def _want():
    out = [(None, None, 0), ("a", None, 0)]
    for k in range(8, -1, -1):
        out += [(f"n{k}", f"n{k + 1}" if k < 8 else None, 8 - k), (None, f"n{k}", 9 - k), (str(k), f"n{k}", 9 - k)]
    return [*out, ("leaf", "n0", 9)]


@pytest.mark.parametrize("levels", [1, 2, 5, 9, 10, 50])
def test_levels_of_a_pass_change_nothing(spark, monkeypatch, levels):
    monkeypatch.setattr(venues, "LEVELS", levels)
    assert sorted(map(tuple, venues.flatten_records(_rows(spark), "value").collect()), key=repr) == sorted(_want(), key=repr)
    assert venues.flatten_records(_rows(spark), "value", max_depth=11).count() == len(_want())
    with pytest.raises(ValueError, match="deep"):
        venues.flatten_records(_rows(spark), "value", max_depth=10)


def test_records_are_stored_once_in_so_many_levels(spark):
    base = shared.shared_base(spark).removeprefix("file://")
    before = set(glob.glob(f"{base}/terravane/records-*"))
    tree = '{"categories": [{"id": 1, "categories": [{"id": 2, "categories": [{"id": 3, "categories": [{"id": 4}]}]}]}]}'
    assert venues.flatten_records(spark.createDataFrame([(tree,)], "value string"), "value").count() == 4
    (made,) = set(glob.glob(f"{base}/terravane/records-*")) - before
    assert len(glob.glob(f"{made}/*")) == 1
