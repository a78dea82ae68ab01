from __future__ import annotations

import glob

from terravane.plans import files
from terravane.sources import shared


def test_files_of_a_stream_grow_with_its_posts(spark, sf_dir, monkeypatch):
    base = shared.shared_base(spark).removeprefix("file://")
    posts = spark.read.parquet(f"{sf_dir}/events.parquet").count()
    want = sorted(map(tuple, files.stream_saved_twice(spark, sf_dir).collect()))
    before = set(glob.glob(f"{base}/terravane/stream-twice-in-*"))
    monkeypatch.setattr(files, "PACKED", -(-posts // 4))
    assert sorted(map(tuple, files.stream_saved_twice(spark, sf_dir).collect())) == want
    (made,) = set(glob.glob(f"{base}/terravane/stream-twice-in-*")) - before
    assert [len(glob.glob(f"{made}/{k}/*.json.gz")) for k in (0, 1)] == [12, 8]
