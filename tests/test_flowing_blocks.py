from __future__ import annotations

import uuid

import pytest
from test_blocks import tables

from terravane.operators import blocks
from terravane.operators import radius_join as rj
from terravane.plans import catalog, files, views  # noqa: F401

PLACES = [{}, {"lat": (89.0, 90.0), "lon": (-180, 180), "radius": 60.0}, {"lat": (-0.2, 0.2), "lon": (179.6, 180.0), "radius": 20.0}, {"lat": (-80, 80), "lon": (-180, 180), "radius": 2500.0}]


def shuffled_rows(spark, run):
    """What ``run`` gives, and the rows that its stages have written for others."""
    context, group = spark.sparkContext, uuid.uuid4().hex
    context.setJobGroup(group, group)
    try:
        out = run()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    context._jsc.sc().listenerBus().waitUntilEmpty()
    stages = {s for j in context.statusTracker().getJobIdsForGroup(group) for s in context.statusTracker().getJobInfo(j).stageIds}
    return out, sum(context._jsc.sc().statusStore().lastStageAttempt(s).shuffleWriteRecords() for s in stages)


@pytest.mark.parametrize("place", PLACES)
def test_what_flows_past_is_cut_anywhere(spark, monkeypatch, place):
    for name, value in (("FLOW_PAIRS", 1500), ("FLOW_ROWS", 11), ("FLOW_OUT", 5), ("PART_POINTS", 20), ("TOGETHER", 3)):
        monkeypatch.setattr(blocks, name, value)
    q, p = tables(spark, **place)
    longest = place.get("radius", 2.0)
    want = sorted(map(tuple, rj.radius_join(q, p, 2.0, "nested").select("query_idx", "id").collect()))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        pairs = sorted(map(tuple, blocks.id_pairs(q, p, longest).collect()))
        lists = {r["query_idx"]: r["ids"] for r in blocks.id_lists(q, p, longest).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pairs == want and want
    assert lists == {i: [b for a, b in want if a == i] for i, _ in want}


@pytest.mark.parametrize("make", ["id_pairs", "id_lists"])
def test_no_row_is_repeated_for_the_pairs(spark, monkeypatch, make):
    for name in ("PART_PAIRS", "FLOW_PAIRS"):
        monkeypatch.setattr(blocks, name, 5000, raising=False)
    q, p = tables(spark, n=4000, m=400)
    found, rows = shuffled_rows(spark, lambda: getattr(blocks, make)(q, p, 2.0).collect())
    assert found and rows <= 12 * 4400


def test_a_search_file_is_not_kept(spark, sf_dir):
    kept = spark.sparkContext._jsc.getPersistentRDDs().size()
    assert catalog.QUERIES["search_file_join"](spark, sf_dir).count() > 0
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == kept


@pytest.mark.parametrize("strategy", ["cell", "blocks"])
def test_many_queries_are_not_sent_to_every_task(spark, sf_dir, strategy):
    q, p = views.query_points(spark, sf_dir), views.posts(spark, sf_dir)
    plan = rj.radius_join(q, p, 0.5, strategy, small_queries=False)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan.split("Physical Plan")[1]
