from __future__ import annotations

import inspect

import pytest
from pyspark.sql import functions as F

from terravane.functions.trees import Ensemble, ObliviousTree
from terravane.operators import boosting, ranking
from terravane.plans import catalog, learning  # noqa: F401


def test_queries_train_with_the_default_settings(spark, sf_dir, monkeypatch):
    asked = {}
    monkeypatch.setattr(boosting, "fit", lambda docs, settings, *rest: asked.update(fit=(settings, rest)))
    monkeypatch.setattr(boosting, "staged_ndcg", lambda docs, model, *rest: docs)
    catalog.QUERIES["boost_fit_ndcg"](spark, sf_dir)
    assert asked["fit"] == (boosting.Settings(), ())
    real = inspect.signature(boosting.cross_validate)
    monkeypatch.setattr(boosting, "cross_validate", lambda *given, **named: asked.update(all=real.bind(*given, **named).arguments))
    catalog.QUERIES["cross_validation"](spark, sf_dir)
    assert asked["all"]["settings"] == boosting.Settings() and set(asked["all"]) == {"spark", "docs", "settings"}


@pytest.mark.parametrize("raw_first", [False, True])
def test_every_tree_is_measured_like_a_ranking(spark, raw_first):
    """Equal scores, equal and missing targets, missing features, lists of one document, batches that cut lists."""
    rows = [(q, d, None if d == 5 else [float(d * 7 % 4), None if d % 3 else float(d % 5), float("nan") if d == 2 else 1.0], None if d == 4 else float(d * 5 % 7)) for q in range(9) for d in range(1 + q * 3)]
    docs = spark.createDataFrame(rows, "query_id long, doc_id long, features array<double>, target double").repartition(5)
    model = Ensemble((ObliviousTree((0, 1), (1.0, 2.0), (0.5, 1.0, -1.0, 0.25)), ObliviousTree((), (), (0.5,)), ObliviousTree((2,), (1.5,), (1.0, -2.0))), 0.3)
    each = docs.select("query_id", "doc_id", "target", F.posexplode(model.staged(F.col("features"), raw_first)).alias("iteration", "prediction")).withColumn("q", F.struct("query_id", "iteration"))
    want = {r[0] + 1: r[1] for r in ranking.ndcg(each, 3, "q", ties=("doc_id",)).groupBy("q.iteration").agg(F.avg("ndcg")).collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        found = {r["iteration"]: r["ndcg"] for r in boosting.staged_ndcg(docs, model, 3, raw_first=raw_first).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == pytest.approx(want, rel=1e-12) and len(want) == 3


def test_pairs_of_equal_bins_are_one_row(spark, monkeypatch):
    docs = spark.range(400).select(F.lit(0).alias("model"), (F.col("id") % 40).alias("query_id"), F.col("id").alias("doc_id"), F.array((F.col("id") % 3).cast("double")).alias("features"), (F.col("id") * 7 % 11).cast("double").alias("target"))
    kept = []
    monkeypatch.setattr(boosting.shared, "stored", lambda df, uri, real=boosting.shared.stored: kept.append((uri, real(df, uri))) or kept[-1][1])
    monkeypatch.setattr(boosting.shared, "delete", lambda *_: None)
    boosting.fit_models(docs, boosting.Settings(iterations=1, depth=1, levels=4))
    pairs = next(df for uri, df in kept if uri.endswith("pairs-0"))
    assert pairs.count() <= 9 and pairs.agg(F.sum("w")).first()[0] == pytest.approx(40)
