from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from terravane.functions import draws
from terravane.functions.trees import Ensemble, ObliviousTree
from terravane.operators import boosting, models
from terravane.sources import shared, writers

DOCS = "model int, query_id long, doc_id long, features array<double>, target double"


@pytest.fixture(scope="module")
def three(spark):
    draw, out = np.random.default_rng(11), []
    for m in (2, 5, 9):
        for i in range(30 + m):
            x = draw.normal(size=3).round(2)
            out.append((m, i % 3, i, x.tolist(), float(x[m % 3] * 2 + x[(m + 1) % 3] + 0.1 * draw.normal())))
    return spark.createDataFrame(out, DOCS).repartition(3)


def same(a: Ensemble, b: Ensemble):
    assert len(a.trees) == len(b.trees)
    for s, t in zip(a.trees, b.trees, strict=True):
        assert s.features == t.features and s.thresholds == pytest.approx(t.thresholds) and s.leaves == pytest.approx(t.leaves, abs=1e-9)


@pytest.mark.parametrize("bootstrap", [False, True])
def test_models_of_one_run_equal_those_grown_alone(three, bootstrap, monkeypatch):
    monkeypatch.setattr(boosting, "STORE_EVERY", 2)  # differences are stored on the way
    settings = boosting.Settings(iterations=3, step=0.4, depth=2, levels=5, bootstrap=bootstrap)
    together = boosting.fit_models(three, settings)
    assert set(together) == {2, 5, 9}
    alone = boosting.fit(three.where("model = 5").drop("model"), settings)
    same(together[5], alone)
    assert together[5].trees != together[2].trees


def test_later_trees_follow_from_the_scores_so_far(spark, three):
    """The second tree is the one that a fit on the gradients of the first one's scores grows."""
    docs = three.where("model = 2").drop("model")
    settings = boosting.Settings(iterations=2, step=0.4, depth=2, levels=5)
    model = boosting.fit(docs, settings)
    from terravane.operators import ranking

    borders = boosting.split_candidates(docs, 3, 5)
    scored = docs.withColumn("score", Ensemble(model.trees[:1], 0.4).score(F.col("features")))
    tree = boosting.grow_tree(docs, boosting.gradients(scored, ranking.pair_weights(docs)), borders, 2)
    same(Ensemble(model.trees[1:], 0.4), Ensemble((tree,), 0.4))


def test_validation_equals_separate_fits(spark, three):
    docs = three.where("model = 9").select("doc_id", "features", "target")
    settings = boosting.Settings(iterations=2, step=0.4, depth=1, levels=4)
    found = {(r["round"], r["iteration"]): r["ndcg"] for r in boosting.cross_validate(spark, docs, settings, rounds=3, test_share=0.4, test_queries=4, size=5).collect()}
    dealt = boosting.folds(docs, 3, 0.4, settings.seed)
    for r in (1, 2, 3):
        model = boosting.fit(dealt.where(f"round = {r} and not is_test").withColumn("query_id", F.lit(1)), settings)
        test = boosting.sampled_queries(dealt.where(f"round = {r} and is_test"), 4, 5, settings.seed - r)
        want = {x["iteration"]: x["ndcg"] for x in boosting.staged_ndcg(test, model).collect()}
        assert want and {i: found[r, i] for i in want} == pytest.approx(want)
    lists = boosting.cross_validate(spark, docs, settings, rounds=2, test_share=0.4, train_queries=3, test_queries=2, size=6)
    assert {(r["round"], r["iteration"]) for r in lists.collect()} == {(1, 1), (1, 2), (2, 1), (2, 2)}


def test_rows_of_a_histogram_dont_grow_with_the_levels_of_other_features(spark, three):
    from terravane.operators import ranking

    docs = three.where("model = 2")
    pairs = ranking.pair_weights(docs).withColumn("model", F.lit(2))
    rows = boosting.first_round(docs, pairs, {2: [[0.0], [0.0, 0.5], []]})
    cells = boosting.histogram(rows)
    bins = {r["feature"]: r["n"] for r in cells.groupBy("feature").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert bins[0] <= 4 and bins[1] <= 9 and bins[2] == 1
    assert [r["h"] for r in cells.groupBy("feature").agg(F.sum("h").alias("h")).collect()] == pytest.approx([3.0] * 3)


def test_stored_models_come_back_and_predict(spark, tmp_path):
    tree = ObliviousTree((0, 2), (1.0, 0.5), (10.0, 20.0, 30.0, 40.0))
    old, new = Ensemble((tree,), 0.5), Ensemble((tree, ObliviousTree((), (), (1.0,))), 0.25)
    models.save(models.as_rows(spark, {0: old}), str(tmp_path / "m"), 1)
    models.save(models.as_rows(spark, {0: new, 3: old}), str(tmp_path / "m"), 2)
    assert models.from_rows(models.load(spark, str(tmp_path / "m"))) == {0: new, 3: old}
    assert models.from_rows(models.load(spark, str(tmp_path / "m"), 1)) == {0: old}
    docs = spark.createDataFrame([(0, [2.0, 0.0, 1.0]), (3, [0.0, 0.0]), (0, None)], "model int, features array<double>")
    out = models.staged(docs, models.load(spark, str(tmp_path / "m")), on="model").collect()
    assert sorted((r["model"], r["staged"]) for r in out) == [(0, [2.5, 2.75]), (0, [10.0, 10.25]), (3, [5.0])]
    with pytest.raises(Exception, match="(?i)exists"):
        models.save(models.as_rows(spark, {0: old}), str(tmp_path / "m"), 2)


def test_predictions_begin_with_their_numbers(spark, tmp_path):
    staged = spark.createDataFrame([(2, 1, [0.5, 1.0]), (1, 2, [2.0, 3.0]), (1, 1, [4.0, 5.0])], "query_id long, doc_id long, staged array<double>")
    writers.write_predictions(staged.repartition(3), str(tmp_path / "p"))
    lines = [line for p in sorted((tmp_path / "p").glob("part-*")) for line in p.read_text().splitlines()]
    assert lines == ["2 2", "4.0 2.0", "5.0 3.0", "0.5", "1.0"]
    assert writers.write_predictions(staged.limit(0), str(tmp_path / "q")) is None and "".join(p.read_text() for p in (tmp_path / "q").glob("part-*")) == "0 0\n"


def test_draws_are_those_of_their_distribution(spark):
    rows = spark.range(20_000).select(draws.uniform(3, "id").alias("u")).select("u", draws.poisson(F.col("u")).alias("n"))
    own = rows.agg(F.avg("u").alias("u"), F.avg("n").alias("n"), F.var_samp("n").alias("v"), F.min("u").alias("low"), F.max("u").alias("high")).first()
    assert own["u"] == pytest.approx(0.5, abs=0.02) and own["n"] == pytest.approx(1, abs=0.04) and own["v"] == pytest.approx(1, abs=0.06) and 0 <= own["low"] and own["high"] < 1
    assert spark.range(1).select(draws.uniform(3, F.lit(None)).alias("u")).first()["u"] is not None


def test_work_folders_go(spark, three):
    base = shared.shared_base(spark).removeprefix("file://")
    boosting.fit(three.where("model = 2").drop("model"), boosting.Settings(iterations=1, depth=1, levels=3))
    import glob

    assert not glob.glob(f"{base}/terravane/boosting-*")


def test_long_lists_are_counted_without_pairs(spark, monkeypatch):
    draw = np.random.default_rng(5)
    rows = [(q, d, [float(draw.integers(0, 9)), float(draw.integers(0, 5)), None if d == 3 else float(draw.random())], None if d == 7 else float(draw.integers(0, 40))) for q, n in ((1, 90), (2, 12), (3, 70)) for d in range(n)]
    docs = spark.createDataFrame(rows, "query_id long, doc_id long, features array<double>, target double")
    settings = boosting.Settings(iterations=3, step=0.3, depth=2, levels=4)
    want = boosting.fit(docs, settings)
    for name, value in (("LARGE_LIST", 50), ("LIST_TILES", 3), ("LIST_PART", 30)):
        monkeypatch.setattr(boosting, name, value)
    asked = []
    monkeypatch.setattr(boosting.ranking, "pair_weights", lambda own, *rest, real=boosting.ranking.pair_weights: asked.append(own.count()) or real(own, *rest))
    found = boosting.fit(docs, settings)
    assert asked == [12]
    for a, b in zip(want.trees, found.trees, strict=True):
        assert (a.features, a.thresholds) == (b.features, b.thresholds) and np.allclose(a.leaves, b.leaves)


@pytest.mark.parametrize("weights", ["equal", "rank", "ndcg"])
def test_pairs_bring_their_bins_without_further_joins(spark, three, weights):
    borders = boosting.model_borders(three, 4)
    lists = three.withColumn("_list", F.struct("model", "query_id"))
    pairs = boosting.ranking.pair_weights(lists, weights, "_list").select("_list.*", "i", "j", "w")
    got, want = (sorted((*r[:4], round(r["w"], 12), r["bins_i"], r["bins_j"]) for r in df.select("model", "query_id", "i", "j", "w", "bins_i", "bins_j").collect()) for df in (boosting.weighted_pairs(three, borders, weights), boosting._pairs_in_bins(three, pairs, borders, "query_id", "doc_id")))
    assert got == want and want
