from __future__ import annotations

import os

import numpy as np
import pytest
from llm_cases import HARD

from terravane.llm import quality

LABELS = "doc_id long, quality int, toxic int"


def area(labels, scores):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(1, len(scores) + 1)
    one = np.asarray(labels) == 1
    return (rank[one].sum() - one.sum() * (one.sum() + 1) / 2) / (one.sum() * (~one).sum())


def test_chunks_cover_the_text_and_every_window():
    for n in (0, 1, 7, 511, 512, 513, 1020, 1021, 5000):
        text = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
        chunks = quality.chunks_of(text)
        windows = {bytes(c[k : k + quality.WINDOW]) for c in chunks for k in range(0, quality.CHUNK - quality.WINDOW + 1, quality.STRIDE)}
        assert all(text[k : k + quality.WINDOW] in windows for k in range(0, n - quality.WINDOW + 1, quality.STRIDE))
        assert len(chunks) == max(1, -(-(n - 4) // 508))


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(3)
    net = quality.Network.new()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    net.p["bias"] += 0.05  # padding alone then isn't just at the bend of the rectifier
    rows = [quality.chunks_of(bytes(rng.integers(1, 256, n, dtype=np.uint8))) for n in (30, 700, 1500, 5)]
    counts, chunks, labels = np.array([len(r) for r in rows]), np.concatenate(rows), np.array([1, 0, 1, 0.0])

    def loss():
        logits, _, _ = net.logits(net.pooled(chunks)[0], np.cumsum(counts) - counts, counts)
        return np.mean(np.logaddexp(0, np.where(labels > 0, -logits, logits)))

    found = net.gradients(chunks, counts, labels)
    for name, g in found.items():
        flat = net.p[name].reshape(-1)
        for at in np.argsort(-np.abs(g.ravel()))[:3]:
            old = flat[at]
            flat[at] = old + 1e-5
            up = loss()
            flat[at] = old - 1e-5
            down = loss()
            flat[at] = old
            assert abs((up - down) / 2e-5 - g.ravel()[at]) < 1e-3 * max(1, abs(g.ravel()[at])), name


def test_held_out_rows_are_told_apart(spark):
    path = "/root/testdata/sf0.1"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    out = quality.op13_quality(spark, path).where("held_out").join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").select("quality", "score", "predicted").toPandas()
    assert area(out["quality"], out["score"].to_numpy()) > 0.95
    clean = out[out["quality"] == 1]
    assert (clean["predicted"] == 0).mean() < 0.05
    assert (out[out["quality"] == 0]["predicted"] == 0).mean() > 0.7


def test_hard_rows_and_labels(spark, docs_of):
    texts = [*HARD, *("good words follow one another here" + str(i) for i in range(40)), *("### $$$ %%%" * i for i in range(1, 41))]
    docs = docs_of(texts)
    rows = [(i, int(i < len(HARD) + 40), 0) for i in range(len(HARD), len(texts))]
    labels = spark.createDataFrame([*rows, *rows, (None, 1, 0), (5, None, 0), (7, 9, 0)], LABELS)
    model = quality.fit(docs, labels)
    got = {r["key"]: r for r in quality.score(docs.withColumn("score", docs.text).withColumn("key", docs.text), model).collect()}
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert abs(got[0]["score"] - got[1]["score"]) < 2e-6 and abs(got[5]["score"] - got[6]["score"]) < 2e-6
    assert np.allclose([got[i]["score"] for i in range(len(texts))], model.scores([(t or "").encode() for t in texts]), atol=2e-6)
    assert quality.score(docs.limit(0), model).count() == 0


def test_one_label_only_and_no_labels(spark, docs_of):
    docs = docs_of(["a", "b", None])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(3)], LABELS)
    assert len({r["score"] for r in quality.score(docs, quality.fit(docs, labels)).collect()}) == 1
    assert {r["score"] for r in quality.score(docs, quality.fit(docs, labels.limit(0))).collect()} == {0.5}


def test_no_more_rows_than_asked_for(spark, docs_of):
    docs = docs_of([f"text {i}" for i in range(60)])
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)], LABELS)
    seen = quality.fit(docs, labels, rows=10)
    assert round(seen.share * 12) - 1 <= 10
