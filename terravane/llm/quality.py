"""Quality scores of a byte-level convolutional network (operator 13).

A text is cut into chunks of ``CHUNK`` bytes of UTF-8 that overlap by a window, so that its chunks cover the whole document and every
window lies in one. Bytes are embedded, ``FILTERS`` learned filters look at windows of ``WINDOW`` bytes every ``STRIDE`` bytes, and each keeps its
largest value in a chunk. A document is the mean and the maximum of its chunks' values; a small hidden layer combines them into one probability.
All of it is numpy, for training too: only the windows of the maxima have gradients, so a step back is cheap.

The network is trained by one task on a bounded sample: ``FIT_ROWS`` labelled training rows with the smallest hashes of their ids, and at most
``FIT_CHUNKS`` chunks of each, evenly spread over its text. A tenth of the sample is left out to choose the best epoch. The trained network is some 40 kB,
which tasks get with their code; scoring reads every document once and whole.

Defined cases: null texts are empty; an empty text is one chunk of padding and gets the score that the network gives to it; repeated
labels of one id count as the worst of them; repeated rows are scored one by one; an id with several texts is trained on one of them, chosen by hash; where the sample hasn't
both labels every score is the smoothed share of label 1; an empty table gives no rows; a null key stays null; other columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import common

FIT_ROWS = 4000
FIT_CHUNKS = 16
EPOCHS = 14
#: A small sample is gone over more often, until so many steps are taken (at most eight times ``EPOCHS``).
LEAST_STEPS = 800
CHUNK = 512
WINDOW = 8
STRIDE = 4
FILTERS = 48
WIDTH = 8
HIDDEN = 16
#: Predicted to be good from this score on.
GOOD = 0.3
#: Chunks embedded at once.
TOGETHER = 1024
_STEP = CHUNK - (WINDOW - STRIDE)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def chunks_of(text: bytes) -> np.ndarray:
    """The chunks of a text, one in each row, the last one padded with zeros."""
    n = max(1, -(-(len(text) - (CHUNK - _STEP)) // _STEP))
    padded = np.zeros(_STEP * n + CHUNK - _STEP, np.uint8)
    padded[: len(text)] = np.frombuffer(text, np.uint8)
    return np.lib.stride_tricks.as_strided(padded, (n, CHUNK), (_STEP, 1))


class Network:
    """Parameters by name, all in single precision."""

    SHAPES = {"embedding": (256, WIDTH), "filters": (WINDOW * WIDTH, FILTERS), "bias": (FILTERS,), "hidden": (2 * FILTERS, HIDDEN), "hidden_bias": (HIDDEN,), "out": (HIDDEN,), "out_bias": (1,)}

    def __init__(self, p: dict[str, np.ndarray]):
        self.p = p

    @classmethod
    def new(cls, seed: int = 13) -> Network:
        rng = np.random.default_rng(seed)
        p = {k: (rng.standard_normal(s) / np.sqrt(s[0] if len(s) > 1 and k != "embedding" else 4)).astype(np.float32) for k, s in cls.SHAPES.items()}
        return cls(p | {k: np.zeros(cls.SHAPES[k], np.float32) for k in ("bias", "hidden_bias", "out_bias")})

    def pooled(self, chunks: np.ndarray, where: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """The largest value of each filter in each chunk, and with ``where`` its window."""
        values, places = [], []
        halves = self.p["filters"].reshape(WINDOW // STRIDE, STRIDE * WIDTH, FILTERS)
        embedding = self.p["embedding"].copy()
        embedding[0] = 0  # padding
        for at in range(0, len(chunks), TOGETHER):
            own = embedding[chunks[at : at + TOGETHER]].reshape(-1, STRIDE * WIDTH)
            rows, n = len(chunks[at : at + TOGETHER]), CHUNK // STRIDE
            seen = (own @ halves[0]).reshape(rows, n, FILTERS)[:, : n - len(halves) + 1]
            for k in range(1, len(halves)):
                seen = seen + (own @ halves[k]).reshape(rows, n, FILTERS)[:, k : n - len(halves) + 1 + k]
            if where:
                places.append(seen.argmax(axis=1))
            values.append(seen.max(axis=1))
        raw = np.concatenate(values) + self.p["bias"]
        return np.maximum(raw, 0), np.concatenate(places) if where else None

    def logits(self, pooled: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of documents whose chunks begin at ``starts``; with the documents' values and the hidden layer."""
        both = np.concatenate([np.add.reduceat(pooled, starts, axis=0) / counts[:, None].astype(np.float32), np.maximum.reduceat(pooled, starts, axis=0)], axis=1)
        hidden = np.tanh(both @ self.p["hidden"] + self.p["hidden_bias"])
        return hidden @ self.p["out"] + self.p["out_bias"][0], both, hidden

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """The probability of label 1 of each text."""
        if not texts:
            return np.zeros(0)
        pooled, counts, held, size = [], [], [], 0
        for text in texts:
            held.append(chunks_of(text))
            counts.append(len(held[-1]))
            size += counts[-1]
            if size >= TOGETHER:
                pooled.append(self.pooled(np.concatenate(held))[0])
                held, size = [], 0
        if held:
            pooled.append(self.pooled(np.concatenate(held))[0])
        count = np.array(counts)
        logits, _, _ = self.logits(np.concatenate(pooled), np.cumsum(count) - count, count)
        return np.round(1 / (1 + np.exp(-logits.astype(float))), 6)  # equal texts differ by less, wherever they stand

    def gradients(self, chunks: np.ndarray, counts: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        starts = np.cumsum(counts) - counts
        pooled, places = self.pooled(chunks, where=True)
        logits, both, hidden = self.logits(pooled, starts, counts)
        g = ((1 / (1 + np.exp(-logits)) - labels) / len(labels)).astype(np.float32)
        out = {"out": hidden.T @ g, "out_bias": g.sum(keepdims=True)}
        back = g[:, None] * self.p["out"] * (1 - hidden**2)
        out |= {"hidden": both.T @ back, "hidden_bias": back.sum(axis=0)}
        back = back @ self.p["hidden"].T
        of = np.repeat(np.arange(len(counts)), counts)
        most = both[:, FILTERS:]
        first = pooled == most[of]
        ties = np.add.reduceat(first, starts, axis=0)[of]
        own = back[of, :FILTERS] / counts[of][:, None] + back[of, FILTERS:] * first / np.maximum(ties, 1)
        own = (own * (pooled > 0)).astype(np.float32)
        seen = chunks[np.arange(len(chunks))[:, None, None], (places * STRIDE)[:, :, None] + np.arange(WINDOW)]  # bytes of the windows with the maxima
        embedding = self.p["embedding"].copy()
        embedding[0] = 0
        wide = embedding[seen].reshape(len(chunks), FILTERS, WINDOW * WIDTH)
        out |= {"filters": np.einsum("mf,mfw->wf", own, wide, optimize=True), "bias": own.sum(axis=0)}
        down = (own[:, :, None] * self.p["filters"].T[None]).reshape(-1, WIDTH)
        flat = seen.ravel()
        out["embedding"] = np.stack([np.bincount(flat, down[:, d], minlength=256) for d in range(WIDTH)], axis=1).astype(np.float32)
        out["embedding"][0] = 0
        return out


def train(texts: list[bytes], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 13, batch: int = 32, rate: float = 4e-3) -> Network:
    """Adam on mini-batches; the parameters of the epoch with the least loss on a tenth of the rows, which is left out, are kept."""
    rng = np.random.default_rng(seed)
    rows = [c[np.linspace(0, len(c) - 1, FIT_CHUNKS).astype(int)] if len(c) > FIT_CHUNKS else c for c in map(chunks_of, texts)]
    order = rng.permutation(len(rows))
    out, own = order[: len(rows) // 10], order[len(rows) // 10 :]
    net, best, least = Network.new(seed), None, np.inf
    first, second, step = ({k: np.zeros_like(v) for k, v in net.p.items()} for _ in range(2)), None, 0
    first, second = first
    test = np.concatenate([rows[i] for i in out]) if len(out) else None
    epochs = max(epochs, min(LEAST_STEPS * batch // max(len(own), 1), 8 * epochs))
    for epoch in range(epochs):
        speed = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
        rng.shuffle(own)
        for at in range(0, len(own), batch):
            some = own[at : at + batch]
            counts = np.array([len(rows[i]) for i in some])
            g = net.gradients(np.concatenate([rows[i] for i in some]), counts, labels[some])
            step += 1
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.001 * (v * v - second[k])
                net.p[k] -= (speed * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        if test is None:
            continue
        counts = np.array([len(rows[i]) for i in out])
        logits, _, _ = net.logits(net.pooled(test)[0], np.cumsum(counts) - counts, counts)
        loss = float(np.mean(np.logaddexp(0, np.where(labels[out] > 0, -logits, logits))))
        if loss < least:
            best, least = {k: v.copy() for k, v in net.p.items()}, loss
    return Network(best) if best else net


class Model:
    """A network, or where the sample lacks a label the share of label 1; small enough to go with the code of a task."""

    def __init__(self, body: bytes | None, share: float):
        self.body, self.share = body, share

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.body is None:
            return np.full(len(texts), self.share)
        if getattr(self, "_net", None) is None:
            with np.load(io.BytesIO(self.body)) as f:
                self._net = Network({k: f[k] for k in Network.SHAPES})
        return self._net.scores(texts)

    def __getstate__(self):
        return {"body": self.body, "share": self.share}


def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parameters, trained on all rows that the task gets."""
    common.claim("quality")
    rows = sorted((r for b in batches for r in b.to_pylist()), key=lambda r: r["doc_id"])
    labels = np.array([r["quality"] for r in rows], np.float32)
    body = None
    if 0 < labels.sum() < len(labels):
        out = io.BytesIO()
        np.savez(out, **train([r["text"].encode() for r in rows], labels).p)
        body = out.getvalue()
    yield pa.RecordBatch.from_arrays([pa.array([body], pa.binary()), pa.array([(float(labels.sum()) + 1) / (len(labels) + 2)], pa.float64())], ["body", "share"])


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS) -> Model:
    """Learns from the labels of at most ``rows`` training rows."""
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    sample = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64(F.lit(13), "doc_id"), "doc_id").limit(rows)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), common.text_of(text).alias("text"))
    one = slim.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    chosen = common.stored(one, f"{common.shared_dir(docs.sparkSession, 'quality')}/sample")
    row = chosen.coalesce(1).mapInArrow(_train, "body binary, share double").first()
    return Model(bytes(row["body"]) if row and row["body"] else None, row["share"] if row else 0.5)


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted) of every document, in one pass."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        common.claim("quality")
        for batch in batches:
            yield pa.array(model.scores([t.as_py() for t in batch.cast(pa.binary())]), pa.float64())

    out = docs.select(F.col(key).alias("key"), F.arrow_udf(run, "double")(common.text_of(text)).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= GOOD).cast("int"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents of the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return out.select(F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "score", "predicted")
