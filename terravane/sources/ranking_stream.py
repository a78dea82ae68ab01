"""Ranking queries from one stream of numbers, read in parallel.

The format is Q and F, then for each query its number n of documents, their features and target, and their n by n matrix of weights. Where
a query begins follows from all queries before it, and line breaks mean nothing. Still no task reads the whole:

1. A block of the scan is cut into pieces as it is read, so no number is shuffled; blocks are counted, which gives every piece its position.
2. At every position of a piece a query could begin, and would end where n says. Following these jumps to the end of the piece
   (by doubling) gives where a chain that enters the piece anywhere leaves it. Chains soon meet, so few positions are left at which any chain enters a piece.
3. From the first query these few jumps are followed by doubling; what is reached is where the true chain enters each piece.
4. Each piece walks its part of the true chain and counts its queries; then it walks again with their numbers and cuts out documents and rows of
   matrices. Only those that lie across the end of a piece are put together by a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.sources import shared

#: Q and F come before the first query.
FIRST = 2


def _dealt(size: int):
    """Pieces of each block of the scan, whose lines come one after another; the numbers of a piece are one compressed value."""

    def made(place: tuple, k: int, x: np.ndarray) -> pa.RecordBatch:
        body = zstandard.ZstdCompressor(level=1).compress(x.tobytes())
        head = pa.array([x[:2].tolist()], pa.list_(pa.float64()))
        return pa.RecordBatch.from_arrays([pa.array([place[0]], pa.string()), pa.array([place[1]], pa.int64()), pa.array([k], pa.int64()), pa.array([len(x)], pa.int64()), head, pa.array([body], pa.binary())], ["file", "block", "k", "n", "head", "x"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, k, held = None, 0, np.zeros(0)
        for batch in batches:
            at = 0
            for own, lines in groupby(zip(batch.column("file").to_pylist(), batch.column("block").to_pylist(), strict=True)):
                n = sum(1 for _ in lines)
                if own != place:
                    if len(held):
                        yield made(place, k, held)
                    place, k, held = own, 0, np.zeros(0)
                held = np.concatenate([held, batch.column("x").slice(at, n).flatten().to_numpy(zero_copy_only=False)])
                at += n
                cut = 0
                for cut in range(size, len(held) + 1, size):
                    yield made(place, k, held[cut - size : cut])
                    k += 1
                held = held[cut:]
        if len(held):
            yield made(place, k, held)

    return run


def _pieces(spark: SparkSession, path: str, home: str, size: int) -> DataFrame:
    """(file, block, k, n, head, x): the k-th piece of a block, its n numbers and the first two of them."""
    numbers = F.transform(F.filter(F.split("value", r"\s+"), lambda v: v != ""), lambda v: v.cast("double"))
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), numbers.alias("x"))
    return shared.stored(lines.where(F.size("x") > 0).mapInArrow(_dealt(size), "file string, block long, k long, n long, head array<double>, x binary"), f"{home}/pieces")


def _numbers(body: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(body))


def _valid(x: np.ndarray) -> np.ndarray:
    return np.isfinite(x) & (x >= 0) & (x < 1 << 30) & (x == np.floor(x))


def _jumps(x: np.ndarray, at: int, features: int) -> np.ndarray:
    """For each position the one behind a query that would begin there; -1 where none can."""
    n = np.where(_valid(x), x, -1).astype(np.int64)
    return np.where(n >= 0, np.arange(at, at + len(x)) + 1 + n * (features + 1) + n * n, -1)


def _exits(x: np.ndarray, at: int, features: int) -> np.ndarray:
    """Where a chain from each position leaves the piece."""
    out, end = _jumps(x, at, features), at + len(x)
    while ((out >= 0) & (out < end)).any():
        inside = (out >= 0) & (out < end)
        out[inside] = out[out[inside] - at]
    return out


def _chain(x: np.ndarray, at: int, entry: int, features: int) -> list[tuple[int, int]]:
    """(start, n) of the queries of a chain that begin in a piece."""
    out, here = [], entry
    while at <= here < at + len(x) and _valid(x[here - at]):
        n = int(x[here - at])
        out.append((here, n))
        here += 1 + n * (features + 1) + n * n
    return out


def _cut(x: np.ndarray, at: int, query: np.ndarray, start: np.ndarray, n: np.ndarray, features: int) -> pa.RecordBatch:
    """What a piece holds of the documents (kind 0) and of the rows of the matrices (kind 1) of queries."""
    out, end = [], at + len(x)
    for kind, base, length in ((0, start + 1, np.full(len(n), features + 1)), (1, start + 1 + n * (features + 1), n)):
        step = np.maximum(length, 1)
        low = np.clip((at - base) // step, 0, n)
        many = np.maximum(np.clip((end - 1 - base) // step, -1, n - 1) - low + 1, 0)
        of = np.repeat(np.arange(len(n)), many)
        d = np.arange(len(of)) - np.repeat(np.cumsum(many) - many, many) + low[of]
        pos, size = base[of] + d * length[of], length[of]
        first, last = np.maximum(pos, at), np.minimum(pos + size, end)
        some = last > first
        out.append([v[some] for v in (query[of], d, np.full(len(of), kind, np.int32), first, (first == pos) & (last == pos + size), last - first)])
    of, d, kind, first, whole, size = (np.concatenate(v) for v in zip(*out, strict=True))
    ends = np.concatenate([[0], np.cumsum(size)])
    places = np.repeat(first - at - ends[:-1], size) + np.arange(ends[-1])
    lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(x[places]))
    return pa.RecordBatch.from_arrays([pa.array(of), pa.array(d), pa.array(kind), pa.array(first), pa.array(whole), lists], ["query_id", "d", "kind", "at", "whole", "x"])


def read(spark: SparkSession, path: str, size: int = 1 << 20) -> tuple[DataFrame, DataFrame]:
    """Documents (query_id, doc_id, features, target) and pairs (query_id, i, j, w) whose weight isn't 0."""
    home = shared.work_dir(spark, "ranking")
    stored = _pieces(spark, path, home, size)
    head = stored.where("k = 0").select("file", "block", "head").orderBy("file", "block").limit(2).collect()
    given = [v for r in head for v in r["head"]][:2]
    queries, features = (int(given[0]), int(given[1])) if len(given) == 2 else (0, 0)

    blocks, offsets, total = stored.groupBy("file", "block").agg(F.sum("n").alias("n")).orderBy("file", "block").collect(), [], 0
    for r in blocks:
        offsets.append((r["file"], r["block"], total))
        total += r["n"]
    bounds = np.array([o[2] for o in offsets] or [0], np.int64)
    pieces = stored.join(F.broadcast(spark.createDataFrame(offsets, "file string, block long, offset long")), ["file", "block"]).select((F.col("offset") + F.col("k") * size).alias("piece"), "x")

    @F.pandas_udf("long")
    def piece_of(at: pd.Series) -> pd.Series:
        """The first position of the piece in which a position lies."""
        first = bounds[np.searchsorted(bounds, at.to_numpy(), "right") - 1]
        return pd.Series(first + (at.to_numpy() - first) // size * size)

    def leave(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at, body in zip(part["piece"].tolist(), part["x"], strict=True):
                found = np.unique(_exits(_numbers(body), at, features))
                yield pd.DataFrame({"at": found[(found >= 0) & (found < total)]})

    start = spark.range(1).select(F.lit(FIRST).cast("long").alias("at"))
    entries = pieces.mapInPandas(leave, "at long").union(start).distinct().withColumn("piece", piece_of("at"))
    entries = shared.stored(entries.groupBy("piece").agg(F.collect_list("at").alias("own")), f"{home}/entries")

    def follow(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at, body, own in zip(part["piece"].tolist(), part["x"], part["own"], strict=True):
                x, own = _numbers(body), np.asarray(own, np.int64)
                own = own[own - at < len(x)]
                yield pd.DataFrame({"at": own, "to": _exits(x, at, features)[own - at]})

    # Whether what is known of a piece is sent to all pieces, or pieces to it, is left to Spark's estimate of its size.
    jump = shared.stored(pieces.join(entries, "piece").mapInPandas(follow, "at long, to long").where("to >= 0"), f"{home}/jump-0")
    reached, turn, known = start, 0, 1
    while True:  # twice as far each time
        turn += 1
        reached = shared.stored(reached.union(reached.join(jump, "at").select(F.col("to").alias("at"))).distinct(), f"{home}/reached-{turn}")
        now = reached.count()
        if now == known:
            break
        known, further = now, jump.select(F.col("at").alias("to"), F.col("to").alias("end"))
        jump = shared.stored(jump.join(further, "to").select("at", F.col("end").alias("to")), f"{home}/jump-{turn}")

    def walk(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for at, body, entry in zip(part["piece"].tolist(), part["x"], part["entry"].tolist(), strict=True):
                found = _chain(_numbers(body), at, entry, features)
                if found:
                    yield pd.DataFrame([(at, entry, len(found), *found[-1])], columns=["piece", "entry", "many", "start", "n"])

    own = shared.stored(reached.withColumn("piece", piece_of("at")).groupBy("piece").agg(F.min("at").alias("entry")), f"{home}/own")
    walked = pieces.join(own, "piece").mapInPandas(walk, "piece long, entry long, many long, start long, n long").toPandas().sort_values("piece")
    # One row for each piece: where its first query begins and which number it has, and the query that comes over from the pieces before.
    starts, ns, upto = walked["start"].to_numpy(np.int64), walked["n"].to_numpy(np.int64), np.cumsum(walked["many"].to_numpy(np.int64))
    firsts = np.concatenate([np.zeros(0, np.int64), *(np.arange(o[2], o[2] + r["n"], size) for o, r in zip(offsets, blocks, strict=True))])
    before = np.searchsorted(starts, firsts) - 1
    over = (before >= 0) & (starts[before] + 1 + ns[before] * (features + 1 + ns[before]) > firsts) if len(starts) else np.zeros(len(firsts), bool)
    here = pd.DataFrame({"piece": walked["piece"].to_numpy(np.int64), "entry": walked["entry"].to_numpy(np.int64), "first": upto - walked["many"].to_numpy(np.int64)})
    crossing = pd.DataFrame({"piece": firsts[over], "last_start": starts[before[over]], "last_n": ns[before[over]], "last_id": upto[before[over]] - 1})
    tasks = here.merge(crossing, "outer", "piece").fillna(-1).astype("int64")
    tasks = shared.stored(spark.createDataFrame(tasks, "piece long, entry long, first long, last_start long, last_n long, last_id long"), f"{home}/tasks")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                x, at = _numbers(r["x"]), r["piece"]
                found = _chain(x, at, r["entry"], features) if r["entry"] >= 0 else []
                made = np.array([(r["first"] + i, *f) for i, f in enumerate(found)] + [(r["last_id"], r["last_start"], r["last_n"])] * (r["last_id"] >= 0), np.int64).reshape(-1, 3)
                made = made[made[:, 0] < queries]
                if len(made):
                    yield _cut(x, at, *made.T, features)

    parts = shared.stored(pieces.join(tasks, "piece").mapInArrow(cut, "query_id long, d long, kind int, at long, whole boolean, x array<double>"), f"{home}/parts")
    joined = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda p: p["x"]))
    across = parts.where(~F.col("whole")).groupBy("query_id", "d", "kind").agg(joined.alias("x"))
    rows = parts.where("whole").select("query_id", "d", "kind", "x").unionByName(across)
    docs = rows.where("kind = 0").select("query_id", F.col("d").alias("doc_id"), F.slice("x", 1, features).alias("features"), F.element_at("x", -1).alias("target"))
    pairs = rows.where("kind = 1").select("query_id", F.col("d").alias("i"), F.posexplode("x").alias("j", "w")).where("w <> 0")
    return docs, pairs.withColumn("j", F.col("j").cast("long"))
