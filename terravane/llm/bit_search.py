"""Exact top-k by inner product on a bit-sliced index (operator 8).

Rows are dealt into blocks. A block holds every bit of every quantised attribute as one bitmap over its rows. The scores of
a query come as bitmaps as well: each attribute is added as often as the query's value says, bit by bit of that value,
with carry-save additions of whole bitmaps (a negative value adds the complement). The top rows are then read off the
score slices from the most significant one downward: rows with the bit set are in if there is room for all of them,
otherwise only they stay in question. Rows still tied after the last slice have equal scores; the smallest ids of them
are taken. The few rows of each block get their exact scores, and the blocks' best are merged.

Defined cases: a vector that is null or holds a null or non-finite component takes no part, and neither does a row whose
id is null; a shorter vector counts as padded with zeros; rows with the query's id are not its candidates; repeated
query ids count once, with their smallest vector; other repeated rows each count; an empty table gives no rows; other columns are not read and may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536
QUERY_ROWS = 50_000


def quantised(df: DataFrame, key: str, vector: str, scale: int = 256) -> DataFrame:
    """(vec_id, v): components as floor(scale * x), rows that can't take part left out."""
    sound = F.forall("x", lambda a: a.isNotNull() & ~F.isnan(a) & (F.abs(a.cast("double")) < float("inf")))
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("x")).where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & sound)
    return rows.select("vec_id", F.transform("x", lambda a: F.floor(a.cast("double") * scale).cast("long")).alias("v"))


def _matrix(col: pa.ChunkedArray) -> np.ndarray:
    col = col.combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], col.type)
    ends = col.offsets.to_numpy()
    flat, sizes = col.values.to_numpy(zero_copy_only=False)[ends[0] : ends[-1]], np.diff(ends)
    out = np.zeros((len(sizes), max(sizes.max(initial=0), 1)), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = flat
    return out


class BitSlices:
    """The index of one block; rows in ascending order of their ids."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, self.rows = ids[order], rows[order]
        self.low = self.rows.min(axis=0) if len(ids) else np.zeros(rows.shape[1], np.int64)
        above = self.rows - self.low
        self.bits = int(above.max(initial=0)).bit_length()
        pad = -len(ids) % 64
        self.planes = []  # for each bit: attributes, then their complements, by words of 64 rows
        for b in range(self.bits):
            plane = np.pad((above.T >> b & 1).astype(np.uint8), ((0, 0), (0, pad)))
            plane = np.ascontiguousarray(np.packbits(plane, axis=1, bitorder="little")).view("<u8")
            self.planes.append(np.concatenate([plane, ~plane]))
        self.all = np.packbits(np.pad(np.ones(len(ids), np.uint8), (0, pad)), bitorder="little").view("<u8")

    def score_slices(self, query: np.ndarray) -> list[np.ndarray]:
        """Bitmaps of the score less a constant, least significant first."""
        size, attribute = np.abs(query), np.where(query < 0, np.arange(len(query)) + len(query), np.arange(len(query)))
        columns: dict[int, list[np.ndarray]] = {}
        for j in range(int(size.max(initial=0)).bit_length()):
            chosen = attribute[size >> j & 1 == 1]
            if len(chosen):
                for b in range(self.bits):
                    columns.setdefault(j + b, []).append(self.planes[b][chosen])
        out, weight = [], 0
        while columns:
            stack = columns.pop(weight, None)
            if stack is None:
                out.append(np.zeros_like(self.all))
                weight += 1
                continue
            x = np.concatenate(stack) if len(stack) > 1 else stack[0]
            while len(x) > 1:
                if len(x) == 2:
                    columns.setdefault(weight + 1, []).append(x[:1] & x[1:])
                    x = x[:1] ^ x[1:]
                else:
                    k = len(x) // 3
                    a, b, c = x[:k], x[k : 2 * k], x[2 * k : 3 * k]
                    ab = a ^ b
                    columns.setdefault(weight + 1, []).append((a & b) | (ab & c))
                    ab ^= c
                    x = np.concatenate([ab, x[3 * k :]]) if len(x) % 3 else ab
            out.append(x[0])
            weight += 1
        return out

    def top(self, own: int, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids and exact scores of the best k rows whose id isn't ``own``."""
        width = max(len(query), self.rows.shape[1])
        if len(query) < width:
            query = np.pad(query, (0, width - len(query)))
        query = query[: self.rows.shape[1]]  # beyond the block's width every row has zeros
        open_, into = self.all.copy(), np.zeros_like(self.all)
        first, last = np.searchsorted(self.ids, [own, own + 1])
        for i in range(first, last):
            open_[i >> 6] &= ~np.uint64(1 << (i & 63))
        have = 0
        if int(np.bitwise_count(open_).sum()) > k:
            for plane in reversed(self.score_slices(query)):
                with_bit = open_ & plane
                n = int(np.bitwise_count(with_bit).sum())
                if have + n > k:
                    open_ = with_bit
                else:
                    into |= with_bit
                    have += n
                    open_ &= ~plane
                    if have == k:
                        break
        chosen = np.flatnonzero(np.unpackbits(into.view(np.uint8), bitorder="little"))
        if have < k:  # equal scores, or no more than k rows in all
            words = np.flatnonzero(open_)[:k]
            bits = [np.flatnonzero(np.unpackbits(open_[w : w + 1].view(np.uint8), bitorder="little")) + 64 * w for w in words]
            chosen = np.concatenate([chosen, *bits])[:k]
        return self.ids[chosen], self.rows[chosen] @ query


def _search(k: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if rows.num_rows and asked.num_rows:
            index = BitSlices(rows.column("vec_id").to_numpy(), _matrix(rows.column("v")))
            for own, query in zip(asked.column("vec_id").to_numpy().tolist(), _matrix(asked.column("v")), strict=True):
                ids, scores = index.top(own, query, k)
                for x, y in zip(out, (np.full(len(ids), own), ids, scores), strict=True):
                    x.append(y)
        return pa.table({n: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for n, x in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def top_k(rows: DataFrame, queries: DataFrame, k: int, block_rows: int = BLOCK_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """For each of ``queries`` (vec_id, v) its k best of ``rows`` (vec_id, v): query_id, rank, vec_id, score.

    Every block of rows meets every group of queries once, in a task of bounded size.
    """
    spark = rows.sparkSession
    n, m = rows.count(), queries.count()
    blocks = max(-(-n // block_rows), min(-(-n // 12_000), spark.sparkContext.defaultParallelism), 1)
    groups = max(1, -(-m // query_rows))
    place = F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks))
    group = F.pmod(F.xxhash64("vec_id"), F.lit(groups))
    left = rows.select("vec_id", "v", place.alias("block"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(groups - 1).cast("long"))).alias("group"))
    right = queries.groupBy("vec_id").agg(F.min("v").alias("v")).select("vec_id", "v", group.alias("group"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block"))
    found = left.groupBy("block", "group").cogroup(right.groupBy("block", "group")).applyInArrow(_search(k), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_bit_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best rows for every row whose id is divisible by 50."""
    rows = quantised(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % 50 == 0), 5)


OP8_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(cast(x as double)))) = 0),
q as (select * from v where vec_id % 50 = 0),
s as (select q.vec_id as query_id, v.vec_id, cast(list_sum(list_transform(list_zip(q.v, v.v), lambda z: z[1] * z[2])) as bigint) as score
  from q join v on q.vec_id <> v.vec_id),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""
