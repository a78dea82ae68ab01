"""Exact dedup against a minimal perfect hash index of digests seen before (operator 4).

A delivery of documents is reduced to digests of the normalised texts. The index holds every distinct digest of earlier
deliveries: a slot keeps the full 32-byte digest, its winner (the longest original text, then the smallest id) and the size of
its group. The distinct digests of a new delivery are looked up; full digests are compared, so a hit is a repeat for
certain. Hits update their slot's group; the others form groups of their own, and join the index for the next delivery.

Digests lie in the index in ascending order of shards, and documents are dealt to the lookups by ranges of (digest,
id): a task needs the few shards of its range, and a digest that a third of all rows share spreads over many tasks. Groups
are counted with map-side sums. Nothing larger than a shard is held in memory.

Defined cases: null text is empty, and empty texts are equal; a null id comes after all others; of rows equal in length
and id the first one read stays; repeated rows each count; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import common, perfect_hash

SHARD_DIGESTS = 100_000
#: Fixed value: the white space that equality ignores.
WHITE_SPACE = "[\\x20\\x09-\\x0D]+"

_ENTRY = "digest binary, n_points long, keep_id long, keep_row long, group_size long"


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(common.text_of(text), WHITE_SPACE, "")


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", new: bool = True, row: Column | None = None) -> DataFrame:
    """(doc_id, n_points, digest, row, new) of every document, row telling rows of both deliveries apart."""
    number = F.monotonically_increasing_id() * 2 + int(new) if row is None else row
    return docs.select(
        F.col(key).cast("long").alias("doc_id"), F.length(common.text_of(text)).cast("long").alias("n_points"),
        F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256)).alias("digest"), number.alias("row"), F.lit(new).alias("new"),
    )


def _groups(rows: DataFrame, n: Column) -> DataFrame:
    """Entries of the distinct digests: most code points first, then the smallest id, then the first row."""
    first = F.min(F.struct((-F.col("n_points")).alias("a"), F.col("keep_id").isNull().alias("b"), F.col("keep_id").alias("c"), F.col("keep_row").alias("d")))
    return rows.groupBy("digest").agg(first.alias("m"), n.alias("group_size")).select("digest", (-F.col("m.a")).alias("n_points"), F.col("m.c").alias("keep_id"), F.col("m.d").alias("keep_row"), "group_size")


@dataclass(frozen=True)
class DigestIndex:
    uri: str
    shards: int


def _shard(shards: int) -> Column:
    """Shards are equal ranges of the digests' first four bytes."""
    head = F.conv(F.hex(F.substring("digest", 1, 4)), 16, 10).cast("long")
    return F.floor(head * F.lit(shards) / F.lit(1 << 32)).cast("int")


def _keys(col: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    raw = np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(-1, 32)
    words = raw.view("<u8")
    return raw, words[:, 1].copy(), words[:, 2].copy()


def _file(uri: str, shard: int) -> str:
    return f"{uri}/{shard:06d}.mph"


def _build(uri: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        raw, h1, h2 = _keys(table.column("digest"))
        fn = perfect_hash.PerfectHash.build(h1, h2)
        put = np.argsort(fn.slots(h1, h2))
        cols = {c: table.column(c).fill_null(0).to_numpy()[put] for c in ("n_points", "keep_id", "keep_row", "group_size")}
        cols["null_id"] = table.column("keep_id").is_null().to_numpy()[put]
        common.put_file(_file(uri, key[0].as_py()), perfect_hash.dump(sizes=fn.sizes, words=fn.words, digest=raw[put], **cols))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32())})

    return run


def build_index(entries: DataFrame, uri: str, shard_digests: int = SHARD_DIGESTS) -> DigestIndex:
    """Writes the index of ``entries`` (distinct digests) under ``uri``; a shard without digests is an empty file."""
    shards = common.parts(entries.count(), shard_digests)
    made = entries.withColumn("shard", _shard(shards)).groupBy("shard").applyInArrow(_build(uri), "shard int").collect()
    common.mark_empty(lambda shard: _file(uri, shard), shards, {r["shard"] for r in made})
    return DigestIndex(uri, shards)


def _lookup(index: DigestIndex, carried: pa.Schema):
    names = ["n_points", "keep_id", "keep_row", "group_size"]
    schema = pa.schema([*carried, pa.field("member", pa.bool_()), *[pa.field(f"seen_{c}", pa.int64()) for c in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("digests")
        at, shard = -1, None
        for batch in batches:
            raw, h1, h2 = _keys(batch.column("digest"))
            heads = raw[:, :4].copy().view(">u4").ravel().astype(np.int64)
            shards = heads * index.shards >> 32
            member, found = np.zeros(len(raw), bool), {c: np.zeros(len(raw), np.int64) for c in names}
            null_id = np.zeros(len(raw), bool)
            for s in np.unique(shards).tolist():
                if s != at:
                    body = common.get_file(_file(index.uri, s))
                    shard, at = perfect_hash.load(body) if body else None, s
                if shard is None:
                    continue
                mine = np.flatnonzero(shards == s)
                slot = perfect_hash.PerfectHash(shard["sizes"], shard["words"]).slots(h1[mine], h2[mine])
                same = (slot >= 0) & (shard["digest"][np.maximum(slot, 0)] == raw[mine]).all(axis=1)
                hit, slot = mine[same], slot[same]
                member[hit], null_id[hit] = True, shard["null_id"][slot]
                for c in names:
                    found[c][hit] = shard[c][slot]
            cols = [pa.array(found[c], pa.int64(), mask=~member | (null_id if c == "keep_id" else False)) for c in names]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(member), *cols], schema=schema)

    return run


def look_up(rows: DataFrame, index: DigestIndex) -> DataFrame:
    """``rows`` (with a column digest) plus member and the entry seen: seen_n_points, seen_keep_id, seen_keep_row, seen_group_size."""
    from pyspark.sql.pandas.types import to_arrow_schema

    tie = [c for c in ("doc_id", "row") if c in rows.columns]
    dealt = rows.repartitionByRange("digest", *tie).sortWithinPartitions("digest")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    seen = "member boolean, seen_n_points long, seen_keep_id long, seen_keep_row long, seen_group_size long"
    return dealt.mapInArrow(_lookup(index, to_arrow_schema(rows.schema)), f"{kinds}, {seen}")


def merge(new: DataFrame, history: DataFrame, index: DigestIndex) -> DataFrame:
    """Entries of the history and of a new delivery together.

    Distinct new digests are looked up: members take part in their slot's group, nonmembers stay groups of their own.
    """
    seen = look_up(new, index)
    own = seen.select("digest", "n_points", "keep_id", "keep_row", "group_size", "member")
    nonmembers = own.where(~F.col("member")).drop("member")
    updates = own.where("member").drop("member")
    return _groups(history.unionByName(updates), F.sum("group_size")).unionByName(nonmembers)


def dedup(docs: DataFrame, history: DataFrame | None = None, key: str = "doc_id", text: str = "text", shard_digests: int = SHARD_DIGESTS, row: Column | None = None) -> DataFrame:
    """One row for every document of ``docs`` and ``history``: doc_id, row, digest, n_points, keep_id, keep_row, group_size, kept.

    ``history`` are the documents of earlier deliveries; rows of both get the winner among both. ``row`` is a column that
    numbers the rows of both, for callers who want to find them again; without it they are numbered here.
    """
    spark = docs.sparkSession
    home = common.shared_dir(spark, "exact-dedup")
    slim = digests(docs, key, text, row=row)
    if history is not None:
        slim = slim.unionByName(digests(history, key, text, new=False, row=row))
    rows = common.stored(slim, f"{home}/digests")
    renamed = rows.select("digest", "n_points", F.col("doc_id").alias("keep_id"), F.col("row").alias("keep_row"), "new")
    entries = lambda flag: _groups(renamed.where(flag), F.count(F.lit(1)))
    if history is not None:
        old = common.stored(entries(~F.col("new")), f"{home}/history")
        index = build_index(old, f"{home}/seen", shard_digests)
        every = common.stored(merge(entries(F.col("new")), old, index), f"{home}/entries")
    else:
        every = common.stored(entries(F.col("new")), f"{home}/entries")
    found = look_up(rows.select("doc_id", "row", "digest", "n_points"), build_index(every, f"{home}/index", shard_digests))
    return found.select(
        "doc_id", "row", "digest", "n_points", F.col("seen_keep_id").alias("keep_id"), F.col("seen_keep_row").alias("keep_row"), F.col("seen_group_size").alias("group_size"),
        ((F.col("row") == F.col("seen_keep_row")) & F.col("doc_id").eqNullSafe(F.col("seen_keep_id"))).alias("kept"),
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table, as two deliveries: one hash half is the history of the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    half = F.pmod(F.xxhash64("doc_id"), F.lit(2))
    out = dedup(docs.where(half == 1), docs.where(half == 0))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


OP4_SQL = """
with t as (select doc_id, length(coalesce(text, '')) as n, sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) as text_sha256 from documents)
select doc_id, first_value(doc_id) over w as keep_id, count(*) over (partition by text_sha256) as group_size,
  doc_id = first_value(doc_id) over w as kept, text_sha256
from t window w as (partition by text_sha256 order by n desc, doc_id)
"""
