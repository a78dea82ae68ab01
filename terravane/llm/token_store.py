"""Token-id files with a minimal perfect hash index (operator 2).

``write_store`` encodes whole texts and writes them in ascending key order into raw shard files; ``build_index`` maps every
document key to its place; ``fetch`` reads documents back by key. Layout of a store folder:

* ``shard-NNNNN.bin``: the ids of its documents one after another, little-endian, 16 bits wide where the vocabulary
  allows and 32 otherwise, with nothing between them;
* ``rows/``: a Parquet table of (shard, key, offset, n_tokens), the log from which the index is made;
* ``index-NNNNN.mph``: one minimal perfect hash function for each bucket of key hashes. A slot holds the key's 64-bit
  fingerprint and its run of entries; an entry holds shard, offset, length and the ids of all documents before it.

A lookup hashes the key to a bucket and a slot, compares the fingerprint and reads one range of one shard: the work does
not depend on the number of documents. Defined cases: null text is empty and holds the end id only; a null key sorts
first and is a key of its own; documents with equal keys are one slot with several entries, in the order of the shard;
an empty table gives a store without shards; columns other than key and text are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.llm import common, perfect_hash
from terravane.llm.encoder import encoder

SHARD_BYTES = 32 << 20
BUCKET_KEYS = 200_000


def _width(tokenizer: str) -> str:
    return "<u2" if encoder(tokenizer).size <= 1 << 16 else "<u4"


def _shards(tokenizer: str, end_id: int, out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, kind, shard, at = encoder(tokenizer), _width(tokenizer), TaskContext.get().partitionId(), 0
        fs, path = common.open_fs(f"{out}/shard-{shard:05d}.bin")
        part, file = f"{path}.{uuid.uuid4().hex}", None
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            offsets, counts = [], []
            for text in batch.column("text").to_pylist():
                if file is None:
                    file = fs.open_output_stream(part)
                ids = np.frombuffer(enc.encode(text) + end, "<u4")
                file.write(ids.astype(kind).tobytes())
                offsets.append(at)
                counts.append(len(ids))
                at += len(ids)
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * len(counts), pa.int32()), batch.column("key"), pa.array(offsets, pa.int64()), pa.array(counts, pa.int64())],
                ["shard", "key", "offset", "n_tokens"],
            )
        if file is not None:
            file.close()
            fs.move(part, path)

    return run


def write_store(docs: DataFrame, out: str, tokenizer: str, end_id: int, key: str = "doc_id", text: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes the shards of ``docs`` under the URI ``out`` and returns the log of rows.

    Shards are ranges of keys, so the concatenated shards hold the documents in ascending key order. The ranges are also
    cut by a hash of the text: one key with very many rows spreads over several shards.
    """
    spark = docs.sparkSession
    common.open_fs(out)[0].create_dir(common.open_fs(out)[1], recursive=True)
    slim = docs.select(F.col(key).alias("key"), common.text_of(text).alias("text"))
    n = max(common.parts(common.text_bytes(slim), shard_bytes), min(spark.sparkContext.defaultParallelism, 64))
    kind = slim.schema["key"].dataType.simpleString()
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    dealt = slim.repartitionByRange(n, *order).sortWithinPartitions(*order)
    rows = dealt.mapInArrow(_shards(tokenizer, end_id, out), f"shard int, key {kind}, offset long, n_tokens long")
    return common.stored(rows, f"{out}/rows")


def key_hashes(key: str) -> tuple[Column, Column]:
    """Two 64-bit hashes of a key of any type; null is a value of its own."""
    return (F.xxhash64(F.col(key).isNull(), F.col(key)), F.xxhash64(F.lit(0x5EED), F.col(key), F.col(key).isNull()))


def _bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    a, b = key_hashes(key)
    return df.withColumns({"h1": a, "h2": b}).withColumn("bucket", F.pmod(F.shiftrightunsigned("h2", 7), F.lit(buckets)).cast("int"))


def _index_file(out: str, bucket: int) -> str:
    return f"{out}/index-{bucket:05d}.mph"


def _indexer(out: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        col = {c: table.column(c).to_numpy() for c in ("h1", "h2", "shard", "offset", "start", "n_tokens")}
        h1, h2 = col["h1"].view(np.uint64), col["h2"].view(np.uint64)
        order = np.lexsort((col["offset"], col["shard"], h1, h2))
        h1, h2 = h1[order], h2[order]
        first = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        fn = perfect_hash.PerfectHash.build(h1[first], h2[first])
        slot, runs = fn.slots(h1[first], h2[first]), np.diff(np.append(first, len(h1)))
        prints, begin, run_len = np.zeros(len(first), np.uint64), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        prints[slot], begin[slot], run_len[slot] = h2[first], first, runs
        blob = perfect_hash.dump(sizes=fn.sizes, words=fn.words, prints=prints, begin=begin, runs=run_len, **{c: col[c][order] for c in ("shard", "offset", "start", "n_tokens")})
        common.put_file(_index_file(out, key[0].as_py()), blob)
        return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32())})

    return run


def build_index(rows: DataFrame, out: str, bucket_keys: int = BUCKET_KEYS) -> int:
    """Writes the index of the store ``out`` from its log of rows and returns the number of buckets; one without keys is an empty file."""
    sums = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    bases = sums.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("base"))
    buckets = common.parts(rows.count(), bucket_keys)
    placed = rows.join(bases, "shard").withColumn("start", F.col("base") + F.col("offset"))
    made = _bucketed(placed, "key", buckets).groupBy("bucket").applyInArrow(_indexer(out), "bucket int")
    common.mark_empty(lambda bucket: _index_file(out, bucket), buckets, {r["bucket"] for r in made.collect()})
    return buckets


def _lookup(out: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        body = common.get_file(_index_file(out, key[0].as_py()))
        z = perfect_hash.load(body) if body else None
        h1, h2 = (table.column(c).to_numpy().view(np.uint64) for c in ("h1", "h2"))
        if z is None or not len(z["prints"]):
            which = entry = np.zeros(0, np.int64)
            z = {c: np.zeros(0, np.int64) for c in ("shard", "offset", "start", "n_tokens")}
        else:
            slot = perfect_hash.PerfectHash(z["sizes"], z["words"]).slots(h1, h2)
            hit = np.flatnonzero((slot >= 0) & (z["prints"][np.maximum(slot, 0)] == h2))
            runs = z["runs"][slot[hit]]
            which = np.repeat(hit, runs)
            entry = np.repeat(z["begin"][slot[hit]] - (np.cumsum(runs) - runs), runs) + np.arange(runs.sum())
        return pa.table({"key": table.column("key").take(pa.array(which))} | {c: pa.array(z[c][entry].astype(np.int64)) for c in ("shard", "offset", "start", "n_tokens")})

    return run


def _read(out: str, kind: str):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        fs, path = common.open_fs(f"{out}/shard-{key[0].as_py():05d}.bin")
        width = np.dtype(kind).itemsize
        with fs.open_input_file(path) as f:
            ids = [np.frombuffer(f.read_at(n * width, at * width), kind).astype("<u4").tobytes() for at, n in zip(table.column("offset").to_pylist(), table.column("n_tokens").to_pylist(), strict=True)]
        return table.select(["key", "start", "n_tokens"]).append_column("ids", pa.array(ids, pa.binary()))

    return run


def fetch(keys: DataFrame, key: str, out: str, buckets: int, tokenizer: str) -> DataFrame:
    """The stored documents of each distinct key of ``keys``: key, start, n_tokens and ids (32-bit, little-endian)."""
    kind = keys.schema[key].dataType.simpleString()
    asked = _bucketed(keys.select(F.col(key).alias("key")).distinct(), "key", buckets)
    found = asked.groupBy("bucket").applyInArrow(_lookup(out), f"key {kind}, shard long, offset long, start long, n_tokens long")
    return found.groupBy("shard").applyInArrow(_read(out, _width(tokenizer)), f"key {kind}, start long, n_tokens long, ids binary")


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document of the table through a store of its own: written, indexed, read back by key."""
    import public_tokenizers

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = common.shared_dir(spark, "token-store")
    buckets = build_index(write_store(docs, out, tokenizer, end_id=1), out)
    return fetch(docs, "doc_id", out, buckets, tokenizer).select(F.col("key").alias("doc_id"), "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
