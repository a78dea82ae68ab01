"""Corpus-wide questions asked batch by batch.

Several operators need, for every word, shingle or line of a document, a fact about all documents. Joining each occurrence with
a table of facts would shuffle the corpus many times over. Here documents are put into batches of some megabytes, stored
as one row each, their texts in one compressed value; a batch asks about its distinct keys once, so what is shuffled is counted within the batch already and a key
that is in every document sends one entry for each batch; the replies for a batch are laid down as files beside it,
and the batch is read again together with them. Batches are rows of a stored table, so every attempt of a task sees
the same batch.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm import common

BATCH_BYTES = 6 << 20
#: What a row counts for besides its text, so that a batch of empty texts is bounded as well.
ROW_BYTES = 16
_ASK = "bucket int, batch long, body binary"


def _packed(number: int, names: list, texts: list[str], size: int) -> pa.RecordBatch:
    body = pa.BufferOutputStream()
    own = pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(texts, pa.large_string())], ["key", "text"])
    with pa.ipc.new_stream(body, own.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(own)
    cols = [pa.array([number], pa.int64()), pa.array([len(names)], pa.int64()), pa.array([size], pa.int64()), pa.array([body.getvalue().to_pybytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(cols, ["batch", "documents", "size", "body"])


def _unpacked(body: bytes) -> tuple[list, list[str]]:
    with pa.ipc.open_stream(body) as r:
        own = r.read_next_batch()
    return own.column("key").to_pylist(), own.column("text").to_pylist()


def texts_of(body: bytes) -> list[str]:
    return _unpacked(body)[1]


def _gather(most: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        names: list = []
        texts: list[str] = []
        size = 0
        for part in parts:
            for name, text in zip(part.column("key").to_pylist(), part.column("text").to_pylist(), strict=True):
                if texts and size + len(text) + ROW_BYTES > most:
                    yield _packed(number, names, texts, size)
                    number, names, texts, size = number + 1, [], [], 0
                names.append(name)
                texts.append(text)
                size += len(text) + ROW_BYTES
        if texts:
            yield _packed(number, names, texts, size)

    return run


def batched(docs: DataFrame, uri: str, key: str = "doc_id", text: str = "text", most: int = BATCH_BYTES) -> DataFrame:
    """Stores ``docs`` as rows (batch, documents, size, body) under ``uri``; null texts become empty ones."""
    slim = docs.select(F.col(key).cast("long").alias("key"), common.text_of(text).alias("text"))
    return common.stored(slim.mapInArrow(_gather(most), "batch long, documents long, size long, body binary"), uri)


def totals(batches: DataFrame) -> tuple[int, int]:
    """Documents, and characters with ``ROW_BYTES`` for each."""
    row = batches.agg(F.sum("documents").alias("n"), F.sum("size").alias("s")).first()
    return row["n"] or 0, row["s"] or 0


def ask(owner: str, batches: DataFrame, asks: Callable[[int, list, list[str]], Iterator[tuple[int, bytes]]]) -> DataFrame:
    """(bucket, batch, body): what each batch asks the buckets. ``owner`` names the operator for ``common.claim``."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                batch = part.column("batch")[k].as_py()
                common.claim(owner)
                sent = list(asks(batch, *_unpacked(part.column("body")[k].as_py())))
                yield pa.RecordBatch.from_arrays([pa.array([s[0] for s in sent], pa.int32()), pa.array([batch] * len(sent), pa.int64()), pa.array([s[1] for s in sent], pa.binary())], ["bucket", "batch", "body"])
                common.give_back()

    return batches.select("batch", "body").mapInArrow(run, _ASK)


def answer(asked: DataFrame, answers: Callable[[int, list[int], list[bytes]], list[bytes]]) -> DataFrame:
    """(bucket, batch, body): the reply of each bucket to each batch that asked it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        table = table.sort_by("batch")
        batches = table.column("batch").to_pylist()
        replies = answers(key[0].as_py(), batches, table.column("body").to_pylist())
        return pa.table({"bucket": pa.array([key[0].as_py()] * len(batches), pa.int32()), "batch": pa.array(batches, pa.int64()), "body": pa.array(replies, pa.binary())})

    return asked.groupBy("bucket").applyInArrow(run, _ASK)


def deliver(replies: DataFrame, uri: str) -> int:
    """Lays the replies down, one file for each batch, and returns the number of files."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        name = key[0].as_py()
        with pa.BufferOutputStream() as out:
            with pa.ipc.new_stream(out, table.select(["bucket", "body"]).schema) as w:
                w.write_table(table.select(["bucket", "body"]).sort_by("bucket"))
            common.put_file(f"{uri}/{name}.reply", zlib.compress(out.getvalue().to_pybytes(), 1))
        return pa.table({"n": pa.array([1], pa.int64())})

    with common.tidy(replies.sparkSession):
        return replies.groupBy("batch").applyInArrow(run, "n long").agg(F.sum("n").alias("n")).first()["n"] or 0


def read_reply(uri: str, batch: int) -> dict[int, bytes]:
    with pa.ipc.open_stream(zlib.decompress(common.get_file(f"{uri}/{batch}.reply"))) as r:
        table = r.read_all()
    return dict(zip(table.column("bucket").to_pylist(), table.column("body").to_pylist(), strict=True))


def finish(owner: str, batches: DataFrame, uris: str | list[str], work: Callable[[int, list, list[str], dict[int, bytes]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Each batch with the replies to it. They may lie in several folders, in some of which a batch may have none."""
    folders = [uris] if isinstance(uris, str) else uris

    def read(batch: int) -> dict[int, bytes]:
        out: dict[int, bytes] = {}
        for uri in folders:
            try:
                out |= read_reply(uri, batch)
            except FileNotFoundError:  # ``work`` fails if it misses a reply
                if isinstance(uris, str):
                    raise
        return out

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k in range(part.num_rows):
                batch = part.column("batch")[k].as_py()
                common.claim(owner)
                yield from work(batch, *_unpacked(part.column("body")[k].as_py()), read(batch))
                common.give_back()

    return batches.select("batch", "body").mapInArrow(run, schema)
