"""Best-fit-decreasing packing of whole documents into windows (operator 3).

Documents are dealt evenly by a hash, so that each task has its fair share of every source, and each task encodes and
packs what it got: ids are made where they are used, and there is one shuffle, of texts. Within a task overlong
documents are first cut into full windows; the remainders, longest first, each go to the open window with the least room
that still holds them. A segment tree over the amounts of room finds that window. A task packs blocks of bounded size, so
its memory does not grow with the data, and a block leaves few windows that are not full.

Defined cases: null text is empty and holds the end id only; repeated rows are packed one by one; an empty table gives
no rows; a null document key stays null; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import common
from terravane.llm.encoder import encoder

WINDOW = 4096
PART_BYTES = 16 << 20
BLOCK_TOKENS = 16_000_000


class BestFit:
    """Open windows by their room; ``place`` is best fit."""

    def __init__(self, window: int):
        self.window, self.leaves, self.used = window, 1 << window.bit_length(), 0
        self.tree = [0] * (2 * self.leaves)  # windows open at or below a node
        self.by_room: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.tree[node] += by
            node >>= 1

    def _least(self, room: int) -> int | None:
        """The least room of an open window that is ``room`` or more."""
        tree, node = self.tree, self.leaves + room
        if tree[node]:
            return room
        while node > 1:  # up to the first right sibling that holds a window, then down on its left side
            if not node & 1 and tree[node + 1]:
                node += 1
                while node < self.leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
                return node - self.leaves
            node >>= 1
        return None

    def place(self, length: int) -> tuple[int, int]:
        """Window and offset in it."""
        room = self._least(length)
        if room is None:
            number, room = self.used, self.window
            self.used += 1
        else:
            number = self.by_room[room].pop()
            self._add(room, -1)
        if room > length:
            self.by_room[room - length].append(number)
            self._add(room - length, 1)
        return number, self.window - room


def layout(lengths: list[int], window: int) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, window, offset) of documents of the given lengths."""
    fit, out, rest = BestFit(window), [], []
    for i, n in enumerate(lengths):
        for start in range(0, n - window + 1, window):
            out.append((i, start, window, *fit.place(window)))
        if n % window:
            rest.append((n % window, i))
    for n, i in sorted(rest, key=lambda x: (-x[0], x[1])):
        out.append((i, lengths[i] - n, n, *fit.place(n)))
    return out


def _pack(tokenizer: str, end_id: int, window: int, kind: pa.DataType):
    schema = pa.schema([("key", kind), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), end_id.to_bytes(4, "little")
        task, used = TaskContext.get().partitionId() << 33, 0
        keys: list = []
        ids: list[bytes] = []

        def block() -> Iterator[pa.RecordBatch]:
            nonlocal used
            pieces = sorted(layout([len(x) // 4 for x in ids], window), key=lambda p: p[3:])
            for k in range(0, len(pieces), 1000):
                now = pieces[k : k + 1000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[p[0]] for p in now], kind), pa.array([p[1] for p in now], pa.int64()), pa.array([p[2] for p in now], pa.int64()),
                        pa.array([len(ids[p[0]]) // 4 for p in now], pa.int64()), pa.array([task + used + p[3] for p in now], pa.int64()), pa.array([p[4] for p in now], pa.int64()),
                        pa.array([ids[p[0]][4 * p[1] : 4 * (p[1] + p[2])] for p in now], pa.binary()),
                    ],
                    schema=schema,
                )
            used += max((p[3] + 1 for p in pieces), default=0)
            keys.clear()
            ids.clear()

        size = 0
        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                keys.append(key)
                ids.append(enc.encode(text) + end)
                size += len(ids[-1]) // 4
                if size >= BLOCK_TOKENS:
                    yield from block()
                    size = 0
        yield from block()

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, key: str = "doc_id", text: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """Packs ``docs`` and returns their pieces: key, start, length, doc_tokens, sequence_id, offset, ids.

    A sequence is what its pieces, by offset, hold one after another; ids are little-endian and 32 bits wide. A
    sequence is padded from its last piece up to ``window``.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    slim = docs.select(F.col(key).alias("key"), common.text_of(text).alias("text"))
    n = common.parts(common.text_bytes(slim), part_bytes)
    dealt = slim.withColumn("deal", F.xxhash64("key", "text")).repartition(n, "deal").select("key", "text")
    kind = slim.schema["key"].dataType
    return dealt.mapInArrow(_pack(tokenizer, end_id, window, to_arrow_type(kind)), f"key {kind.simpleString()}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table, packed into windows of 4096 ids."""
    import public_tokenizers

    pieces = pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
    return pieces.select(F.col("key").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
