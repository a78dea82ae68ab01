"""Removal of passages that occurred before, found by windows of three lines (operator 9).

Lines are compared without white space at their ends. Every three consecutive lines of a document are a window; the windows of all
documents overlap. A window's first occurrence (smallest document id, then the earliest place) stays. Every later one covers
its three lines, coverings that touch or overlap merge, and covered lines are removed from the text as they stand.

Batches of documents (see ``batches``) ask the buckets of window hashes about their distinct windows; an entry is a hash of
128 bits and the smallest document id in the batch, so a passage that a third of all documents share is one entry for
each batch. The reply is one bit for each window: whether its first occurrence lies in that batch. Texts are not shuffled.

Defined cases: null text is empty; a document of fewer than three lines has no windows; three blank lines are no window; where a
window occurs again before its first occurrence has ended, only the lines beyond that first occurrence are covered;
null ids come last; rows with equal ids are taken in the order of batches; texts are read whole; an empty table gives no
rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import batches, common

WINDOW = 3
BUCKET_BYTES = 64 << 20
#: Fixed value: white space that is ignored at the ends of lines.
ENDS = " \t\n\x0b\x0c\r"
_LAST = np.iinfo(np.int64).max


def windows(text: str) -> tuple[list[str], list[bytes | None]]:
    """The lines of a text as they stand, and the hash of the window that begins at each; none where all three lines are blank."""
    lines = text.split("\n")
    bare = [x.strip(ENDS) for x in lines]
    out = []
    for i in range(len(bare) - WINDOW + 1):
        own = bare[i : i + WINDOW]
        out.append(xxhash.xxh3_128_digest("\n".join(own).encode("utf-8", "surrogatepass")) if any(own) else None)
    return lines, out


def in_order(names: list) -> list[int]:
    """Places of a batch's documents by id; nulls last, equal ids as they stand."""
    return sorted(range(len(names)), key=lambda i: (names[i] is None, names[i] or 0, i))


def distinct_windows(names: list, texts: list[str]) -> dict[bytes, int]:
    """Each window of a batch with the document of its first occurrence there."""
    first: dict[bytes, int] = {}
    for i in in_order(names):
        for w in windows(texts[i])[1]:
            if w is not None and w not in first:
                first[w] = i
    return first


def _sorted(first: dict[bytes, int], names: list, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes in the order of their buckets, the buckets, and document ids."""
    keys = np.frombuffer(b"".join(first), "<u8").reshape(-1, 2)
    ids = np.array([_LAST if names[i] is None else names[i] for i in first.values()], np.int64)
    bucket = ((keys[:, 0] >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((keys[:, 1], keys[:, 0], bucket))
    return keys[order], bucket[order], ids[order]


def _asks(buckets: int):
    def run(batch: int, names: list, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        keys, bucket, ids = _sorted(distinct_windows(names, texts), names, buckets)
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        for b in sorted({0, *np.flatnonzero(np.diff(ends)).tolist()}):  # each batch asks something, so each has a reply
            at = slice(ends[b], ends[b + 1])
            yield b, keys[at].tobytes() + ids[at].tobytes()

    return run


def _answers(bucket: int, names: list[int], bodies: list[bytes]) -> list[bytes]:
    """For each window whether the batch has its first occurrence: the smallest id, then the first batch."""
    sizes = [len(b) // 24 for b in bodies]
    keys = np.concatenate([np.frombuffer(b, "<u8", 2 * n).reshape(-1, 2) for b, n in zip(bodies, sizes, strict=True)])
    ids = np.concatenate([np.frombuffer(b, "<i8", n, 16 * n) for b, n in zip(bodies, sizes, strict=True)])
    batch = np.repeat(np.arange(len(bodies)), sizes)
    order = np.lexsort((batch, ids, keys[:, 1], keys[:, 0]))
    new = np.ones(len(order), bool)
    new[1:] = (keys[order][1:] != keys[order][:-1]).any(axis=1)
    first = np.zeros(len(order), bool)
    first[order[new]] = True
    ends = np.cumsum(sizes)
    return [np.packbits(first[e - n : e]).tobytes() for e, n in zip(ends.tolist(), sizes, strict=True)]


def covered(hashes: list[bytes | None], seen: dict[bytes, tuple[int, int] | None], document: int) -> set[int]:
    """Lines of later occurrences. ``seen``: first occurrences so far by document and place, none for those in other batches; it grows."""
    out: set[int] = set()
    for i, w in enumerate(hashes):
        if w is None:
            continue
        if w not in seen:
            seen[w] = (document, i)
            continue
        first = seen[w]
        begin = i if first is None or first[0] != document else max(i, first[1] + WINDOW)
        out.update(range(begin, i + WINDOW))
    return out


def spans(places: set[int]) -> list[dict]:
    """Runs of covered lines, end exclusive."""
    out: list[dict] = []
    for i in sorted(places):
        if out and out[-1]["end"] == i:
            out[-1]["end"] = i + 1
        else:
            out.append({"start": i, "end": i + 1})
    return out


_RESULT = "key long, text string, n_lines long, n_removed long, spans array<struct<start: long, end: long>>"


def _clean(buckets: int):
    def run(batch: int, names: list, texts: list[str], replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        first = distinct_windows(names, texts)
        keys, bucket, _ = _sorted(first, names, buckets)
        seen: dict[bytes, tuple[int, int] | None] = {}
        ends = np.searchsorted(bucket, np.arange(buckets + 1))
        for b, body in replies.items():
            own = keys[ends[b] : ends[b + 1]]
            here = np.unpackbits(np.frombuffer(body, np.uint8), count=len(own)).astype(bool)
            seen.update(dict.fromkeys((k.tobytes() for k in own[~here]), None))
        out: list = [None] * len(names)
        for i in in_order(names):
            lines, hashes = windows(texts[i])
            gone = covered(hashes, seen, i)
            text = "\n".join(x for k, x in enumerate(lines) if k not in gone) if gone else texts[i]
            out[i] = (names[i], text, len(lines), len(gone), spans(gone))
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["key", "text", "n_lines", "n_removed", "spans"])

    return run


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document without passages that occurred before: key, text, n_lines, n_removed, spans (of removed lines, from 0)."""
    spark = docs.sparkSession
    home = common.shared_dir(spark, "line-dedup")
    rows = batches.batched(docs, f"{home}/batches", key, text)
    buckets = max(64, common.parts(batches.totals(rows)[1], BUCKET_BYTES, 4096))
    batches.deliver(batches.answer(batches.ask("lines", rows, _asks(buckets)), _answers), f"{home}/replies")
    return batches.finish("lines", rows, f"{home}/replies", _clean(buckets), _RESULT)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table without repeated passages."""
    out = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("key").alias("doc_id"), "n_lines", "n_removed", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


OP9_SQL = """
with d as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents),
l as (select doc_id, cast(p as bigint) as p, lines[p] as line, len(lines) as n_lines,
    regexp_replace(lines[p], '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g') as bare
  from (select doc_id, lines, unnest(range(1, len(lines) + 1)) as p from d) x),
w as (select doc_id, p, bare || chr(10) || lead(bare, 1) over o || chr(10) || lead(bare, 2) over o as h
  from l window o as (partition by doc_id order by p)),
f as (select doc_id, p, first_value(doc_id) over o as first_doc, first_value(p) over o as first_p
  from w where h is not null and h <> chr(10) || chr(10) window o as (partition by h order by doc_id, p)),
c as (select distinct doc_id, p + unnest([0, 1, 2]) as q, first_doc, first_p from f where doc_id <> first_doc or p <> first_p),
g as (select distinct doc_id, q as p from c where doc_id <> first_doc or q > first_p + 2)
select l.doc_id, cast(max(l.n_lines) as bigint) as n_lines, count(g.p) as n_removed,
  sha256(coalesce(string_agg(l.line, chr(10) order by l.p) filter (where g.p is null), '')) as text_sha256
from l left join g on l.doc_id = g.doc_id and l.p = g.p group by l.doc_id
"""
