"""Ranked lexical search with block maxima (operator 11).

Documents are indexed where they are read: a task gathers texts of some megabytes into a shard, whose posting lists are cut into
blocks of ``BLOCK`` postings. A block is compressed (gaps and counts in one, two or four bytes) and stored with its last document and the largest
impact in it. Shards are rows of a stored table; texts are not shuffled.

A query is searched shard by shard (Block-Max WAND). The pointers of its lists move over block ends only, without decompression: between two
neighbouring ends every list stands in one block, and the weighted maxima of these blocks bound the score of any document there. Stretches whose
bound stays below the tenth best score so far are skipped; a query without ten scores yet begins where its lists of most impact have their first documents. The others are taken from the highest bound down; their blocks are
decompressed list by list, those of most impact first, and a stretch is left as soon as what was added up and the maxima of the lists that
remain can't reach the threshold. A task carries the threshold of a query from shard to shard. Tasks give their best documents of each item;
a ranking that Spark limits before its shuffle gives the best of all. Scores are integers, so pruning is exact, and a document that ties with the
threshold is not skipped.

Items are read by tasks from a stored table in blocks of about ``ITEMS``; a task holds one block and ten documents for each item.

Defined cases: a null or empty text has no term and isn't a document of the statistics; a null item text has no results; terms that no document
holds count for nothing; repeated rows are documents of their own; rows of one item id are one item; null ids of documents come last among equal scores;
empty tables give no rows; only id and text are read, other columns may have any name.
"""

from __future__ import annotations

import io
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from terravane.llm import common

BEST = 10
BLOCK = 64
SHARD_CHARS = 20 << 20
#: Blocks compressed at once.
SOME = 8192
ITEMS = 2000
#: Stretches looked at first; each further turn takes twice as many.
FIRST = 16
_NONE = np.iinfo(np.int64).max

#: Fixed rule: ASCII letters and digits and everything beyond ASCII are parts of terms; only A-Z are lower-cased.
_FOLD = bytes(b if chr(b).isalnum() or b > 127 else 32 for b in range(128)).lower() + bytes(range(128, 256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a text in UTF-8, with repeats."""
    return text.translate(_FOLD).split()


def _term_count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for batch in batches:
        yield pa.array([len(terms_of(t.as_py())) for t in batch.cast(pa.binary())], pa.int64())


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """Documents with a term, and all their terms: one scan with map-side sums."""
    n = docs.select(F.arrow_udf(_term_count, "bigint")(common.text_of(text)).alias("n")).where("n > 0")
    row = n.agg(F.count("*").alias("documents"), F.sum("n").alias("terms")).first()
    return row["documents"], row["terms"] or 0


class Shard:
    """Documents being gathered, then their compressed lists."""

    def __init__(self):
        self.ids: list[int] = []
        self.size: list[int] = []
        self.number: dict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.term: list[np.ndarray] = []
        self.count: list[np.ndarray] = []

    def add(self, key: int | None, text: bytes) -> None:
        terms = terms_of(text)
        if terms:
            own = Counter(terms)
            self.term.append(np.fromiter(map(self.number.__getitem__, own), np.int32, len(own)))
            self.count.append(np.fromiter(own.values(), np.int32, len(own)))
            self.ids.append(_NONE if key is None else key)
            self.size.append(len(terms))

    def packed(self, documents: int, terms: int) -> bytes:
        """The arrays of the shard; ``documents`` and ``terms`` are those of the whole corpus."""
        names = sorted(self.number)
        rank = np.empty(len(names), np.int32)
        rank[np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))] = np.arange(len(names), dtype=np.int32)
        self.number.clear()
        term = rank[np.concatenate(self.term)]
        doc = np.repeat(np.arange(len(self.ids), dtype=np.int32), [len(x) for x in self.term])
        self.term.clear()
        df = np.bincount(term, minlength=len(names))
        order = np.argsort(term, kind="stable")
        del term
        doc, tf = doc[order], np.concatenate(self.count)[order]
        self.count.clear()
        del order
        m = lengths(np.array(self.size, np.int64), documents, terms)
        blocks = -(-df // BLOCK)
        within = np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = np.repeat(np.cumsum(df) - df, blocks) + within * BLOCK
        length = np.minimum(BLOCK, np.repeat(np.cumsum(df), blocks) - start)
        last = doc[start + length - 1]
        gap = np.diff(doc, prepend=np.int32(0))
        gap[start] = doc[start] - np.where(within > 0, np.roll(last, 1), -1)
        most = np.empty(len(start), np.uint32)
        for at in range(0, len(start), SOME):
            first, end = start[at], start[min(at + SOME, len(start)) - 1] + length[min(at + SOME, len(start)) - 1]
            most[at : at + SOME] = np.maximum.reduceat(impacts(tf[first:end], m[doc[first:end]]), start[at : at + SOME] - first)
        del doc
        out = io.BytesIO()
        wide = [np.digitize(np.maximum.reduceat(x, start), [1 << 8, 1 << 16]).astype(np.uint8) for x in (gap, tf)]
        arrays = {"ids": np.array(self.ids, np.int64), "m": m, "names": np.frombuffer(b" ".join(names), np.uint8), "df": df.astype(np.int32)}
        del names, rank
        np.savez(out, **arrays, last=last, most=most, wide=wide[0] | wide[1] << 2, lists=_written(gap, tf, start, length, *wide))
        return out.getvalue()


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """The measure of a document's length that its terms are dampened by."""
    return 100 - 90 + (90 * n * documents) // terms


def impacts(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


def _places(length: np.ndarray, wide: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, int]:
    """Where the gaps and the counts of each block begin, and the bytes of all."""
    gaps, counts = length * (1 << wide[0].astype(np.int64)), length * (1 << wide[1].astype(np.int64))
    at = np.cumsum(gaps + counts) - gaps - counts
    return at, at + gaps, int((gaps + counts).sum())


def _written(gap: np.ndarray, tf: np.ndarray, start: np.ndarray, length: np.ndarray, *wide: np.ndarray) -> np.ndarray:
    *places, total = _places(length, list(wide))
    out = np.zeros(total, np.uint8)
    for at in range(0, len(start), SOME):
        some = slice(at, at + SOME)
        n, first = length[some], start[at]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        for values, begin, code in zip((gap, tf), places, wide, strict=True):
            own, each = values[first : first + len(within)], np.repeat(1 << code[some].astype(np.int64), n)
            place = np.repeat(begin[some], n) + within * each
            for k in range(4):
                far = each > k
                out[place[far] + k] = own[far] >> 8 * k & 255
    return out


class Lists:
    """A stored shard; blocks are decompressed when a query first needs them."""

    def __init__(self, body: bytes):
        with np.load(io.BytesIO(body)) as f:
            self.ids, self.m, self.df, self.last, self.wide, self.data = (f[x] for x in ("ids", "m", "df", "last", "wide", "lists"))
            self.names = f["names"].tobytes().split(b" ")
            self.most = f["most"].astype(np.int64)
        blocks = -(-self.df // BLOCK)
        self.ends = np.cumsum(blocks)
        self.first = self.ends - blocks
        length = np.full(len(self.last), BLOCK, np.int64)
        length[self.ends - 1] = self.df - BLOCK * (blocks - 1)
        self.length = length
        self.gaps, self.counts, _ = _places(length, [self.wide & 3, self.wide >> 2])
        self.open: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.sums = np.zeros(len(self.ids), np.int64)

    def find(self, term: bytes) -> int | None:
        at = bisect_left(self.names, term)
        return at if at < len(self.names) and self.names[at] == term else None

    def block(self, b: int, first: bool) -> tuple[np.ndarray, np.ndarray]:
        """Documents and impacts of a block."""
        if b not in self.open:
            n, wide = int(self.length[b]), int(self.wide[b])
            gap = np.frombuffer(self.data, f"<u{1 << (wide & 3)}", n, int(self.gaps[b]))
            tf = np.frombuffer(self.data, f"<u{1 << (wide >> 2)}", n, int(self.counts[b]))
            docs = np.cumsum(gap, dtype=np.int64) + (-1 if first else int(self.last[b - 1]))
            self.open[b] = docs, impacts(tf, self.m[docs])
        return self.open[b]

    def search(self, query: list[tuple[bytes, int]], best: list[tuple[int, int]], k: int = BEST) -> list[tuple[int, int]]:
        """The k best (-score, id) of ``best`` and of this shard."""
        found = [(w, self.find(t)) for t, w in query]
        lists = [(w, int(self.first[t]), int(self.ends[t])) for w, t in found if t is not None and w > 0]
        if not lists:
            return best
        lists.sort(key=lambda x: -x[0] * int(self.most[x[1] : x[2]].max()))
        ends = np.unique(np.concatenate([self.last[b:e] for _, b, e in lists]))
        # The shallow moves: the block of each list at each stretch, and what it can add there.
        cover = np.empty((len(lists), len(ends)), np.int32)
        add = np.zeros((len(lists), len(ends)), np.int64)
        for row, (w, b, e) in enumerate(lists):
            cover[row] = at = np.searchsorted(self.last[b:e], ends)
            inside = at < e - b
            add[row, inside] = w * self.most[b + at[inside]]
        bound = add.sum(axis=0)
        rest = np.ones(len(ends), bool)
        if len(best) < k:  # a threshold to begin with: where the lists of most impact have their first documents
            seeds: set[int] = set()
            for _, b, _ in lists:
                seeds.update(np.searchsorted(ends, self.block(b, True)[0]).tolist())
                if len(seeds) >= FIRST:
                    break
            part = np.array(sorted(seeds))
            best = self._deep(lists, ends, cover, add, part, 1, best, k)
            rest[part] = False
        order = np.flatnonzero(rest)
        order = order[np.argsort(-bound[order], kind="stable")]
        at, step = 0, FIRST
        while at < len(order):
            least = -best[-1][0] if len(best) == k else 1
            part = order[at : at + step]
            part = part[bound[part] >= least]
            if not len(part):
                break
            best = self._deep(lists, ends, cover, add, np.sort(part), least, best, k)
            at, step = at + step, 2 * step
        return best

    def _deep(self, lists: list[tuple[int, int, int]], ends: np.ndarray, cover: np.ndarray, add: np.ndarray, part: np.ndarray, least: int, best: list[tuple[int, int]], k: int) -> list[tuple[int, int]]:
        """Adds up the documents of the stretches ``part``, leaving those that can't reach ``least``."""
        left, sums, touched = add[:, part].sum(axis=0), self.sums, []
        most = np.zeros(len(part), np.int64)
        for row, (w, b, e) in enumerate(lists):
            live = most + left >= least
            blocks = np.unique(cover[row, part[live & (add[row, part] > 0)]])
            if len(blocks):
                opened = [self.block(b + x, x == 0) for x in blocks.tolist()]
                docs = np.concatenate([d for d, _ in opened])
                stretch = np.searchsorted(ends, docs)
                where = np.minimum(np.searchsorted(part, stretch), len(part) - 1)
                some = (part[where] == stretch) & live[where]
                docs, where = docs[some], where[some]
                sums[docs] += w * np.concatenate([i for _, i in opened])[some]
                np.maximum.at(most, where, sums[docs])
                touched.append(docs)
            left -= add[row, part]
        docs = np.unique(np.concatenate(touched)) if touched else np.zeros(0, np.int64)
        own = sums[docs]
        sums[docs] = 0
        # A stretch that was left has sums without all its lists; they are below the threshold, and so is what they could become.
        some = np.flatnonzero(own >= least)
        if len(some) > k:
            some = some[own[some] >= np.partition(own[some], len(some) - k)[len(some) - k]]
        return sorted([*best, *zip((-own[some]).tolist(), self.ids[docs[some]].tolist(), strict=True)])[:k]


def _gathered(documents: int, terms: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("search")
        number, shard, size = TaskContext.get().partitionId() << 32, Shard(), 0

        def out() -> pa.RecordBatch:
            body = shard.packed(documents, terms)
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([len(shard.ids)], pa.int64()), pa.array([body], pa.binary())], ["shard", "documents", "body"])

        for batch in batches:
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                text = text.as_py()
                shard.add(key, text)
                size += len(text)
                if size >= most and shard.ids:
                    yield out()
                    number, shard, size = number + 1, Shard(), 0
                    common.give_back()
        if shard.ids:
            yield out()
        del shard
        common.give_back()

    return run


def index(docs: DataFrame, uri: str, documents: int, terms: int, key: str = "doc_id", text: str = "text", most: int = SHARD_CHARS) -> DataFrame:
    """Stores (shard, documents, body) of ``docs`` under ``uri``."""
    slim = docs.select(F.col(key).cast("long").alias("key"), common.text_of(text).alias("text"))
    return common.stored(slim.mapInArrow(_gathered(documents, terms, most), "shard long, documents long, body binary"), uri)


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(i, t) for i, text in zip(batch.column("item_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True) for t in set(terms_of(text.as_py()))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], batch.schema.field("item_id").type), pa.array([r[1] for r in rows], pa.binary())], ["item_id", "term"])


def _read(uri: str) -> pa.Table:
    """A table that was stored in the shared folder, read by a task."""
    fs, path = common.open_fs(uri)
    return pq.read_table(path, filesystem=fs, partitioning=None)


def _document_counts(uri: str, parts: int):
    """(term, df): of each query term the documents of a shard that hold it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for body in batch.column("body"):
                lists = Lists(body.as_py())
                common.give_back()
                for part in range(parts):
                    terms = set(_read(f"{uri}/block={part}").column("term").to_pylist())
                    found = [(t, int(lists.df[at])) for t in terms if (at := lists.find(t)) is not None]
                    yield pa.RecordBatch.from_arrays([pa.array([part] * len(found), pa.int32()), pa.array([f[0] for f in found], pa.binary()), pa.array([f[1] for f in found], pa.int64())], ["block", "term", "df"])

    return run


def _searched(uri: str, parts: int, k: int, kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common.claim("search")
        best: dict = defaultdict(list)
        kept: dict[int, dict] = {}

        def items(part: int) -> dict:
            if part not in kept:
                kept.clear()
                own = defaultdict(list)
                for item, term, w in zip(*(c.to_pylist() for c in _read(f"{uri}/block={part}").select(["item_id", "term", "w"]).columns), strict=True):
                    own[item].append((term, w))
                kept[part] = own
            return kept[part]

        for batch in batches:
            for body in batch.column("body"):
                lists = Lists(body.as_py())
                for part in range(parts):
                    for item, query in items(part).items():
                        best[item] = lists.search(query, best[item], k)
                del lists
                common.give_back()
        rows = [(item, None if doc == _NONE else doc, -score) for item, own in best.items() for score, doc in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())], ["item_id", "doc_id", "score"])

    return run


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", k: int = BEST) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of each item."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, home = docs.sparkSession, common.shared_dir(docs.sparkSession, "search")
    kind = items.schema[item].dataType
    asked = items.select(F.col(item).alias("item_id"), common.text_of(item_text).alias("text"))
    parts = common.parts(asked.count(), ITEMS)
    block = F.pmod(F.hash("item_id"), F.lit(parts)).alias("block")
    terms = asked.mapInArrow(_item_terms, f"item_id {kind.simpleString()}, term binary").distinct().select("item_id", "term", block)
    terms = _by_block(terms, f"{home}/terms", parts)
    n, length = totals(docs, text)
    shards = index(docs, f"{home}/index", n, length, key, text)
    df = shards.select("body").mapInArrow(_document_counts(f"{home}/terms", parts), "block int, term binary, df long").groupBy("block", "term").agg(F.sum("df").alias("df"))
    w = F.floor(1000 * F.log((2.0 * n + 2) / (2.0 * F.col("df") + 1))).cast("long").alias("w")
    _by_block(terms.join(df, ["block", "term"]).select("item_id", "term", w, "block"), f"{home}/weights", parts)
    found = shards.select("body").mapInArrow(_searched(f"{home}/weights", parts, k, to_arrow_type(kind)), f"item_id {kind.simpleString()}, doc_id long, score long")
    order = Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _by_block(rows: DataFrame, uri: str, parts: int) -> DataFrame:
    """Stores rows in one folder for each block of items; a block without rows has an empty folder of its own."""
    rows.repartition(parts, "block").write.mode("overwrite").partitionBy("block").parquet(uri)
    fs, path = common.open_fs(uri)
    for part in range(parts):
        fs.create_dir(f"{path}/block={part}", recursive=True)
        if not any(f.base_name.endswith(".parquet") for f in fs.get_file_info(_inside(f"{path}/block={part}"))):
            pq.write_table(pa.table({"item_id": pa.array([], pa.int64()), "term": pa.array([], pa.binary()), "w": pa.array([], pa.int64())}), f"{path}/block={part}/none.parquet", filesystem=fs)
    return rows.sparkSession.read.schema(rows.schema).parquet(uri)


def _inside(path: str):
    from pyarrow.fs import FileSelector

    return FileSelector(path, allow_not_found=True)


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table, ranked for each item of the benchmark."""
    out = search(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.withColumn("rank", F.col("rank").cast("int"))


_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

OP11_SQL = rf"""
WITH own AS (SELECT row_number() OVER () AS place, doc_id, {_TERMS} AS terms FROM documents),
docs AS (SELECT place, doc_id, terms, len(terms)::BIGINT AS n FROM own WHERE len(terms) > 0),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM docs),
found AS (SELECT place, term, count(*)::BIGINT AS tf FROM (SELECT place, unnest(terms) AS term FROM docs) GROUP BY ALL),
weights AS (
    SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w
    FROM found, total GROUP BY term, big_n
),
asked AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
scored AS (
    SELECT item_id, place, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * big_n) // big_l))))::BIGINT AS score
    FROM asked JOIN weights USING (term) JOIN found USING (term) JOIN docs USING (place), total
    GROUP BY item_id, place, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY rank <= 10
"""
