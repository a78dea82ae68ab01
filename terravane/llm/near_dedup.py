"""Near-duplicate classes by improved consistent weighted sampling (operator 5).

A document is the set of its shingles, five words each, weighted by TF-IDF over all documents; the inverse document frequency
is scaled to lie between 1 and 2, so that near copies are alike whether there are two of them or thousands. Documents are linked if the
weighted Jaccard similarity of these sets is 0.8 or more; a class is a connected component of links. Steps:

* Shingle frequencies are counted over all documents, batch by batch (see ``batches``).
* The weight of shingles that no other document has bounds a document's similarity with any other. Where these alone are more
  than a fifth of the whole weight the document has no links, which is certain, and takes no further part.
* Every other document draws ``BANDS * ROWS`` consistent weighted samples; equal samples of a band make documents candidates. Two
  documents at similarity s share a band with probability 1 - (1 - s**3)**10, 0.9992 at 0.8.
* Documents with the same words are one node from here on, so copies cost no comparisons.
* Within a bucket of a band, nodes are first compared with one leader. That is a number of comparisons in proportion to the nodes, and
  leaves most buckets, with the links of all bands together, in one component.
* In a bucket that is left with several components, the nodes outside its largest one are compared with the whole bucket, so every pair
  of candidates has been compared or is known to be in one class. The nodes are cut into chunks of bounded size, and a task
  compares two chunks; pairs are made inside the task only, and what leaves it are links between components.
* A comparison computes the weighted Jaccard similarity from the full weights.

Shingles are told apart by a hash of 40 bits and the number of their bucket, which grows with the data: about two in a
million share another's count, at every size.

Defined cases: null text is empty; an empty text is alone in its class; a text of fewer than five words is one
shingle; texts are read whole; null ids come last: a class of such rows alone has the id null; repeated rows are in one
class; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import batches, common

SHINGLE = 5
SIMILARITY = 0.8
BANDS, ROWS = 10, 3
BUCKET_BYTES = 16 << 20
BLOCK_BYTES = 16 << 20
#: Shingles of a chunk of nodes, about.
CHUNK = 1 << 16
#: Random variates of the sampling come from this many places of a fixed table.
VARIATES = 1 << 16
_LOW = 40
_P = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """Hashes of words, remembered."""

    def __missing__(self, word: str) -> int:
        value = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        if len(word) <= 64:
            if len(self) > 200_000:
                self.clear()
            self[word] = value
        return value


_WORDS = WordHashes()
common.KEPT["shingles"] = _WORDS.clear


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


class Shingles:
    """Shingles of the texts of a batch, each once for each document, in the order of the documents.

    ``keys``: bucket and hash; ``tf``; ``of``: place among ``distinct``, the batch's keys in ascending order; ``starts`` and
    ``sizes`` of documents; ``df``: documents of the batch that have each distinct key; ``digests`` of the word sequences.
    """

    def __init__(self, texts: list[str], buckets: int, digests: bool = False):
        hashes, words, self.digests = [], np.zeros(len(texts), np.int64), []
        for i, text in enumerate(texts):
            own = text.lower().split()
            if digests:
                self.digests.append(xxhash.xxh3_128_digest(" ".join(own).encode("utf-8", "surrogatepass")))
            if own:
                h = np.fromiter(map(_WORDS.__getitem__, own), np.uint64, len(own))
                if len(h) < SHINGLE:
                    h = np.concatenate([h, np.zeros(SHINGLE - len(h), np.uint64)])
                hashes.append(h)
                words[i] = len(h)
        flat = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        n = max(len(flat) - SHINGLE + 1, 0)
        keys = np.zeros(n, np.uint64)
        with np.errstate(over="ignore"):
            for j in range(SHINGLE):
                keys *= _P
                keys += flat[j : j + n]
        doc = np.repeat(np.arange(len(texts), dtype=np.int32), words)[:n]
        inside = np.arange(n) + SHINGLE <= np.repeat(np.cumsum(words), words)[:n]
        keys, doc = mixed(keys[inside]), doc[inside]
        keys = ((keys >> np.uint64(_LOW)) % np.uint64(buckets)) << np.uint64(_LOW) | keys & np.uint64((1 << _LOW) - 1)

        order = np.argsort(keys, kind="stable")
        by_key, by_doc = keys[order], doc[order]
        new = np.ones(len(keys), bool)
        new[1:] = by_key[1:] != by_key[:-1]
        first = new.copy()
        first[1:] |= by_doc[1:] != by_doc[:-1]
        at = np.flatnonzero(first)
        self.distinct = by_key[new]
        of_first = (np.cumsum(new) - 1)[at]
        self.df = np.bincount(of_first, minlength=len(self.distinct)).astype(np.int64)
        tf, of, keep = np.zeros(len(keys), np.int32), np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        place = order[at]
        tf[place], of[place], keep[place] = np.diff(np.append(at, len(keys))), of_first, True
        self.keys, self.tf, self.of = keys[keep], tf[keep], of[keep]
        self.sizes = np.bincount(doc[keep], minlength=len(texts))
        self.starts = np.cumsum(self.sizes) - self.sizes


def _planes(x: np.ndarray, kind: str) -> np.ndarray:
    """Bytes of equal significance together, which compresses well."""
    return np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).ravel()


def _whole(planes: np.ndarray, kind: str) -> np.ndarray:
    return np.ascontiguousarray(planes.reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def pack_counts(low: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending 40-bit hashes with counts."""
    head = np.diff(low >> np.uint64(24), prepend=np.uint64(0))
    tail = np.ascontiguousarray(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :3])
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([_planes(head, "<u2"), _planes(counts, "<u4"), tail.ravel()]).tobytes())


def unpack_counts(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8)
    n = len(raw) // 9
    low = np.zeros((n, 8), np.uint8)
    low[:, :3] = raw[6 * n :].reshape(n, 3)
    head = np.cumsum(_whole(raw[: 2 * n], "<u2").astype(np.uint64), dtype=np.uint64)
    return low.view("<u8").ravel() | head << np.uint64(24), _whole(raw[2 * n : 6 * n], "<u4").astype(np.int64)


def _asks(buckets: int):
    def run(batch: int, names: list, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        own = Shingles(texts, buckets)
        ends = np.searchsorted(own.distinct, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(_LOW))
        for b in sorted({0, *np.flatnonzero(np.diff(ends)).tolist()}):  # each batch asks something, so each has a reply
            at = slice(ends[b], ends[b + 1])
            yield b, pack_counts(own.distinct[at] & np.uint64((1 << _LOW) - 1), own.df[at])

    return run


def _answers(bucket: int, names: list[int], bodies: list[bytes]) -> list[bytes]:
    both = [unpack_counts(b) for b in bodies]
    low = np.concatenate([b[0] for b in both])
    distinct, at = np.unique(low, return_inverse=True)
    df = np.bincount(at, np.concatenate([b[1] for b in both]), len(distinct))[at]
    out, done = [], 0
    for own, _ in both:
        out.append(zstandard.ZstdCompressor(level=1).compress(_planes(df[done : done + len(own)], "<u4").tobytes()))
        done += len(own)
    return out


def weigh(own: Shingles, replies: dict[int, bytes], documents: int) -> tuple[np.ndarray, np.ndarray]:
    """TF-IDF weights of a batch's shingles, and the frequencies over all documents they come from."""
    of_each = [_whole(np.frombuffer(zstandard.ZstdDecompressor().decompress(replies[b]), np.uint8), "<u4") for b in sorted(replies)]
    df = np.concatenate(of_each) if of_each else np.zeros(0)
    return own.tf * (1 + np.log((documents + 1) / (df + 1)) / np.log(documents + 1))[own.of], df[own.of]


class Sampler:
    """Improved consistent weighted sampling; the variates of an element and a sample are read from a table at a hash of both."""

    TABLES = 32

    def __init__(self, samples: int, seed: int = 5):
        draw = np.random.default_rng(seed)
        self.r, self.beta = draw.gamma(2, 1, VARIATES), draw.random(VARIATES)
        self.log_c = np.log(draw.gamma(2, 1, VARIATES))
        self.multipliers = draw.integers(1, 2**63, samples, np.uint64) * np.uint64(2) + np.uint64(1)

    def _value(self, log_w, at) -> np.ndarray:
        """ln a = ln c - ln y - r with ln y = r (t - beta), in the high half of an integer of the same order."""
        r, beta = self.r[at], self.beta[at]
        a = (self.log_c[at] - r * (np.floor(log_w / r + beta) - beta) - r).astype(np.float32)
        bits = a.view(np.uint32)
        return np.where(bits >> np.uint32(31), ~bits, bits | np.uint32(1 << 31)).astype(np.uint64) << np.uint64(32)

    def sample(self, ids: np.ndarray, weights: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """(documents, samples): equal entries are equal samples. Documents without elements get zeros.

        An entry is the least ln a with bits of the element's id; ln a is the same for equal (element, t) only.
        """
        out = np.zeros((len(sizes), len(self.multipliers)), np.uint64)
        full = np.flatnonzero(sizes)
        if not len(full):
            return out
        levels, level, often = np.unique(weights, return_inverse=True, return_counts=True)
        common_ones = np.argsort(-often)[: self.TABLES]
        common_ones = common_ones[often[common_ones] * len(self.multipliers) > VARIATES]
        table = np.concatenate([np.zeros(0, np.uint64), *(self._value(np.log(levels[k]), slice(None)) for k in common_ones)])
        base = np.full(len(levels), -1, np.int64)
        base[common_ones] = np.arange(len(common_ones)) * VARIATES
        base, log_w = base[level], np.log(levels)[level]
        ends = starts[full] + sizes[full]
        cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + (1 << 17), 1 << 17)))
        for i, j in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):  # pieces that fit a cache
            at = slice(starts[full[i]], ends[j - 1])
            e, b = ids[at], base[at]
            name, rest = e & np.uint64(0xFFFFFFFF), np.flatnonzero(b < 0)
            b = np.maximum(b, 0)
            segments = starts[full[i:j]] - at.start
            for k, m in enumerate(self.multipliers):
                with np.errstate(over="ignore"):
                    place = ((e * m) >> np.uint64(48)).astype(np.int64)
                value = table[place + b] if len(table) else np.zeros(len(e), np.uint64)
                if len(rest):
                    value[rest] = self._value(log_w[at][rest], place[rest])
                out[full[i:j], k] = np.minimum.reduceat(value | name, segments)
        return out


def bands_of(samples: np.ndarray) -> np.ndarray:
    """(documents, BANDS) keys; the band is part of a key."""
    out = np.zeros((len(samples), BANDS), np.uint64)
    for b in range(BANDS):
        with np.errstate(over="ignore"):
            key = np.full(len(samples), b + 1, np.uint64)
            for r in range(ROWS):
                key = mixed(key * _P + samples[:, b * ROWS + r])
        out[:, b] = key
    return out.view(np.int64)


def _node(batch: int, n: int) -> np.ndarray:
    """Row numbers that are unique over all batches."""
    return ((batch >> 32) << 43 | (batch & 0x1FFFFF) << 22) + np.arange(n, dtype=np.int64)


def _lists(of: np.ndarray, width: int) -> pa.Array:
    """Rows of ``of`` for the documents that have one (``width`` true), nulls for the others."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(width * of.shape[1])]), pa.int32()), pa.array(of.ravel()), mask=pa.array(~width))


_SIGNED = "node long, key long, digest binary, total double, shared double, shingles long, bands array<long>, ids binary, weights binary"


def _sign(buckets: int, documents: int):
    """Every document with its weights' sums; those that can have links with their samples' bands and their weights, by shingle."""

    def run(batch: int, names: list, texts: list[str], replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        own = Shingles(texts, buckets, digests=True)
        w, df = weigh(own, replies, documents)
        doc = np.repeat(np.arange(len(texts)), own.sizes)
        total = np.bincount(doc, w, len(texts)).astype(float)
        shared = np.bincount(doc, w * (df > 1), len(texts)).astype(float)
        linked = (own.sizes > 0) & (shared >= SIMILARITY * total * (1 - 1e-6))
        keep = linked[doc]
        ids, w, sizes = mixed(own.keys[keep]), w[keep], own.sizes[linked]
        starts = np.cumsum(sizes) - sizes
        bands = bands_of(Sampler(BANDS * ROWS).sample(ids, w, starts, sizes))
        bodies: list = [None] * len(texts)
        weights: list = [None] * len(texts)
        pack = zstandard.ZstdCompressor(level=1).compress
        for i, a, n in zip(np.flatnonzero(linked).tolist(), starts.tolist(), sizes.tolist(), strict=True):
            order = np.argsort(ids[a : a + n])
            bodies[i] = ids[a : a + n][order].astype("<u8").tobytes()
            weights[i] = pack(_planes(w[a : a + n][order], "<f4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(_node(batch, len(texts))), pa.array(names, pa.int64()), pa.array(own.digests, pa.binary()), pa.array(total), pa.array(shared), pa.array(own.sizes, pa.int64()), _lists(bands, linked), pa.array(bodies, pa.binary()), pa.array(weights, pa.binary())],
            ["node", "key", "digest", "total", "shared", "shingles", "bands", "ids", "weights"],
        )

    return run


def _opened(ids: bytes, weights: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    w = _whole(np.frombuffer(zstandard.ZstdDecompressor().decompress(weights), np.uint8), "<f4").astype(float)
    return np.frombuffer(ids, "<u8"), w, float(w.sum())


def _similar(one: tuple[np.ndarray, np.ndarray, float], others: list[tuple[np.ndarray, np.ndarray, float]]) -> np.ndarray:
    """Weighted Jaccard similarities of one node with others."""
    e, w, total = one
    ids, weights = np.concatenate([o[0] for o in others]), np.concatenate([o[1] for o in others])
    at = np.minimum(np.searchsorted(e, ids), len(e) - 1)
    sizes = np.array([len(o[0]) for o in others])
    both = np.add.reduceat(np.where(e[at] == ids, np.minimum(w[at], weights), 0.0), np.cumsum(sizes) - sizes)
    return both / (total + np.array([o[2] for o in others]) - both)


def _compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links of a block. Rows are weights (a null, or b null) and pairs (no ids)."""
    a, b, ids, weights = (table.column(c).to_pylist() for c in ("a", "b", "ids", "weights"))
    of: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
    asked: dict[int, list[int]] = {}
    for x, y, i, w in zip(a, b, ids, weights, strict=True):
        if i is None:
            asked.setdefault(x, []).append(y)
        else:
            of[y if x is None else x] = _opened(i, w)
    left, right = [], []
    for x, others in asked.items():
        for k in range(0, len(others), 512):
            part = others[k : k + 512]
            near = np.flatnonzero(_similar(of[x], [of[y] for y in part]) >= SIMILARITY)
            left += [x] * len(near)
            right += [part[i] for i in near.tolist()]
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def _tiles(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Links between components in the tiles of a block. A tile has two sides, or one whose nodes are compared with each other."""
    at: dict[tuple, list[int]] = {}
    for i, t in enumerate(zip(*(table.column(c).to_pylist() for c in ("band", "first", "second", "big")), strict=True)):
        at.setdefault(t, []).append(i)
    node, component, side, total, shared = (table.column(c).to_pylist() for c in ("node", "component", "side", "total", "shared"))
    ids, weights = table.column("ids"), table.column("weights")
    left, right = [], []
    for (_, first, second, big), rows in at.items():
        alone = not big and first == second
        a = [i for i in rows if alone or side[i] == 0]
        b = a if alone else [i for i in rows if side[i] == 1]
        of = {i: _opened(ids[i].as_py(), weights[i].as_py()) for i in {*a, *b}}
        up = {component[i]: component[i] for i in of}

        def root(c: int, up: dict[int, int] = up) -> int:
            while up[c] != c:
                up[c] = up[up[c]]
                c = up[c]
            return c

        for k, x in enumerate(a):
            mine = root(component[x])
            others = [y for y in (b[k + 1 :] if alone else b) if root(component[y]) != mine and min(shared[x], shared[y]) >= SIMILARITY * (1 - 1e-6) * max(total[x], total[y])]
            for y in [others[i] for i in np.flatnonzero(_similar(of[x], [of[y] for y in others]) >= SIMILARITY).tolist()] if others else []:
                if root(component[y]) != root(component[x]):
                    up[root(component[y])] = root(component[x])
                    left.append(node[x])
                    right.append(node[y])
    return pa.table({"a": pa.array(left, pa.int64()), "b": pa.array(right, pa.int64())})


def linked_pairs(pairs: DataFrame, features: DataFrame, blocks: int) -> DataFrame:
    """Those of ``pairs`` (a, b) that are links, from ``features`` (node, ids, weights).

    Pairs are dealt by blocks of members b; the weights of a leader a go to each block that needs them once.
    """
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("b"), F.lit(blocks)))
    body = features.select("node", "ids", "weights")
    leaders = dealt.select("block", "a").distinct().join(body, F.col("a") == F.col("node")).select("block", "a", F.lit(None).cast("long").alias("b"), "ids", "weights")
    members = dealt.select("block", "b").distinct().join(body, F.col("b") == F.col("node")).select("block", F.lit(None).cast("long").alias("a"), "b", "ids", "weights")
    asked = dealt.select("block", "a", "b", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("weights"))
    return leaders.unionByName(members).unionByName(asked).groupBy("block").applyInArrow(_compare, "a long, b long")


def linked_in_open(rows: DataFrame, sizes: DataFrame, features: DataFrame, blocks: int) -> DataFrame:
    """Links between components of open buckets: ``rows`` (band, node, component, total, shared) with what ``sizes`` has of each band.

    ``sizes``: band, largest (its largest component), n_rest and n_big, the chunks outside and inside that one.
    """
    own = rows.join(sizes, "band")
    big = F.col("component") == F.col("largest")
    chunk = F.when(big, F.pmod(F.xxhash64("node"), F.col("n_big"))).otherwise(F.pmod(F.xxhash64("node"), F.col("n_rest")))
    numbers = lambda n: F.when(F.col(n) > 0, F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).otherwise(F.array().cast("array<long>"))
    tile = lambda a, b, c, side: F.struct(a.cast("long").alias("first"), b.cast("long").alias("second"), F.lit(c).alias("big"), side.cast("int").alias("side"))
    mine = F.col("chunk")
    of_rest = F.concat(
        F.transform(numbers("n_rest"), lambda j: tile(F.least(mine, j), F.greatest(mine, j), False, mine > j)),
        F.transform(numbers("n_big"), lambda k: tile(mine, k, True, F.lit(0))),
    )
    of_big = F.transform(numbers("n_rest"), lambda i: tile(i, mine, True, F.lit(1)))
    placed = own.withColumn("chunk", chunk).withColumn("tile", F.explode(F.when(big, of_big).otherwise(of_rest))).select("band", "node", "component", "total", "shared", "tile.*")
    placed = placed.withColumn("block", F.pmod(F.xxhash64("band", "first", "second", "big"), F.lit(blocks)))
    return placed.join(features.select("node", "ids", "weights"), "node").groupBy("block").applyInArrow(_tiles, "a long, b long")


def components(links: DataFrame, uri: str) -> DataFrame:
    """(node, component) of the nodes that have links (a, b); a component is named by its least node.

    Nodes take the least name among their neighbours and then their name's name, until nothing changes. Every step is stored.
    """
    spark = links.sparkSession
    edges = common.stored(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct(), f"{uri}/edges")
    names = common.stored(edges.groupBy("node").agg(F.least("node", F.min("other")).alias("component")), f"{uri}/0")
    step = 0
    while True:
        step += 1
        near = edges.join(names.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("component").alias("c"))
        closer = common.stored(names.join(near, "node").select("node", F.least("component", "c").alias("component"), F.col("component").alias("before")), f"{uri}/{step}a")
        after = closer.select(F.col("node").alias("component"), F.col("component").alias("c"))
        jumped = common.stored(closer.join(after, "component").select("node", F.least("component", "c").alias("component"), "before"), f"{uri}/{step}b")
        if not jumped.where(F.col("component") != F.col("before")).limit(1).count():
            return jumped.select("node", "component")
        names = spark.read.schema(jumped.schema).parquet(f"{uri}/{step}b").drop("before")


def _likely(shared_a: str, total_a: str, shared_b: str, total_b: str):
    """What both can share, of what both hold, is enough for a link."""
    return F.least(shared_a, shared_b) >= F.greatest(total_a, total_b) * (SIMILARITY * (1 - 1e-6))


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for every document: key, class_id (the least key of its class), class_size, kept (one row of each class), shingles, digest."""
    spark = docs.sparkSession
    home = common.shared_dir(spark, "near-dedup")
    rows = batches.batched(docs, f"{home}/batches", key, text)
    documents, size = batches.totals(rows)
    buckets = max(64, common.parts(size, BUCKET_BYTES, 8192))
    batches.deliver(batches.answer(batches.ask("shingles", rows, _asks(buckets)), _answers), f"{home}/replies")
    signed = common.stored(batches.finish("shingles", rows, f"{home}/replies", _sign(buckets, documents), _SIGNED), f"{home}/signed")
    can_link = F.col("bands").isNotNull()

    best = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "node", "total", "shared", "shingles", "bands")).alias("m")
    alike = signed.where(can_link).groupBy("digest").agg(best, F.count(F.lit(1)).alias("copies"))
    nodes = common.stored(alike.select("digest", "copies", *[F.col(f"m.{c}").alias(c) for c in ("key", "node", "total", "shared", "shingles", "bands")]), f"{home}/nodes")
    features = signed.where(can_link).select("node", "ids", "weights")
    weight = features.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    blocks = max(common.parts(weight, BLOCK_BYTES), min(64, spark.sparkContext.defaultParallelism))

    spread = nodes.select("node", "total", "shared", "shingles", F.explode("bands").alias("band"))
    buckets_ = spread.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "total", "shared")).alias("first")).where(F.col("n") > 1)
    led = common.stored(buckets_.select("band", F.col("first.node").alias("leader"), F.col("first.total").alias("leader_total"), F.col("first.shared").alias("leader_shared")), f"{home}/leaders")
    entries = common.stored(spread.join(led, "band"), f"{home}/entries")
    pairs = entries.where((F.col("node") != F.col("leader")) & _likely("shared", "total", "leader_shared", "leader_total")).select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    links = common.stored(linked_pairs(common.stored(pairs, f"{home}/pairs"), features, blocks), f"{home}/links")

    named = components(links, f"{home}/first")
    now = entries.join(named, "node", "left").select("band", "node", "total", "shared", "shingles", F.coalesce("component", "node").alias("component"))
    now = common.stored(now, f"{home}/now")
    by_component = now.groupBy("band", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("shingles").alias("s"))
    open_ = by_component.groupBy("band").agg(F.count(F.lit(1)).alias("components"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.max(F.struct("n", "component", "s")).alias("m")).where((F.col("components") > 1) & (F.col("n") > 2))
    chunks = lambda x: F.ceil(x / CHUNK)
    open_ = common.stored(open_.select("band", F.col("m.component").alias("largest"), chunks(F.col("s") - F.col("m.s")).alias("n_rest"), chunks(F.col("m.s")).alias("n_big")), f"{home}/open")
    more = linked_in_open(now.select("band", "node", "component", "total", "shared"), open_, features, blocks)
    links = links.unionByName(common.stored(more, f"{home}/more"))
    named = components(links, f"{home}/second")

    of_node = common.stored(nodes.join(named, "node", "left").select("digest", "copies", "key", "node", F.coalesce("component", "node").alias("component")), f"{home}/of-node")
    winner = F.min(F.struct(F.col("key").isNull().alias("none"), "key", "node")).alias("w")
    groups = common.stored(of_node.groupBy("component").agg(winner, F.sum("copies").alias("class_size")), f"{home}/classes")
    of_digest = common.stored(of_node.join(groups, "component").select("digest", F.col("w.key").alias("class_id"), F.col("w.node").alias("winner"), "class_size"), f"{home}/of-digest")
    some = signed.where(can_link).select("node", "key", "shingles", "digest").join(of_digest, "digest").select("key", "class_id", "class_size", (F.col("node") == F.col("winner")).alias("kept"), "shingles", "digest")
    none = signed.where(~can_link).select("key", F.col("key").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "shingles", "digest")
    return some.unionByName(none)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of all documents of the table."""
    out = classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select(F.col("key").alias("doc_id"), "class_id", "class_size", "kept", "shingles")
