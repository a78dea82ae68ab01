"""Toxicity scores from the nearest labelled examples (operator 10).

Fitting takes a sample of at most ``FIT_ROWS`` labelled training rows, those with the smallest hashes of their ids (a bounded sample, so what is
fitted can be held by every task; the driver holds the features' names and frequencies only). All of them are examples; each
also calibrates, with its neighbours among the others. A document's own text is never among its neighbours, neither when it calibrates nor when it is
scored: examples whose text has the same digest are left out of the sums, so a row's own label is no input of its score. Features are words and word beginnings of 4 and 6 letters: all that
any example has, whatever its label and however rare. Texts are read once: the feature counts of all documents are stored, their
document frequencies come from there, and so do the vectors to be scored. One task builds the index of the sample; the others load its
arrays as they stand.

Each example is kept with its whole TF-IDF vector in a block-max inverted index: examples with like vectors stand together in
blocks of ``BLOCK`` and sections of ``SECTION``. Each section has full lists of the features that most of its own examples have, with the largest weight in
each block beside the weights themselves, so texts of one language meet full lists of their language; all else is postings. What postings give to a cosine is added up first, for every example;
with it the sums of the largest weights bound every cosine in a block. For a batch of documents the full lists of the section with the highest bound are multiplied
first; then only those blocks whose bound reaches the k-th best cosine found there. Weights of examples are stored in single
precision; cosines that can be among the k largest are added up in double precision, so the neighbours are exact. They vote with their
cosines as weights; a monotone function, fitted on the examples' own votes, turns the vote into the share of toxic rows.
The number of neighbours is ``NEIGHBOURS``, or where there are few toxic examples a quarter of their number, and 3 at least: more
neighbours than that would always be outvoted by clean ones. The nearest ones are returned as evidence. The vocabulary is that of the examples: features that none of them has are in no
cosine and not in a document's length.

Defined cases: null and empty texts have no features, no neighbours and the share of toxic rows among such texts; texts are
read whole; a null id is in no label row and counts as held out only by its crc (it isn't); rows with equal ids are
scored one by one; labels that are null are ignored, and of several labels of one id the largest holds; without any
label of 1 every score is 0; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import io
import hashlib
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import compress, repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import common

FIT_ROWS = 10_000
NEIGHBOURS = 15
#: So many of the nearest are returned as evidence.
EVIDENCE = 10
#: Working sizes, without effect on results: examples in a block, examples in a section, blocks multiplied at once, lists of a section with a slot for each of its examples, those by which examples are ordered, documents searched at once.
BLOCK = 64
SECTION = 20 * BLOCK
STRIP = 5
FULL_LISTS = 1024
COMPARED = 256
TOGETHER = 128
BEGINNINGS = (4, 6)
_LETTERS = re.compile(r"[^\W\d_]+")
#: Letters of Latin-1 as they are, and a space for all else.
_LATIN = bytes(c if _LETTERS.match(chr(c)) else 32 for c in range(256))


def neighbours(toxic: int, most: int = NEIGHBOURS) -> int:
    """How many examples vote where so many of them are toxic."""
    return max(3, min(most, toxic // 4))


def digest(text: str) -> int:
    """What tells texts apart, in 64 bits."""
    return int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "little", signed=True)


def held_out(key: str = "doc_id") -> Column:
    """Rows whose labels are never learned from."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(False))


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; none reaches over white space, so a text has the words of its chunks."""
    low = text.lower()
    try:
        return low.encode("latin-1").translate(_LATIN).decode("latin-1").split()
    except UnicodeEncodeError:
        return _LETTERS.findall(low)


def features_of(text: str) -> list[str]:
    """Words of a text or a part of it, and their beginnings with a mark in front."""
    out = []
    for word in words_of(text):
        out.append(word)
        out += ["^" + word[:n] for n in BEGINNINGS if n < len(word)]
    return out


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: set[str] = set()
    for batch in batches:
        for text in batch.column("text").to_pylist():
            found.update(f for word in set(words_of(text)) - found for f in features_of(word))
            if len(found) > 400_000:
                yield pa.RecordBatch.from_pydict({"feature": list(found)})
                found.clear()
    yield pa.RecordBatch.from_pydict({"feature": pa.array(list(found), pa.string())})


class Reader:
    """Feature counts of whole texts. A word that is a feature brings its beginnings by number; only those of other words are looked up by name."""

    def __init__(self, names: list[str], beginnings: np.ndarray | None = None):
        self.number = {f: i for i, f in enumerate(names)}
        self.beginnings = np.array([self._beginnings(f) for f in names], np.int32).reshape(-1, len(BEGINNINGS)) if beginnings is None else beginnings

    def _beginnings(self, word: str) -> list[int]:
        return [self.number.get("^" + word[:n], -1) if n < len(word) else -1 for n in BEGINNINGS]

    def counts(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Features of a text, ascending, and how often each occurs."""
        count = Counter(words_of(text))
        if not count or not self.number:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        word = np.fromiter(map(self.number.get, count, repeat(-1)), np.int64, len(count))
        found = np.empty((1 + len(BEGINNINGS), len(count)), np.int64)
        found[0], found[1:] = word, self.beginnings[word].T
        for i, name in compress(enumerate(count), (word < 0).tolist()):
            found[1:, i] = self._beginnings(name)
        found = found.ravel()
        order = np.argsort(found)
        order = order[np.searchsorted(found, 0, sorter=order) :]  # without those that are no features
        found = found[order]
        new = np.flatnonzero(np.concatenate([[len(found) > 0], found[1:] != found[:-1]]))
        times = np.fromiter(count.values(), np.int64, len(count))[order % len(count)]
        return found[new], np.add.reduceat(times, new) if len(new) else times


#: What a worker has read from the shared folder, by URI: the last reader and the last index.
_LOADED: dict[str, object] = {}
common.KEPT["features"] = _LOADED.clear


def _kept(name: str, load: Callable[[str], object], beside: str | None):
    """What ``load`` makes of a file; of all that was loaded before only ``beside`` stays."""
    common.claim("features")
    if name not in _LOADED:
        for old in [x for x in _LOADED if x != beside]:
            del _LOADED[old]
        common.give_back()
        _LOADED[name] = load(name)
        common.give_back()
    return _LOADED[name]


def reader_of(uri: str, both: bool = False) -> Reader:
    """The reader of a model; with ``both`` its index stays loaded."""

    def load(name: str) -> Reader:
        beginnings = np.frombuffer(common.get_file(f"{uri}/beginnings"), np.int32).reshape(-1, len(BEGINNINGS))
        return Reader(zlib.decompress(common.get_file(name)).decode().split("\n"), beginnings)

    return _kept(f"{uri}/names", load, f"{uri}/index" if both else None)


def index_of(uri: str, both: bool = False) -> Neighbours:
    """The index of a model; with ``both`` its reader stays loaded."""
    return _kept(f"{uri}/index", Neighbours.load, f"{uri}/names" if both else None)


def squeezed(features: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending features with counts; bytes of equal significance together, compressed."""
    both = np.concatenate([np.diff(features, prepend=0), counts]).astype("<u4")
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(both.view(np.uint8).reshape(-1, 4).T).tobytes())


def unsqueezed(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(4, -1)
    both = np.ascontiguousarray(planes.T).view("<u4").ravel().astype(np.int64)
    return np.cumsum(both[: len(both) // 2]), both[len(both) // 2 :]


def packed(text: str, features: np.ndarray, counts: np.ndarray) -> bytes:
    """The digest of a text and its feature counts."""
    return digest(text).to_bytes(8, "little", signed=True) + squeezed(features, counts)


def unpacked(body: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    return *unsqueezed(body[8:]), int.from_bytes(body[:8], "little", signed=True)


def _read(uri: str) -> Callable[[Column], Column]:
    """The feature counts of each text."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            reader, out = reader_of(uri), []
            for at in range(0, len(batch), TOGETHER):
                out += [packed(t, *reader.counts(t)) for t in batch.slice(at, TOGETHER).to_pylist()]
            yield pa.array(out, pa.binary())

    return F.arrow_udf(run, "binary")


def _frequencies(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(size + 1, np.int64)
        for batch in batches:
            for body in batch.column("body"):
                df[unpacked(body.as_py())[0]] += 1
            df[-1] += batch.num_rows
        some = np.flatnonzero(df)
        for k in range(0, len(some), 50_000):
            part = some[k : k + 50_000]
            yield pa.RecordBatch.from_pydict({"feature": pa.array(part, pa.int32()), "n": pa.array(df[part])})

    return run


def _vectors(uri: str):
    """Puts the vectors of a part of the examples into one file and gives its number; the driver does not hold them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, part, made = reader_of(uri), TaskContext.get().partitionId(), []
        for batch in batches:
            for i, y, text in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "toxic", "text")), strict=True):
                f, n = reader.counts(text)
                made.append((i, y, f.astype(np.int32), n.astype(np.int32), digest(text)))
        if made:
            common.put_file(f"{uri}/part-{part}", _bytes(ids=np.array([m[0] for m in made], np.int64), labels=np.array([m[1] for m in made], np.int8), ends=np.cumsum([0, *(len(m[2]) for m in made)]), feature=np.concatenate([m[2] for m in made]), count=np.concatenate([m[3] for m in made]), digests=np.array([m[4] for m in made], np.int64)))
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32())})

    return run


def _bytes(**arrays: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def like_first(rows: np.ndarray) -> np.ndarray:
    """An order of vectors in which like ones stand together: halved again and again along the direction in which they differ most."""
    out, todo = [], [np.arange(len(rows))]
    while todo:
        at = todo.pop()
        if len(at) <= BLOCK:
            out.append(at)
            continue
        own = rows[at] - rows[at].mean(axis=0)
        along = np.cos(np.arange(own.shape[1], dtype=np.float32))
        for _ in range(6):
            along = own.T @ (own @ along)
            along /= max(float(np.sqrt(along @ along)), 1e-30)
        order = np.argsort(own @ along, kind="stable")
        cut = -(-len(at) // 2 // BLOCK) * BLOCK
        todo += [at[order[cut:]], at[order[:cut]]]
    return np.concatenate([np.zeros(0, np.int64), *out])


def vectors_of(uri: str, part: int) -> list[tuple[int, int, np.ndarray, np.ndarray, int]]:
    """id, label, features, counts and digest of a part of the examples."""
    with np.load(io.BytesIO(common.get_file(f"{uri}/part-{part}"))) as f:
        ids, labels, ends, feature, count, digests = (f[x] for x in ("ids", "labels", "ends", "feature", "count", "digests"))
    return [(i, y, feature[b:e], count[b:e], d) for i, y, b, e, d in zip(ids.tolist(), labels.tolist(), ends[:-1].tolist(), ends[1:].tolist(), digests.tolist(), strict=True)]


#: The arrays of an index that are stored beside frequencies and ids.
ARRAYS = ("labels", "digests", "column", "full", "full_most", "ends", "postings")
#: An example and its weight side by side, so that both are fetched at once.
POSTING = np.dtype([("example", np.int32), ("weight", np.float32)])


_NONE = np.zeros(0, np.int64)


@dataclass
class Neighbours:
    """Whole vectors of examples in a block-max inverted index."""

    idf: np.ndarray
    ids: list[int] = field(default_factory=list)
    labels: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int8))
    digests: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))

    def weigh(self, features: np.ndarray, counts: np.ndarray) -> np.ndarray:
        w = (1 + np.log(counts)) * self.idf[features]
        return w / np.sqrt((w * w).sum())

    def build(self, rows: list[tuple]) -> Neighbours:
        """rows: id, label, features, counts, and a digest if there is one; none of them without features."""
        none = np.zeros(0, np.int32)
        rows = sorted(rows, key=lambda r: r[0])
        rows = [rows[i] for i in like_first(self._columns(rows, self._often(rows, COMPARED))).tolist()]
        sections = [rows[at : at + SECTION] for at in range(0, len(rows), SECTION)]
        often = [self._often(own, FULL_LISTS) for own in sections]
        self.column = np.full((len(self.idf), len(sections)), -1, np.int16)
        self.full = np.zeros((len(rows), max(map(len, often), default=0)), np.float32)
        for k, (own, features) in enumerate(zip(sections, often, strict=True)):
            self.column[features, k] = np.arange(len(features))
            self.full[k * SECTION : (k + 1) * SECTION, : len(features)] = self._columns(own, features)
        del sections
        self.ids, self.labels = [r[0] for r in rows], np.array([r[1] for r in rows], np.int8)
        self.digests = np.array([r[4] if len(r) > 4 else k for k, r in enumerate(rows)], np.int64)
        size = np.array([len(r[2]) for r in rows], np.int64)
        feature = np.concatenate([none, *(r[2] for r in rows)]).astype(np.int32)
        count = np.concatenate([none, *(r[3] for r in rows)]).astype(np.int32)
        rows.clear()
        return self._lists(size, feature, count)

    def _often(self, rows: list[tuple], most: int) -> np.ndarray:
        """The features that most rows have."""
        df = np.bincount(np.concatenate([np.zeros(0, np.int32), *(r[2] for r in rows)]), minlength=len(self.idf))
        often = np.argsort(-df, kind="stable")[:most]
        return often[df[often] * 200 > len(rows)]

    def _columns(self, rows: list[tuple], features: np.ndarray) -> np.ndarray:
        """The weights of some features."""
        place = np.full(len(self.idf), -1, np.int32)
        place[features] = np.arange(len(features))
        out = np.zeros((len(rows), len(features)), np.float32)
        for row, (_, _, f, c, *_) in zip(out, rows, strict=True):
            some = place[f] >= 0
            row[place[f[some]]] = self.weigh(f, c)[some]
        return out

    @classmethod
    def load(cls, uri: str) -> Neighbours:
        """As ``save`` has stored it; each array is read into its own memory."""
        with common.reading(uri) as f:
            idf, ids, *rest = (pa.ipc.read_tensor(f).to_numpy() for _ in ("idf", "ids", *ARRAYS))
        out = cls(idf, ids.tolist())
        for name, array_of in zip(ARRAYS, rest, strict=True):
            setattr(out, name, array_of)
        return out._placed()

    def save(self, uri: str) -> None:
        with common.writing(uri) as f:
            for x in (self.idf, np.array(self.ids, np.int64), *(getattr(self, name) for name in ARRAYS)):
                pa.ipc.write_tensor(pa.Tensor.from_numpy(np.ascontiguousarray(x)), f)

    def _placed(self) -> Neighbours:
        """Where the examples with a digest are."""
        self.blocks = -(-len(self.ids) // BLOCK)
        digests, starts = np.unique(np.sort(self.digests), return_index=True)
        self.copies = dict(zip(digests.tolist(), np.split(np.argsort(self.digests, kind="stable"), starts[1:]), strict=True)) if self.ids else {}
        return self

    def _lists(self, size: np.ndarray, feature: np.ndarray, count: np.ndarray) -> Neighbours:
        """``full`` lists have a slot for every example and the largest weight of each block; the others are ranges of postings, one after the other."""
        n = len(self.ids)
        example = np.repeat(np.arange(n, dtype=np.int32), size)
        weight = (1 + np.log(count)) * self.idf[feature]
        del count
        weight /= np.sqrt(np.bincount(example, weight * weight, minlength=n))[example]
        rest = np.flatnonzero(self.column[feature, example // SECTION] < 0).astype(np.int32)
        feature = feature[rest]
        rest = rest[np.argsort(feature, kind="stable")]
        postings = np.empty(len(rest), POSTING)
        postings["example"], postings["weight"] = example[rest], weight[rest]
        self.postings = postings.view(np.int64)
        self.ends = np.cumsum(np.bincount(feature, minlength=len(self.idf)))
        self.full_most = np.maximum.reduceat(self.full, np.arange(0, n, BLOCK), axis=0) if n else self.full
        return self._placed()

    def nearest(self, features: np.ndarray, counts: np.ndarray, k: int) -> list[tuple[float, int]]:
        """The k largest cosines over 0 with their examples, ties to the smaller id."""
        return self.nearest_of([(features, counts)], k)[0]

    def nearest_of(self, docs: list[tuple[np.ndarray, np.ndarray]], k: int) -> list[list[tuple[float, int]]]:
        """``nearest`` of each document."""
        return self._nearest(docs, [_NONE] * len(docs), k)

    def nearest_others(self, docs: list[tuple[np.ndarray, np.ndarray, int]], k: int) -> list[list[tuple[float, int]]]:
        """``nearest`` of each document among the examples with other digests than its own."""
        return self._nearest([d[:2] for d in docs], [self.copies.get(d[2], _NONE) for d in docs], k)

    def _nearest(self, docs: list[tuple[np.ndarray, np.ndarray]], without: list[np.ndarray], k: int) -> list[list[tuple[float, int]]]:
        out: list[list[tuple[float, int]]] = []
        for at in range(0, len(docs), TOGETHER):
            part = slice(at, at + TOGETHER)
            out += self._search(docs[part], without[part], k) if self.ids else [[] for _ in docs[part]]
        return out

    def _search(self, docs: list[tuple[np.ndarray, np.ndarray]], without: list[np.ndarray], k: int) -> list[list[tuple[float, int]]]:
        queries = [self.weigh(f, n) if len(f) else np.zeros(0) for f, n in docs]
        rest = np.empty((len(docs), self.blocks * BLOCK))
        for row, (f, _), q, own in zip(rest, docs, queries, without, strict=True):
            row[:] = self._added(f, q)
            row[own] = -9.0  # full lists don't make up for it
        # what postings give is exact for each example; what full lists give is bounded for each block
        most = rest.reshape(len(docs), self.blocks, BLOCK).max(axis=2)
        columns, weights = self.column[np.concatenate([f for f, _ in docs])], np.concatenate(queries)
        doc = np.repeat(np.arange(len(docs)), [len(q) for q in queries])
        wide, bounds = [], np.empty(most.shape, np.float32)
        for b, column in zip(range(0, self.blocks, SECTION // BLOCK), columns.T, strict=True):
            some = np.flatnonzero(column >= 0)
            wide.append(np.zeros((len(docs), self.full.shape[1]), np.float32))
            wide[-1][doc[some], column[some]] = weights[some]
            part = slice(b, b + SECTION // BLOCK)
            bounds[:, part] = most[:, part] + (wide[-1] @ self.full_most[part].T) * np.float32(1 + 1e-4) + np.float32(1e-4)  # whatever single precision may lose
        sums, least = rest.astype(np.float32), np.zeros(len(docs), np.float32)
        best = bounds.argmax(axis=1) // (SECTION // BLOCK)
        for s, own in enumerate(wide):  # the section with the highest bound says what the k-th largest cosine is at least
            part, rows = slice(s * SECTION, min((s + 1) * SECTION, len(self.ids))), np.flatnonzero(best == s)
            found = sums[rows, part] + own[rows] @ self.full[part].T
            sums[rows, part] = found
            bounds[rows, s * SECTION // BLOCK : (s + 1) * SECTION // BLOCK] = -1
            if k <= found.shape[1]:
                least[rows] = np.maximum(np.partition(found, found.shape[1] - k, axis=1)[:, found.shape[1] - k] - 2e-4, 0)
        chosen = bounds > least[:, None]
        for b in range(0, self.blocks, STRIP):
            part, rows = slice(b * BLOCK, min((b + STRIP) * BLOCK, len(self.ids))), np.flatnonzero(chosen[:, b : b + STRIP].any(axis=1))
            if len(rows):
                sums[rows, part] += wide[b * BLOCK // SECTION][rows] @ self.full[part].T
        return [self._best(*x, k) for x in zip(docs, queries, sums[:, : len(self.ids)], rest, least, strict=True)]

    def _added(self, features: np.ndarray, q: np.ndarray) -> np.ndarray:
        """What the features give to the cosine of each example by their postings."""
        ends = self.ends[features]
        length = ends - np.where(features > 0, self.ends[features - 1], 0)
        before = np.cumsum(length)
        postings = self.postings.take(np.repeat(ends - before, length) + np.arange(before[-1] if len(before) else 0), mode="clip").view(POSTING)
        return np.bincount(postings["example"], np.repeat(q, length) * postings["weight"], minlength=self.blocks * BLOCK)

    def _best(self, doc: tuple[np.ndarray, np.ndarray], q: np.ndarray, sums: np.ndarray, rest: np.ndarray, least: float, k: int) -> list[tuple[float, int]]:
        near = np.flatnonzero((sums > 0) & (sums >= least))  # a sum is over 0 where any feature is shared, as no weight is under 0
        if len(near) > k:
            own = sums[near]
            near = near[own >= np.partition(own, len(own) - k)[len(own) - k] - 1e-4]
        cosines = rest[near]
        for s in set((near // SECTION).tolist()):
            own, column = near // SECTION == s, self.column[doc[0], s]
            cosines[own] += self.full[near[own, None], column[column >= 0]] @ q[column >= 0]
        best = [(round(c, 12), i) for c, i in zip(cosines.tolist(), near.tolist(), strict=True)]
        best.sort(key=lambda x: (-x[0], self.ids[x[1]], x[1]))
        return best[:k]

    def vote(self, near: list[tuple[float, int]]) -> float:
        """Share of label 1 among the neighbours, by cosine; a little weight speaks for label 0, so far neighbours count for less."""
        return sum(s for s, i in near if self.labels[i]) / (sum(s for s, _ in near) + 0.05) if near else 0.0


def monotone(votes: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least-squares monotone fit of labels on votes: the mean votes of its steps, and its values there."""
    steps: list[list[float]] = []  # sum of labels, count, sum of votes
    for v in np.unique(votes).tolist():
        own = labels[votes == v]
        steps.append([float(own.sum()), float(len(own)), v * len(own)])
        while len(steps) > 1 and steps[-2][0] * steps[-1][1] >= steps[-1][0] * steps[-2][1]:
            for k, x in enumerate(steps.pop()):
                steps[-1][k] += x
    return np.array([s[2] / s[1] for s in steps]), np.array([(s[0] + 0.01) / (s[1] + 0.02) for s in steps])


@dataclass
class Model:
    """Names and index lie under ``uri``; without one every score is 0."""

    uri: str | None
    at: np.ndarray
    shares: np.ndarray
    k: int

    def share(self, vote: float) -> float:
        """Between two steps the share rises in a line."""
        return float(np.interp(vote, self.at, self.shares))

    def _voted(self, index: Neighbours, docs: list[tuple[np.ndarray, np.ndarray, int]]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """Score and neighbours of feature counts with digests; called in tasks."""
        for near in index.nearest_others(docs, max(self.k, EVIDENCE)):
            yield self.share(index.vote(near[: self.k])), near

    def score_bodies(self, bodies: list[bytes]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        """Of feature counts as they are stored."""
        if self.uri is None:
            yield from [(0.0, [])] * len(bodies)
            return
        for at in range(0, len(bodies), TOGETHER):
            yield from self._voted(index_of(self.uri), [unpacked(b) for b in bodies[at : at + TOGETHER]])

    def score_texts(self, texts: list[str]) -> Iterator[tuple[float, list[tuple[float, int]]]]:
        if self.uri is None:
            yield from [(0.0, [])] * len(texts)
            return
        reader, index = reader_of(self.uri, both=True), index_of(self.uri, both=True)
        for at in range(0, len(texts), TOGETHER):
            yield from self._voted(index, [(*reader.counts(t), digest(t)) for t in texts[at : at + TOGETHER]])


def _built(uri: str, parts: list[int]):
    """Builds the index of all examples and stores it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _LOADED.clear()
        for batch in batches:
            with np.load(io.BytesIO(common.get_file(f"{uri}/idf"))) as f:
                index = Neighbours(f["idf"])
            index.build([row for part in parts for row in vectors_of(uri, part) if len(row[2])]).save(f"{uri}/index")
            yield batch
            del index
            common.give_back()

    return run


def _votes(uri: str, parts: list[int], k: int):
    """Label and vote of each example, by its neighbours of other texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = index_of(uri)
        for batch in batches:
            for part in batch.column("id").to_pylist():
                rows = vectors_of(uri, parts[part])
                votes = [index.vote(near) for near in index.nearest_others([r[2:] for r in rows], k)]
                yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in rows], pa.int32()), pa.array(votes, pa.float64())], ["toxic", "vote"])

    return run


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, k: int = NEIGHBOURS) -> Model:
    """Learns from the labels of training rows and from the texts of all documents."""
    return fit_and_read(docs, labels, key, text, rows, k)[0]


def fit_and_read(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, k: int = NEIGHBOURS) -> tuple[Model, DataFrame]:
    """The model, and (key, body): the feature counts of all documents, as they were stored for the document frequencies."""
    return _fitted(docs, labels, docs.select(F.col(key).alias("key"), common.text_of(text).alias("body")), "body", key, text, rows, k)


def _fitted(docs: DataFrame, labels: DataFrame, kept: DataFrame, body: str, key: str, text: str, rows: int, k: int) -> tuple[Model, DataFrame]:
    """The model, and ``kept`` as it was stored with feature counts in place of the texts in its column ``body``."""
    spark = docs.sparkSession
    known = labels.select(F.col(key).cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = known.orderBy(F.xxhash64(F.lit(10), "doc_id"), "doc_id").limit(rows)
    slim = docs.select(F.col(key).cast("long").alias("doc_id"), common.text_of(text).alias("text"))
    home = common.shared_dir(spark, "toxicity")
    one = slim.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    chosen = common.stored(one, f"{home}/sample").repartition(min(64, max(1, spark.sparkContext.defaultParallelism)), "doc_id")
    toxic = chosen.where("toxic = 1").count()
    k = neighbours(toxic, k)

    names = sorted(chosen.mapInArrow(_features, "feature string").distinct().toArrow().column("feature").to_pylist()) if toxic else []
    common.put_file(f"{home}/names", zlib.compress("\n".join(names).encode(), 1))
    common.put_file(f"{home}/beginnings", Reader(names or [""]).beginnings.tobytes())
    read = kept.withColumn(body, _read(home)(F.col(body)))
    if not toxic:
        return Model(None, np.zeros(1), np.zeros(1), k), read
    read = common.stored(read, f"{home}/read")
    counted = read.select(F.col(body).alias("body")).mapInArrow(_frequencies(len(names)), "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    df = np.zeros(len(names) + 1, np.int64)
    df[counted.column("feature").to_numpy()] = counted.column("n").to_numpy()
    common.put_file(f"{home}/idf", _bytes(idf=1 + np.log((df[-1] + 1) / (df[:-1] + 1))))
    del names, counted
    parts = sorted(r["part"] for r in chosen.mapInArrow(_vectors(home), "part int").collect())
    spark.range(0, 1, 1, 1).mapInArrow(_built(home, parts), "id long").collect()

    votes = spark.range(0, len(parts), 1, len(parts)).mapInArrow(_votes(home, parts, k), "toxic int, vote double").toArrow()
    at, shares = monotone(np.round(votes.column("vote").to_numpy(), 6), votes.column("toxic").to_numpy())
    return Model(home, at, shares, k), read


_RESULT = "key {}, score double, predicted int, evidence array<struct<doc_id: long, toxic: int, cosine: double>>"


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score, predicted, evidence) of every document, in one pass; evidence has the nearest examples first."""
    return _scored(docs.select(F.col(key).alias("key"), common.text_of(text).alias("body")), model, model.score_texts)


def score_read(read: DataFrame, model: Model) -> DataFrame:
    """``score`` of the documents that ``fit_and_read`` has read."""

    return _scored(read, model, model.score_bodies)


def _scored(slim: DataFrame, model: Model, scores_of: Callable[[list], Iterator[tuple[float, list[tuple[float, int]]]]]) -> DataFrame:
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = _RESULT.format(slim.schema["key"].dataType.simpleString())
    schema = to_arrow_schema(spark_schema(shape))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores, evidence = [], []
            for s, near in scores_of(batch.column("body").to_pylist()):
                index = index_of(model.uri, both=True) if near else None
                scores.append(s)
                evidence.append([{"doc_id": index.ids[i], "toxic": int(index.labels[i]), "cosine": c} for c, i in near[:EVIDENCE]])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, schema.field("evidence").type)], schema=schema)

    return slim.mapInArrow(run, shape)


def keep_clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text is not predicted to be toxic by a model that is there, in one pass."""

    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([s < 0.5 for s, _ in model.score_texts(batch.to_pylist())], pa.bool_())

    return docs.where(F.arrow_udf(clean, "boolean")(common.text_of(text)))


def drop_toxic(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", rows: int = FIT_ROWS, k: int = NEIGHBOURS) -> DataFrame:
    """The rows of ``docs``, with all their columns, whose text isn't predicted to be toxic by the model that ``labels`` give.

    Texts are read once: feature counts are stored beside all columns, in one more under a free name, and only they go to the tasks that score.
    """
    body = "features"
    while body.lower() in (c.lower() for c in docs.columns):
        body = f"_{body}"
    model, read = _fitted(docs, labels, docs.withColumn(body, common.text_of(text)), body, key, text, rows, k)

    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([s < 0.5 for s, _ in model.score_bodies(batch.to_pylist())], pa.bool_())

    return read.where(F.arrow_udf(clean, "boolean")(F.col(body))).drop(body)


def spark_schema(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents of the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model, read = fit_and_read(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = score_read(read, model)
    return out.select(F.col("key").alias("doc_id"), held_out("key").alias("held_out"), "score", "predicted", F.to_json("evidence").alias("evidence"))
