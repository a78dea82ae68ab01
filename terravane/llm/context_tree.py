"""Code lengths by context-tree weighting (operator 6).

Texts are lower-case UTF-8 bytes with an end mark. Each byte is eight binary decisions; each decision has a tree of contexts,
the last 0 to ``DEPTH`` bytes before it. A node's Krichevsky-Trofimov probability of what it has seen in training, and the product
of its children's weighted probabilities, are mixed half and half; so all depths take part, and the posterior weights say
how much each counts for the next decision. A context never seen has no node: there the estimate of the longest one
seen stands.

The counts of all (context, byte) strings of the training texts are a sufficient statistic of all trees. Strings are ordered by
the byte next to the decision, then the one before it, and so on, so the strings below any node stand together, and buckets
are ranges of this order with like numbers of bytes (``Ranges``). Batches of documents count their own strings (see
``batches``) and cut them at the bounds of the buckets; a bucket adds them up, grows the subtrees that lie in it whole and keeps,
in a file, the sums and what was asked. Nodes above a bound lie in more than one bucket; what their children pass on
goes through the driver, as their number follows the number of buckets and not the data. Then the buckets, a part of them
at a time, answer each batch with the log-probability of each of its strings (to 2**-24), and the batch adds them up
by document. A bucket's trees are grown a second time for the answers, as their nodes would take several times the room of the
sums. The word counts of the base score go the same way. A string that is frequent in a batch is sent once, so batches are as
large as a task's memory allows; texts are read in pieces of half a megabyte.

Defined cases: null text is empty; an empty text is its end mark alone; a null id is training text; repeated rows count
each; texts of any length are read whole; without any training text every decision is even and the base is
undefined-free (N = V = 0); an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import batches, common

DEPTH = 7
#: Least depth of a root, a context whose whole subtree is in one bucket.
SPLIT = 1
#: Text for each batch and each bucket; both grow with the data beyond ``MOST`` of them, so that asks stay under ``MOST`` squared.
BATCH_BYTES = 16 << 20
BUCKET_BYTES = 6 << 20
MOST = 1 << 15
#: Parts of the buckets that answer one after the other; it bounds what is shuffled at a time.
TURNS = 4
#: Ends texts and precedes their first byte; no byte of UTF-8.
END = 0xFF
_WHITE = b" \t\n\x0b\x0c\r"
_END_WORD = xxhash.xxh3_64_intdigest(b"\x00end of text")


def held_out(doc_id: int | None) -> bool:
    import zlib

    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def lowered(text: str) -> bytes:
    """A-Z only."""
    return text.encode("utf-8", "surrogatepass").lower()


def strings(texts: list[bytes], step: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The (context, byte) strings of texts, and the place of each one's text; in pieces.

    The highest byte of a string is the last one of the context, the lowest is the byte that follows the context. Before a
    text its context is end marks, and one end mark follows it.
    """
    pad, end = bytes([END]) * DEPTH, bytes([END])
    raw = b"".join([b"\0" * (8 - DEPTH), *(x for t in texts for x in (pad, t, end))])
    after = np.cumsum([len(t) + 1 + DEPTH for t in texts], dtype=np.int64) if texts else np.zeros(0, np.int64)
    n, last = int(after[-1]) if len(after) else 0, np.frombuffer(raw, np.uint8)
    for i in range(0, max(n - DEPTH, 0), step):
        m = min(step, n - DEPTH - i)
        windows = np.ndarray((m,), "<u8", raw, i, (1,)) & _bytes_kept(DEPTH) | last[i + 8 : i + 8 + m]
        at = np.arange(i + DEPTH, i + DEPTH + m)  # of the byte, among texts with their contexts
        of = np.searchsorted(after, at, side="right") if m < 64 else _runs(after, i + DEPTH, m)
        keep = at - (after[of] - np.diff(after, prepend=0)[of]) >= DEPTH
        yield windows[keep], of[keep]


def _bytes_kept(depth: int) -> np.uint64:
    """Mask of the ``depth`` highest bytes."""
    return np.uint64((256**depth - 1) << 8 * (8 - depth))


def _runs(after: np.ndarray, begin: int, m: int) -> np.ndarray:
    """The text of each of m places from ``begin`` on."""
    first, last = np.searchsorted(after, [begin, begin + m - 1], side="right")
    ends = np.minimum(after[first : last + 1], begin + m)
    return np.repeat(np.arange(first, last + 1, dtype=np.int32), np.diff(ends, prepend=begin))


def _firsts(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    return np.flatnonzero(new)


def added(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys with the sums of their counts; quick where ``keys`` is made of ascending runs."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = _firsts(keys)
    return keys[first], np.add.reduceat(counts, first)


class Sums:
    """Adds up ascending keys with counts; sets of like size are merged, so each key is moved a few times only."""

    def __init__(self):
        self.sets: list[tuple[np.ndarray, np.ndarray]] = []

    def add(self, keys: np.ndarray, counts: np.ndarray) -> None:
        self.sets.append((keys, counts))
        while len(self.sets) > 1 and 2 * len(self.sets[-1][0]) >= len(self.sets[-2][0]):
            self._merge()

    def _merge(self) -> None:
        one, two = self.sets.pop(), self.sets.pop()
        self.sets.append(added(*(np.concatenate(x) for x in zip(two, one, strict=True))))

    def all(self) -> tuple[np.ndarray, np.ndarray]:
        while len(self.sets) > 1:
            self._merge()
        return self.sets[0] if self.sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def counted_strings(texts: list[bytes], away: list[bool]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct strings of a batch, with their counts in the texts that are not ``away``."""
    flag, sums = np.array(away, bool), Sums()
    for k, of in strings(texts):
        gone = flag[of]
        for part, learned in ((k[~gone], True), (k[gone], False)):
            if len(part):
                part.sort()
                first = _firsts(part)
                sums.add(part[first], np.diff(np.append(first, len(part))).astype(np.int32) if learned else np.zeros(len(first), np.int32))
    return sums.all()


def distinct_strings(texts: list[bytes]) -> np.ndarray:
    """``counted_strings`` without the counts, in less memory."""
    sets: list[np.ndarray] = []

    def merge(own: np.ndarray) -> None:
        own.sort(kind="stable")
        sets.append(own[_firsts(own)])

    for k, _ in strings(texts):
        k.sort()
        sets.append(k[_firsts(k)])
        while len(sets) > 1 and 2 * len(sets[-1]) >= len(sets[-2]):
            merge(np.concatenate([sets.pop(), sets.pop()]))
    every = np.concatenate([np.zeros(0, np.uint64), *sets])
    sets.clear()
    merge(every)
    return sets[0]


def _mix(x: np.ndarray, buckets: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return ((x >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


class Ranges:
    """Which bucket a string belongs to: ``bounds`` has the least strings of all buckets but the first.

    A context that is the beginning of a bound is in more than one bucket, or might be. The longest context of a string that
    is none, but has no shorter one that is none, is the string's root.
    """

    def __init__(self, bounds: np.ndarray):
        self.bounds = np.unique(bounds & _bytes_kept(DEPTH))
        self.buckets = len(self.bounds) + 1
        self.split = {d: np.unique(self.bounds & _bytes_kept(d)) for d in range(SPLIT, DEPTH)}

    def roots(self, keys: np.ndarray) -> np.ndarray:
        """The depth of the root of each string."""
        out, left = np.full(len(keys), SPLIT, np.int8), np.arange(len(keys))
        for depth, split in self.split.items():
            if not len(left) or not len(split):
                break
            own = keys[left] & _bytes_kept(depth)
            left = left[split[np.minimum(np.searchsorted(split, own), len(split) - 1)] == own]
            out[left] = depth + 1
        return out

    def ends(self, keys: np.ndarray) -> np.ndarray:
        """Where each bucket begins among ascending keys, and their number."""
        return np.concatenate([[0], np.searchsorted(keys, self.bounds), [len(keys)]])


def _points(each: int):
    """Every so manyth string of each piece in order: places at which buckets might be cut."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for body in part.column("body"):
                common.claim("contexts")
                for keys, _ in strings([lowered(t) for t in batches.texts_of(body.as_py())]):
                    keys.sort()
                    step = max(1, min(each, len(keys)))
                    own = keys[step // 2 :: step] & _bytes_kept(DEPTH)
                    yield pa.RecordBatch.from_arrays([pa.array((own ^ np.uint64(1 << 63)).view(np.int64))], ["point"])  # the sign keeps the order

    return run


def ranges(rows: DataFrame, total: int, buckets: int) -> Ranges:
    """Bounds with like numbers of bytes between them. Pieces are at most a megabyte, so few of them are one point; results do not depend on the bounds."""
    each = max(1, min(total // buckets // 8, 1 << 17))
    at = F.percentile_approx("point", [k / buckets for k in range(1, buckets)], 8 * buckets)
    found = rows.select("body").mapInArrow(_points(each), "point long").agg(at.alias("at")).first()["at"] if buckets > 1 else None
    return Ranges(np.array(found or [], np.int64).view(np.uint64) ^ np.uint64(1 << 63))


def log_gamma(x: np.ndarray) -> np.ndarray:
    """By Stirling's series, seven steps up."""
    shift = np.ones_like(x)
    for k in range(7):
        shift *= x + k
    y = x + 7
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - np.log(shift)


def _of_counts(n: np.ndarray, more: float) -> np.ndarray:
    """``log_gamma(n + more)`` of whole numbers, most of which are small."""
    table = log_gamma(np.arange(1 << 12) + more)
    out = table[np.minimum(n, len(table) - 1).astype(np.int64)]
    large = np.flatnonzero(n >= len(table))
    out[large] = log_gamma(n[large] + more)
    return out


def log_kt(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Krichevsky-Trofimov probability of a zeros and b ones, as a natural logarithm."""
    return _of_counts(a, 0.5) + _of_counts(b, 0.5) - _of_counts(a + b, 1.0) - np.log(np.pi)


def decision(keys: np.ndarray, t: int) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of decision t of 8 (context, then the bits of the byte before it with a leading one), and its bit. Ascending if ``keys`` are."""
    byte = keys & np.uint64(255)
    return keys & _bytes_kept(DEPTH) | np.uint64(1 << t) | byte >> np.uint64(8 - t), byte >> np.uint64(7 - t) & np.uint64(1)


def at_depth(nodes: np.ndarray, depth: int) -> np.ndarray:
    return nodes & (_bytes_kept(depth) | np.uint64(255))


class Level:
    """The nodes of one depth in ascending order: counts, weighted probability, and the weight of their own estimate."""

    def __init__(self, nodes, zeros, ones, below=None):
        self.nodes, self.zeros, self.ones = nodes, zeros, ones
        own = log_kt(zeros, ones)
        if below is None:
            self.log_weighted, self.own = own, np.ones(len(nodes))
        else:
            top = np.maximum(own, below)
            self.log_weighted = top + np.log(np.exp(own - top) + np.exp(below - top)) - np.log(2)
            self.own = 1 / (1 + np.exp(np.minimum(below - own, 700)))

    def parents(self, depth: int):
        """Nodes one level up, at ``depth``, with the counts and the products of what is here; ``up`` leads there."""
        nodes = at_depth(self.nodes, depth)
        order = np.argsort(nodes, kind="stable")
        nodes = nodes[order]
        first = _firsts(nodes)
        self.up = np.empty(len(nodes), np.int64)
        self.up[order] = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(nodes))))
        return nodes[first], *(np.add.reduceat(x[order], first) if len(first) else x for x in (self.zeros, self.ones, self.log_weighted))


def grow(keys: np.ndarray, counts: np.ndarray, t: int, down_to: int) -> list[Level]:
    """The levels of decision t from DEPTH to ``down_to``, from ascending strings, one at least. The first one's ``places`` has the node of each string."""
    nodes, bit = decision(keys, t)
    first, ones = _firsts(nodes), np.where(bit == 1, counts, 0).astype(float)
    zeros, ones = np.add.reduceat(counts - ones, first), np.add.reduceat(ones, first)
    levels = [Level(nodes[first], zeros, ones)]
    levels[0].places = np.repeat(np.arange(len(first)), np.diff(np.append(first, len(nodes))))
    for depth in range(DEPTH - 1, down_to - 1, -1):
        levels.append(Level(*levels[-1].parents(depth)))
    return levels


def upper(sums: dict[int, tuple[np.ndarray, ...]]) -> dict[int, Level]:
    """The levels of split contexts and of all above them, by depth, from what the roots one level down pass on: nodes, zeros, ones, products."""
    levels: dict[int, Level] = {}
    for depth in range(max(sums, default=SPLIT - 1), -1, -1):
        from_roots = sums.get(depth, (np.zeros(0, np.uint64), *[np.zeros(0)] * 3))
        from_below = levels[depth + 1].parents(depth) if depth + 1 in levels else (np.zeros(0, np.uint64), *[np.zeros(0)] * 3)
        nodes, at = np.unique(np.concatenate([from_roots[0], from_below[0]]), return_inverse=True)
        levels[depth] = Level(nodes, *(np.bincount(at, np.concatenate(x), len(nodes)) for x in zip(from_roots[1:], from_below[1:], strict=True)))
    return levels


def chance_of_seen(levels: list[Level], above: list[Level]) -> np.ndarray:
    """Of a one at the decision of each string that ``levels`` have grown from; ``above`` has the levels from their roots' parents up to depth 0."""
    path, chance = np.arange(len(levels[0].nodes)), None
    every = levels + above
    for i, level in enumerate(every):
        one = (level.ones + 0.5) / (level.zeros + level.ones + 1)
        chance = one[path] if chance is None else level.own[path] * one[path] + (1 - level.own[path]) * chance
        if i < len(levels) - 1:
            path = level.up[path]
        elif i < len(every) - 1:
            path = np.searchsorted(every[i + 1].nodes, at_depth(level.nodes, DEPTH - i - 1))[path]
    return chance[levels[0].places]


def chance_of_any(nodes: np.ndarray, levels: list[Level]) -> np.ndarray:
    """Of a one at any nodes of depth DEPTH, seen or not; levels from DEPTH to 0."""
    p, known = np.full(len(nodes), 0.5), np.zeros(len(nodes), bool)
    for i, level in enumerate(levels):
        if not len(level.nodes):
            continue
        own = at_depth(nodes, DEPTH - i)
        at = np.minimum(np.searchsorted(level.nodes, own), len(level.nodes) - 1)
        here = level.nodes[at] == own
        estimate = (level.ones[at] + 0.5) / (level.zeros[at] + level.ones[at] + 1)
        w = np.where(known, level.own[at], 1.0)
        p = np.where(here, w * estimate + (1 - w) * p, p)
        known |= here
    return p


def squeezed(x: np.ndarray, kind: str) -> bytes:
    """Bytes of equal significance together, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.astype(kind).view(np.uint8).reshape(-1, np.dtype(kind).itemsize).T).tobytes())


def unsqueezed(body: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    return np.ascontiguousarray(planes.T).view(kind).ravel()


def _pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending keys with counts."""
    return squeezed(np.concatenate([np.diff(keys, prepend=np.uint64(0)) if len(keys) else keys, counts.astype(np.uint64)]), "<u8")


def _unpack(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = unsqueezed(body, "<u8")
    n = len(both) // 2
    return np.cumsum(both[:n], dtype=np.uint64), both[n:].astype(np.int64)


def word_key(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def _asks(of_words: int, of: Ranges):
    """Word keys go to buckets 0.., strings to buckets after them."""

    def run(batch: int, names: list, texts: list[str]) -> Iterator[tuple[int, bytes]]:
        out = [held_out(i) for i in names]
        low = [lowered(t) for t in texts]
        texts.clear()
        train, words = Counter(), set()
        for t, away in zip(low, out, strict=True):
            words.update(t.split()) if away else train.update(t.split())
        for w in words:
            train.setdefault(w, 0)
        keys = np.fromiter((word_key(w) for w in train), np.uint64, len(train))
        counts = np.fromiter(train.values(), np.int64, len(train))
        del train, words
        keys, counts = np.append(keys, np.uint64(_END_WORD)), np.append(counts, len(out) - sum(out))
        order, ends = _by_hash(keys, of_words)
        yield from _cut(keys[order], counts[order], ends, 0)

        keys, counts = counted_strings(low, out)
        del low
        yield from _cut(keys, counts, of.ends(keys), of_words)

    return run


def _by_hash(keys: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places by bucket, ascending within it, and where each bucket begins."""
    order = np.argsort(keys)
    bucket = _mix(keys[order], buckets).astype(np.uint16)
    by = np.argsort(bucket, kind="stable")
    return order[by], np.searchsorted(bucket[by], np.arange(buckets + 1))


def _cut(keys: np.ndarray, counts: np.ndarray, ends: np.ndarray, first: int) -> Iterator[tuple[int, bytes]]:
    for b in np.flatnonzero(np.diff(ends)).tolist():
        yield first + b, _pack(keys[ends[b] : ends[b + 1]], counts[ends[b] : ends[b + 1]])


def _replied(replies: dict[int, bytes], ends: np.ndarray, first: int) -> np.ndarray:
    """What the buckets have replied to ``_cut``."""
    out = np.zeros(ends[-1], np.uint32)
    for b in np.flatnonzero(np.diff(ends)).tolist():
        out[ends[b] : ends[b + 1]] = unsqueezed(replies.pop(first + b), "<u4")
    return out


def _sums(bodies: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    sums = Sums()
    for b in bodies:
        sums.add(*_unpack(b))
    return sums.all()


def _by_root(keys: np.ndarray, of: Ranges) -> Iterator[tuple[int, np.ndarray]]:
    roots = of.roots(keys)
    for depth in range(SPLIT, DEPTH + 1):
        at = np.flatnonzero(roots == depth)
        if len(at):
            yield depth, at


def _top(of_words: int, of: Ranges, uri: str):
    """Sums of a bucket for all: its number (depth -2), and tokens and distinct tokens (depth -1) or what its roots pass on. What was asked stays in a file."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        bucket, table = key[0].as_py(), table.sort_by("batch")
        bodies = table.column("body").to_pylist()
        keys, counts = _sums(bodies)
        common.put_file(f"{uri}/{bucket}.asked", pickle.dumps((table.column("batch").to_pylist(), bodies, _pack(keys, counts))))
        del bodies, table
        seen = counts > 0
        out = [(-2, [bucket], [0], [0], [0])]
        if bucket < of_words:
            out.append((-1, [-1], [counts.sum()], [seen.sum()], [0]))
        else:
            keys, counts = keys[seen], counts[seen]
            out += [(depth - 1, *grow(keys[at], counts[at], t, depth)[-1].parents(depth - 1)) for depth, at in _by_root(keys, of) for t in range(8)]
        depths, nodes = (np.concatenate([np.asarray(y).astype(np.int64) for y in x]) for x in ([np.full(len(x[1]), x[0]) for x in out], [x[1] for x in out]))
        zeros, ones, products = (np.concatenate([np.asarray(x[i], float) for x in out]) for i in (2, 3, 4))
        return pa.table({"depth": pa.array(depths, pa.int32()), "node": pa.array(nodes), "zeros": pa.array(zeros), "ones": pa.array(ones), "product": pa.array(products)})

    return run


#: Log-probabilities are sent as whole multiples of this.
UNIT = 2.0**-24


def _answers(uri: str, of_words: int, of: Ranges):
    """The replies of the buckets named in the rows."""

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        above = None
        for part in parts:
            for bucket in part.column("bucket").to_pylist():
                common.claim("contexts")
                names, bodies, sums = pickle.loads(common.get_file(f"{uri}/{bucket}.asked"))
                keys, value = _unpack(sums)
                if bucket >= of_words:
                    above = above or pickle.loads(common.get_file(f"{uri}/above"))
                    value = _values(keys, value, of, above)
                for name, body in zip(names, bodies, strict=True):
                    reply = squeezed(value[np.searchsorted(keys, _unpack(body)[0])], "<u4")
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([name], pa.int64()), pa.array([reply], pa.binary())], ["bucket", "batch", "body"])

    return run


def _values(keys: np.ndarray, counts: np.ndarray, of: Ranges, above: dict[int, Level]) -> np.ndarray:
    """Log-probabilities of a bucket's strings, in units."""
    out = np.zeros(len(keys))
    for depth, at in _by_root(keys, of):
        own, n = keys[at], counts[at]
        seen, upward = n > 0, [above.get(d) or _nothing() for d in range(depth - 1, -1, -1)]
        for t in range(8):
            levels = grow(own[seen], n[seen], t, depth) if seen.any() else [_nothing() for _ in range(depth, DEPTH + 1)]
            nodes, bit = decision(own, t)
            one = np.zeros(len(own))
            if seen.any():
                one[seen] = chance_of_seen(levels, upward)
            one[~seen] = chance_of_any(nodes[~seen], levels + upward)
            out[at] += np.log10(np.where(bit == 1, one, 1 - one))
    return np.rint(-out / UNIT).astype(np.int64)


def _nothing() -> Level:
    return Level(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0))


class _Numbers(dict):
    """Words in the order of their first occurrence."""

    def __missing__(self, word: bytes) -> int:
        self[word] = len(self)
        return len(self) - 1


def _scores(of_words: int, of: Ranges, tokens: int, distinct: int):
    def run(batch: int, names: list, texts: list[str], replies: dict[int, bytes]) -> Iterator[pa.RecordBatch]:
        low = [lowered(t) for t in texts]
        texts.clear()
        number = _Numbers()
        each = [np.fromiter(map(number.__getitem__, t.split()), np.int32) for t in low]
        keys = np.append(np.fromiter((word_key(w) for w in number), np.uint64, len(number)), np.uint64(_END_WORD))
        del number
        order, ends = _by_hash(keys, of_words)
        count = np.zeros(len(keys), np.int64)
        count[order] = _replied(replies, ends, 0)
        logs = np.log10((count + 1.0) / (tokens + distinct + 1))
        n_tokens = [len(e) + 1 for e in each]
        n_known = [int((count[e] > 0).sum()) + int(count[-1] > 0) for e in each]
        base = [float(logs[e].sum() + logs[-1]) for e in each]
        del each

        keys = distinct_strings(low)
        value = _replied(replies, of.ends(keys), of_words)
        score = np.zeros(len(low))
        for own, at in strings(low, 1 << 18):
            order = np.argsort(own)
            own = own[order]
            first = _firsts(own)
            score += np.bincount(at[order], np.repeat(value[np.searchsorted(keys, own[first])], np.diff(np.append(first, len(own)))), len(low))
        score *= -UNIT
        size = np.array([len(t) for t in low])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(names, pa.int64()), pa.array([held_out(i) for i in names]), pa.array(n_tokens, pa.int64()), pa.array(n_known, pa.int64()), pa.array([tokens] * len(names), pa.int64()),
                pa.array(base), pa.array(score), pa.array(size, pa.int64()), pa.array(-score / np.log10(2) / np.maximum(size, 1)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "n_bytes", "bits_per_byte"],
        )

    return run


def score(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Trains on the rows that are not held out and scores all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte."""
    spark = docs.sparkSession
    home = common.shared_dir(spark, "context-tree")
    total = common.text_bytes(docs, text)
    rows = batches.batched(docs, f"{home}/batches", key, text, max(BATCH_BYTES, total // MOST))
    of = ranges(rows, total, common.parts(total, BUCKET_BYTES, MOST))
    of_words = common.parts(total, 8 * BUCKET_BYTES, MOST)
    asked = batches.ask("contexts", rows, _asks(of_words, of))
    with common.tidy(spark):
        made = asked.groupBy("bucket").applyInArrow(_top(of_words, of, home), "depth int, node long, zeros double, ones double, product double")
        found = made.groupBy("depth", "node").agg(*(F.sum(c).alias(c) for c in ("zeros", "ones", "product"))).toPandas().sort_values("node")
    words = found[found["depth"] == -1]
    tokens, distinct = (int(words[c].sum()) for c in ("zeros", "ones"))
    sums = {int(d): (own["node"].to_numpy().astype(np.uint64), *(own[c].to_numpy() for c in ("zeros", "ones", "product"))) for d, own in found[found["depth"] >= 0].groupby("depth")}
    common.put_file(f"{home}/above", pickle.dumps(upper(sums)))
    names = sorted(int(n) for n in found[found["depth"] == -2]["node"])
    for turn in range(TURNS):
        own = [(n,) for n in names[turn::TURNS]]
        numbers = spark.createDataFrame(own, "bucket int").repartition(max(1, min(len(own), 4096)))
        batches.deliver(numbers.mapInArrow(_answers(home, of_words, of), "bucket int, batch long, body binary"), f"{home}/replies/{turn}")
    replies = [f"{home}/replies/{turn}" for turn in range(min(TURNS, len(names)))]
    shape = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, n_bytes long, bits_per_byte double"
    return batches.finish("contexts", rows, replies, _scores(of_words, of, tokens, distinct), shape)


def op6_context_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents of the table."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
