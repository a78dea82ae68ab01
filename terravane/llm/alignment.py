"""Token groups of two tokenizers over the same bytes (operator 12).

A text gets one label for each byte: none, end of an A token, end of a B token, or both. A regular expression scans
the labels and extracts spans up to each both-label; the labels counted in a span say how many tokens of either side form its group.
Both tokenizers start a token where white space follows other characters, so a both-label stands before each such place,
labels are made and scanned for each distinct unit (white space and the word behind it) once in a worker, and a text's groups
are those of its units. Texts with characters for which that is not sure are labelled whole.

The last tokens of a group are linked. How often a pair of ids is linked in the corpus is counted in two steps: distinct pairs are
counted within a batch of texts, then pairs are summed over batches, so a pair that every text holds is one row for each batch.
A batch then gets the counts of its own pairs by a join; no table of pairs is broadcast or held whole.

Defined cases: null and empty texts, and texts that either tokenizer doesn't give back byte by byte, have no tokens; texts are read whole,
however long; repeated rows are each a row of the result and each count; equal pair counts are all best; an empty table gives no rows; a null
key stays null; special tokens in a text are plain text; only key and text are read, other columns may have any name.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from terravane.llm import common

#: Characters of text in a batch, within which pairs are counted before they are shuffled.
BATCH_CHARS = 24 << 20
#: Units that a worker remembers, and the longest one that is kept.
UNITS = 600_000
UNIT_CHARS = 200
#: Labels of a byte; the label of both ends is the bitwise or of the two.
NONE, A_END, B_END, BOTH = b"@", b"A", b"B", b"C"
_SPANS = re.compile(rb"[@AB]*C")
_UNITS = re.compile(r"\s*\S+|\s+")
#: White space but for space, line feed and tab, and what stands for a space in B's pieces: such texts are labelled whole.
_ODD = re.compile("[\x00\x0b\x0c\r\x1c-\x1f\x85\xa0 ᠎ -‏    ⁠▁　﻿]")
_SPACE = "\u2581"


def label_of(token: bytes, end: bytes) -> bytes:
    return NONE * (len(token) - 1) + end


def both_labels(a: bytes, b: bytes) -> bytes:
    """One label string from those of either side, which are equally long."""
    return (int.from_bytes(a) | int.from_bytes(b)).to_bytes(len(a))


def group_sizes(labels: bytes) -> list[tuple[int, int]]:
    """Tokens of A and of B in each group."""
    return [(span.count(A_END) + 1, span.count(B_END) + 1) for span in _SPANS.findall(labels)]


class Aligner:
    """Both tokenizers, and what is known of the units seen so far."""

    def __init__(self, a_path: str, b_path: str, limit: int = UNITS):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.limit = limit
        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        letters = {c: b for b, c in _byte_letters().items()}
        special = set(self.a.get_added_tokens_decoder())
        vocabulary = {bytes(letters[c] for c in piece): i for piece, i in self.a.get_vocab(with_added_tokens=False).items() if i not in special}
        self.a_bytes = {i: piece for piece, i in vocabulary.items()}
        # Ids of a byte-level vocabulary are in the order of its merges, so they serve as ranks for single units.
        import public_tokenizers

        self.a_units = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.vocab_size())]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(_SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id(_SPACE)
        self.a_size, self.b_size = np.zeros(max(self.a_bytes) + 1, np.int64), np.array([len(p) for p in self.b_bytes])
        for i, piece in self.a_bytes.items():
            self.a_size[i] = len(piece)
        self.a_labels = {i: label_of(piece, A_END) for i, piece in self.a_bytes.items()}
        self.b_labels = [label_of(piece, B_END) for piece in self.b_bytes]
        #: Ids as text with what follows them: a comma within a group, a bar or a semicolon behind its last id.
        self.a_parts, self.a_bars = (np.array([f"{i}{c}" for i in range(len(self.a_size))], object) for c in ",|")
        self.b_parts, self.b_bars = (np.array([f"{i}{c}" for i in range(len(pieces))], object) for c in ",;")
        self.a_text, self.b_text = {i: str(i) for i in self.a_bytes}, [str(i) for i in range(len(pieces))]
        #: No piece joins white space to characters before it, but for the characters that ``_ODD`` has.
        if any(re.search(rf"[^\s{_SPACE}][ \n\t{_SPACE}]", p) for i, p in enumerate(pieces) if not self.b.is_byte(i)):
            raise ValueError("a piece of B reaches over white space, so units can't be labelled alone")
        self._forget()

    def _forget(self) -> None:
        self.units: dict[str, int] = {}
        self.groups: list[str] = []
        self.n_a, self.n_b, self.whole, self.start, self.length, self.links = array("q"), array("q"), array("b"), array("q"), array("q"), array("Q")

    def tokens(self, text: str) -> tuple[list[int], list[int]]:
        """Ids of a space and a whole text by both tokenizers."""
        return self.a.encode(" " + text, add_special_tokens=False).ids, self.b.encode(text)

    def grouped(self, body: bytes, a: list[int], b: list[int]) -> tuple[str, list[int]] | None:
        """Groups as text and links as ``a << 32 | b``, or None where the tokens don't give the bytes back."""
        if not body or b"".join(map(self.a_bytes.__getitem__, a)) != body or b"".join(map(self.b_bytes.__getitem__, b)) != body:
            return None
        a_text, b_text = list(map(self.a_text.__getitem__, a)), list(map(self.b_text.__getitem__, b))
        labels = both_labels(b"".join(map(self.a_labels.__getitem__, a)), b"".join(map(self.b_labels.__getitem__, b)))
        out, links, i, j = [], [], 0, 0
        for n, m in group_sizes(labels):
            out.append(f"{','.join(a_text[i : i + n])}|{','.join(b_text[j : j + m])}")
            i, j = i + n, j + m
            links.append(a[i - 1] << 32 | b[j - 1])
        return ";".join(out), links

    def _put(self, unit: str, n_a: int, n_b: int, groups: str, links: list[int], whole: bool) -> None:
        self.units[unit] = len(self.units)
        self.whole.append(whole)
        self.groups.append(groups)
        self.n_a.append(n_a)
        self.n_b.append(n_b)
        self.start.append(len(self.links))
        self.length.append(len(links))
        self.links.extend(links)

    def _alone(self, unit: str) -> None:
        a = self.a_units.encode_ordinary(unit)
        b = [self.space] if unit == " " else self.b.encode(unit[1:] if unit[0] == " " else unit)  # B adds a space
        if unit[0] != " ":
            b = b[1:] if b and b[0] == self.space else []
        found = self.grouped(unit.encode(), a, b)
        self._put(unit, len(a), len(b), *(found or ("", [])), found is not None)

    def _add(self, units: list[str]) -> None:
        """Labels new units, those that can stand in a text one after another as one text."""
        row = sorted((u for u in units if not u.isspace()), key=lambda u: u[0] != " ")
        if row and row[0][0] == " " and self._row(row):
            row = []
        for unit in [*row, *(u for u in units if u.isspace())]:
            self._alone(unit)

    def _row(self, units: list[str]) -> bool:
        text = "".join(units)
        a, b = self.a_units.encode_ordinary(text), self.b.encode(text[1:])
        body = text.encode()
        if b"".join(map(self.a_bytes.__getitem__, a)) != body or b"".join(map(self.b_bytes.__getitem__, b)) != body:
            return False
        a_ids, b_ids = np.array(a), np.array(b)
        a_ends, b_ends = np.cumsum(self.a_size[a_ids]), np.cumsum(self.b_size[b_ids])
        labels = np.full(len(body), NONE[0], np.uint8)
        labels[a_ends - 1] |= A_END[0]
        labels[b_ends - 1] |= B_END[0]
        ends = np.cumsum([len(u.encode()) for u in units])
        if (labels[ends - 1] != BOTH[0]).any():
            return False
        n, m = np.array(group_sizes(labels.tobytes())).T
        a_last, b_last = np.cumsum(n) - 1, np.cumsum(m) - 1
        a_parts, b_parts = self.a_parts[a_ids], self.b_parts[b_ids]
        a_parts[a_last] = self.a_bars[a_ids[a_last]]
        b_parts[b_last] = self.b_bars[b_ids[b_last]]
        of_group = np.arange(len(n))
        parts = np.concatenate([a_parts, b_parts])[np.argsort(np.concatenate([np.repeat(2 * of_group, n), np.repeat(2 * of_group + 1, m)]), kind="stable")].tolist()
        links = (a_ids[a_last] << 32 | b_ids[b_last]).astype(np.uint64)
        n_a, n_b = (np.diff(np.searchsorted(x, ends, "right"), prepend=0) for x in (a_ends, b_ends))
        n_groups = np.diff(np.searchsorted(np.flatnonzero(labels == BOTH[0]) + 1, ends, "right"), prepend=0)
        cuts = [0, *np.cumsum(n_a + n_b).tolist()]
        self.groups += ["".join(parts[x:y])[:-1] for x, y in zip(cuts, cuts[1:])]
        self.start.frombytes((len(self.links) + np.cumsum(n_groups) - n_groups).tobytes())
        for own, new in ((self.n_a, n_a), (self.n_b, n_b), (self.length, n_groups), (self.links, links), (self.whole, np.ones(len(units), np.int8))):
            own.frombytes(new.tobytes())
        self.units.update(zip(units, range(len(self.units), len(self.units) + len(units)), strict=True))
        return True

    def align(self, text: str) -> tuple[int, int, str, np.ndarray]:
        """Numbers of tokens, groups and links of a text; nothing where a tokenizer doesn't give it back."""
        nothing = 0, 0, "", np.zeros(0, np.uint64)
        if not text:
            return nothing
        if _ODD.search(text):
            return self._whole(text) or nothing
        units = _UNITS.findall(" " + text)
        at = list(map(self.units.get, units))
        if None in at:
            new = {u for u, k in zip(units, at, strict=True) if k is None}
            if max(map(len, new)) > UNIT_CHARS:
                return self._whole(text) or nothing
            if len(self.units) + len(new) > self.limit:
                self._forget()
                new = set(units)
            self._add(list(new))
            at = list(map(self.units.__getitem__, units))
        where = np.array(at, np.int64)
        if not np.frombuffer(self.whole, np.int8)[where].all():
            return self._whole(text) or nothing
        length = np.frombuffer(self.length, np.int64)[where]
        ends = np.cumsum(length)
        places = np.repeat(np.frombuffer(self.start, np.int64)[where] - ends + length, length) + np.arange(ends[-1])
        links = np.frombuffer(self.links, np.uint64)[places]
        n_a, n_b = (int(np.frombuffer(x, np.int64)[where].sum()) for x in (self.n_a, self.n_b))
        return n_a, n_b, ";".join(map(self.groups.__getitem__, at)), links

    def _whole(self, text: str) -> tuple[int, int, str, np.ndarray] | None:
        a, b = self.tokens(text)
        found = self.grouped((" " + text).encode(), a, b)
        return found and (len(a), len(b), found[0], np.array(found[1], np.uint64))


def _byte_letters() -> dict[int, str]:
    """How a byte-level vocabulary spells bytes: printable ones as themselves, the others by letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in plain)}


_OPEN: dict[tuple[str, str], Aligner] = {}
common.KEPT["alignment"] = _OPEN.clear


def aligner(a_path: str, b_path: str) -> Aligner:
    """One for each Python worker, kept warm from task to task."""
    common.claim("alignment")
    if (a_path, b_path) not in _OPEN:
        _OPEN[a_path, b_path] = Aligner(a_path, b_path)
    return _OPEN[a_path, b_path]


def align(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, batch, n_a, n_b, n_groups, groups, pairs, times) of each document.

    ``groups`` is ``a1,a2|b1;a3|b2,b3``: ids of both sides in order. ``pairs`` are the distinct linked pairs of the document, ascending, each ``a << 32 | b`` as a
    little-endian unsigned integer of 64 bits; ``times`` says how many links each has, in 32 bits.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    slim = docs.select(F.col(key).alias("key"), common.text_of(text).alias("text"))
    shape = f"key {slim.schema['key'].dataType.simpleString()}, batch long, n_a long, n_b long, n_groups long, groups string, pairs binary, times binary"
    schema = to_arrow_schema(StructType.fromDDL(shape))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, number, size = aligner(a_path, b_path), TaskContext.get().partitionId() << 32, 0
        for part in parts:
            keys, rows, held = [], [], 0
            for key, text in zip(part.column("key").to_pylist(), part.column("text"), strict=True):
                text = text.as_py()
                if size > BATCH_CHARS:
                    number, size = number + 1, 0
                size += len(text) + 16
                n_a, n_b, groups, links = own.align(text)
                pairs, times = np.unique(links, return_counts=True)
                keys.append(key)
                rows.append((number, n_a, n_b, len(links), groups, pairs.astype("<u8").tobytes(), times.astype("<u4").tobytes()))
                held += len(groups)
                if held > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), *(pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)
                    keys, rows, held = [], [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(keys, schema[0].type), *(pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), list(schema)[1:], strict=True))], schema=schema)

    return slim.mapInArrow(run, shape)


def _pairs_of(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(batch, pair, n): the distinct pairs of each batch that a task reads, counted over its documents."""
    number, pairs, times, held = None, [], [], 0

    def summed() -> None:
        nonlocal pairs, times, held
        own, where = np.unique(np.concatenate([np.zeros(0, np.uint64), *pairs]), return_inverse=True)
        pairs, times, held = [own], [np.bincount(where, np.concatenate([np.zeros(0), *times]), minlength=len(own)).astype(np.int64)], len(own)

    def out() -> Iterator[pa.RecordBatch]:
        summed()
        for at in range(0, len(pairs[0]), 50_000):
            some, n = pairs[0][at : at + 50_000].astype(np.int64), times[0][at : at + 50_000]
            yield pa.RecordBatch.from_pydict({"batch": pa.array(np.full(len(some), number, np.int64)), "pair": pa.array(some), "n": pa.array(n)})

    for part in parts:
        for batch, p, t in zip(*(part.column(c).to_pylist() for c in ("batch", "pairs", "times")), strict=True):
            if batch != number:
                if number is not None:
                    yield from out()
                number, pairs, times, held = batch, [], [], 0
            pairs.append(np.frombuffer(p, "<u8"))
            times.append(np.frombuffer(t, "<u4"))
            held += len(pairs[-1])
            if held > 4_000_000 and len(pairs) > 1:
                summed()
    if number is not None:
        yield from out()


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(batch, pair, n) of what ``align`` gives; a batch that several tasks read has several rows for a pair."""
    return aligned.select("batch", "pairs", "times").mapInArrow(_pairs_of, "batch long, pair long, n long")


def link_facts(counts: DataFrame) -> DataFrame:
    """(pair, n, best): links of each pair in the corpus, and whether no other pair with the same B id has more."""
    n = counts.groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)))
    top = n.groupBy("b").agg(F.max("n").alias("most"))
    return n.join(top, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def _judged(kind: pa.DataType):
    schema = pa.schema([("key", kind), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("n_best", pa.int64()), ("count_sum", pa.int64()), ("groups_sha256", pa.string())])

    def run(docs: pa.Table, facts: pa.Table) -> pa.Table:
        pair, n, best = (facts.column(c).to_numpy() for c in ("pair", "n", "best"))
        order = np.argsort(pair)
        pair, n, best = pair[order], n[order], best[order].astype(np.int64)
        n_best, count_sum = [], []
        for p, t in zip(docs.column("pairs").to_pylist(), docs.column("times").to_pylist(), strict=True):
            where, times = np.searchsorted(pair, np.frombuffer(p, "<u8").astype(np.int64)), np.frombuffer(t, "<u4").astype(np.int64)
            n_best.append(int((best[where] * times).sum()))
            count_sum.append(int((n[where] * times).sum()))
        return pa.table([docs.column("key"), docs.column("n_a"), docs.column("n_b"), docs.column("n_groups"), docs.column("n_groups"), pa.array(n_best, pa.int64()), pa.array(count_sum, pa.int64()), docs.column("groups_sha256")], schema=schema)

    return run, schema


def digests(docs: DataFrame, a_path: str, b_path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of each document; every group ends with one link."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark, home = docs.sparkSession, common.shared_dir(docs.sparkSession, "alignment")
    sha = F.when(F.col("n_groups") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise(F.lit(""))
    aligned = common.stored(align(docs, a_path, b_path, key, text).withColumn("groups_sha256", sha).drop("groups"), f"{home}/aligned")
    counts = common.stored(pair_counts(aligned), f"{home}/pairs")
    asked = counts.select("batch", "pair").distinct()
    facts = common.stored(asked.join(link_facts(counts), "pair"), f"{home}/facts")
    kind = aligned.schema["key"].dataType
    run, _ = _judged(to_arrow_type(kind))
    shape = f"key {kind.simpleString()}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return aligned.groupBy("batch").cogroup(facts.groupBy("batch")).applyInArrow(run, shape)


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents of the table, by a byte-level and a piece vocabulary."""
    import public_tokenizers as p

    out = digests(spark.read.parquet(f"{sf_dir}/documents.parquet"), p.path("byte_bpe_50k.json"), p.path("piece_bpe_32k.model"))
    return out.withColumnRenamed("key", "doc_id")
