from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from llm_cases import HARD
from pyspark.sql import functions as F

from terravane.llm import common, packing, perfect_hash, token_store
from terravane.llm.encoder import WordEncoder

tokenizers = pytest.importorskip("tokenizers")
P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def plain():
    t = tokenizers.Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_the_word_cache_gives_the_library_ids(plain, spark, sf_dir):
    enc = WordEncoder(PATH, limit=500)
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    odd = ["don't I'LL 3rd x-ray's", "<|endoftext|> a<|startoftext|>b", "ÀÉ naïve façade ﬁ ½ ª İstanbul ß", "a\x1cb c d​e", "Ω≈ç√ 1234567 'sx ''", "x" * 3000, "\U0001f600\U0001f600ok"]
    for t in [*texts, *odd, *HARD]:
        assert np.frombuffer(enc.encode(t or ""), "<u4").tolist() == plain(t), t


def check_pieces(rows, texts, plain, window):
    docs, windows = defaultdict(list), defaultdict(list)
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] >= 1
        docs[r["key"]].append((r["start"], ids, r["doc_tokens"]))
        windows[r["sequence_id"]].append((r["offset"], len(ids)))
    for i, text in enumerate(texts):
        whole = plain(text) + [2]
        got = sorted(docs[i])
        assert [x for _, ids, _ in got for x in ids] == whole and {n for *_, n in got} == {len(whole)}
    for pieces in windows.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= window
    return windows


@pytest.mark.parametrize("window", [16, 64, 4096])
def test_every_id_lies_in_one_piece(docs_of, plain, window):
    texts = [*HARD, *("word " * n for n in range(1, 60))]
    rows = packing.pack(docs_of(texts), PATH, 2, window).collect()
    windows = check_pieces(rows, texts, plain, window)
    used = sum(n for p in windows.values() for _, n in p)
    assert len(windows) <= used / window * 1.15 + 3


def test_best_fit_finds_the_tightest_window():
    fit = packing.BestFit(10)
    assert [fit.place(n) for n in (7, 6, 4, 3, 2, 1)] == [(0, 0), (1, 0), (1, 6), (0, 7), (2, 0), (2, 2)]
    rng = np.random.default_rng(0)
    lengths = rng.integers(1, 40, 300).tolist()
    tree, rooms = packing.BestFit(32), []
    for n in (x for x in lengths if x <= 32):
        fits = [r for r in rooms if r >= n]
        want = min(fits) if fits else 32
        if fits:
            rooms.remove(want)
        if want > n:
            rooms.append(want - n)
        assert tree.place(n)[1] == 32 - want


def test_packing_an_empty_table_and_repeated_rows(docs_of):
    assert packing.pack(docs_of([]), PATH, 2).collect() == []
    rows = packing.pack(docs_of(["a b"] * 3, [None, 1, 1]), PATH, 2).collect()
    assert len(rows) == 3 and sorted(r["offset"] for r in rows) == [0, 3, 6]


def test_documents_come_back_by_key(spark, docs_of, plain):
    out = common.shared_dir(spark, "test-store")
    docs = docs_of(HARD)
    buckets = token_store.build_index(token_store.write_store(docs, out, PATH, 1, shard_bytes=1000), out, bucket_keys=4)
    rows = token_store.fetch(docs, "doc_id", out, buckets, PATH).orderBy("key").collect()
    start = 0
    for r, text in zip(rows, HARD, strict=True):
        want = plain(text) + [1]
        assert (r["start"], r["n_tokens"], np.frombuffer(r["ids"], "<u4").tolist()) == (start, len(want), want)
        start += len(want)
    missing = spark.createDataFrame([(99,)], "doc_id long")
    assert token_store.fetch(missing, "doc_id", out, buckets, PATH).count() == 0


def test_a_store_of_repeated_and_null_keys(spark, docs_of):
    out = common.shared_dir(spark, "test-store")
    docs = docs_of(["a", "b", "c", "d"], [None, 2, 2, 1])
    buckets = token_store.build_index(token_store.write_store(docs, out, PATH, 1), out)
    rows = token_store.fetch(docs, "doc_id", out, buckets, PATH).collect()
    assert sorted((str(r["key"]), r["start"]) for r in rows) == [("1", 2), ("2", 4), ("2", 6), ("None", 0)]


def test_an_empty_store(spark, docs_of):
    out = common.shared_dir(spark, "test-store")
    buckets = token_store.build_index(token_store.write_store(docs_of([]), out, PATH, 1), out)
    assert token_store.fetch(docs_of(["x"]), "doc_id", out, buckets, PATH).collect() == []


def test_a_lost_index_file_is_an_error(spark, docs_of):
    out = common.shared_dir(spark, "test-store")
    docs = docs_of(["some", "texts"])
    buckets = token_store.build_index(token_store.write_store(docs, out, PATH, 1), out)
    fs, path = common.open_fs(f"{out}/index-00000.mph")
    fs.delete_file(path)
    with pytest.raises(Exception, match="index-00000"):
        token_store.fetch(docs, "doc_id", out, buckets, PATH).collect()


def test_op2_and_op3_over_the_table(spark, sf_dir, plain):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    start = 0
    for r in token_store.op2_token_store(spark, sf_dir).orderBy("doc_id").collect():
        ids = np.array(plain(texts[r["doc_id"]]) + [1], "<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    pieces = packing.op3_packing(spark, sf_dir).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("d")).collect()
    assert {r["doc_id"]: r["n"] for r in pieces} == {i: len(plain(t)) + 1 for i, t in texts.items()}


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 50_000])
def test_perfect_hash_fills_its_slots(n):
    rng = np.random.default_rng(n)
    h1, h2 = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
    fn = perfect_hash.PerfectHash.build(h1, h2)
    assert sorted(fn.slots(h1, h2).tolist()) == list(range(n))
    assert sum(len(w) for w in [fn.words]) * 64 <= max(6 * n, 2000)
    with pytest.raises(ValueError):
        perfect_hash.PerfectHash.build(np.zeros(2, np.uint64), np.zeros(2, np.uint64))
