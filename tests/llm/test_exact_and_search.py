from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import oracle
import pytest
from llm_cases import HARD

from terravane.llm import bit_search, exact_dedup, registry


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, sf_dir, name):
    oracle.check(spark, name, registry.QUERIES[name], registry.ORACLES[name], sf_dir)


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub("[ \t\n\x0b\x0c\r]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    return {k: (min(v)[3], len(v)) for k, v in groups.items()}


@pytest.mark.parametrize("shard_digests", [1, 3, 1000])
@pytest.mark.parametrize("with_history", [True, False])
def test_winners_with_and_without_history(docs_of, shard_digests, with_history):
    draw = random.Random(1)
    texts = [draw.choice(["a b", "ab", " a  b", "c", "", None, "d" * draw.randint(1, 3)]) for _ in range(60)] + HARD
    rows = list(enumerate(texts))
    new, old = (rows[::2], rows[1::2]) if with_history else (rows, None)
    frame = lambda part: docs_of([t for _, t in part], [i for i, _ in part])
    out = exact_dedup.dedup(frame(new), frame(old) if old else None, shard_digests=shard_digests).collect()
    want = brute_groups(rows)
    assert len(out) == len(rows) and sum(r["kept"] for r in out) == len(want)
    for r in out:
        bare = re.sub("[ \t\n\x0b\x0c\r]", "", texts[r["doc_id"]] or "")
        assert bytes(r["digest"]) == hashlib.sha256(bare.encode()).digest()
        assert (r["keep_id"], r["group_size"], r["kept"]) == (*want[bare], r["doc_id"] == want[bare][0])


def test_null_and_repeated_ids(docs_of):
    out = exact_dedup.dedup(docs_of(["a", "a", "a", "b"], [None, 5, 5, None])).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"], r["kept"]) for r in out) == [("5", "5", 3, False), ("5", "5", 3, True), ("None", "5", 3, False), ("None", "None", 1, True)]
    assert exact_dedup.dedup(docs_of([])).collect() == []


def vectors(spark, rows):
    return bit_search.quantised(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), "vec_id", "embedding")


def brute_top(rows, asked, k):
    out = {}
    for q, x in asked.items():
        scored = sorted(((-int(np.dot(np.floor(256 * np.array(x)).astype(int), np.floor(256 * np.array(y)).astype(int))), i) for i, y in rows if i != q))
        out[q] = [(i, -s) for s, i in scored[:k]]
    return out


@pytest.mark.parametrize("block_rows,query_rows", [(1000, 1000), (7, 3)])
@pytest.mark.parametrize("ties", [False, True])
def test_top_rows_equal_all_inner_products(spark, block_rows, query_rows, ties):
    rng = np.random.default_rng(4)
    values = rng.integers(-2, 3, (80, 5)) / 256 if ties else rng.normal(size=(80, 5))
    rows = [(i, [float(np.float32(v)) for v in x]) for i, x in enumerate(values)]
    df = vectors(spark, rows)
    got = {}
    for r in bit_search.top_k(df, df.where("vec_id % 10 = 0"), 5, block_rows, query_rows).collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["vec_id"], r["score"])
    want = brute_top(rows, {i: x for i, x in rows if i % 10 == 0}, 5)
    assert {q: [v[k] for k in sorted(v)] for q, v in got.items()} == want


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, None), (2, [1.0, None]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (None, [1.0, 1.0]), (5, [0.5]), (5, [0.5]), (6, [])]
    df = vectors(spark, rows)
    assert sorted(r["vec_id"] for r in df.collect()) == [0, 5, 5, 6]
    got = bit_search.top_k(df, df.where("vec_id = 0"), 5).collect()
    assert sorted((r["rank"], r["vec_id"], r["score"]) for r in got) == [(1, 5, 128 * 256), (2, 5, 128 * 256), (3, 6, 0)]
    assert bit_search.top_k(df.limit(0), df.limit(0), 5).collect() == []
