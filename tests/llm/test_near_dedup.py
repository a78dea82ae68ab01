from __future__ import annotations

import collections
import math
import random

import numpy as np
import pytest
from llm_cases import HARD

from terravane.llm import near_dedup


def shingles(text):
    words = (text or "").lower().split()
    words += [""] * (5 - len(words)) if words else []
    return collections.Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(texts):
    """Class of every text: components of all pairs at 0.8 or more."""
    sets = [shingles(t) for t in texts]
    df = collections.Counter(k for s in sets for k in s)
    weights = [{k: n * (1 + math.log((len(texts) + 1) / (df[k] + 1)) / math.log(len(texts) + 1)) for k, n in s.items()} for s in sets]
    up = list(range(len(texts)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(weights):
        for j in range(i):
            b = weights[j]
            both = sum(min(w, b[k]) for k, w in a.items() if k in b)
            whole = sum(a.values()) + sum(b.values()) - both
            if whole and both / whole >= 0.8:
                up[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def corpus(seed, n, group, edits):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 6)))
    base = [word() for _ in range(120)]
    texts = [" ".join(word() for _ in range(draw.randint(1, 60))) for _ in range(n)]
    for _ in range(group):
        own = list(base)
        for _ in range(draw.randint(0, edits)):
            own[draw.randrange(len(own))] = word() if draw.random() < 0.4 else base[draw.randrange(5)]
        texts.append(" ".join(own))
    texts += texts[: n // 4]
    draw.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed,n,group,edits", [(1, 60, 60, 3), (2, 10, 150, 6), (3, 100, 5, 1)])
def test_classes_equal_those_of_all_pairs(docs_of, seed, n, group, edits):
    texts = corpus(seed, n, group, edits)
    rows = near_dedup.classes(docs_of(texts).repartition(3)).collect()
    got, want = {r["key"]: r["class_id"] for r in rows}, brute(texts)
    sizes = collections.Counter(want)
    assert [got[i] for i in range(len(texts))] == want
    assert all(r["class_size"] == sizes[r["class_id"]] for r in rows)
    assert collections.Counter(r["class_id"] for r in rows if r["kept"]) == dict.fromkeys(sizes, 1)
    assert all(r["key"] == r["class_id"] for r in rows if r["kept"])


def test_buckets_left_open_are_compared_in_chunks(docs_of, monkeypatch):
    monkeypatch.setattr(near_dedup, "CHUNK", 1000)
    texts = corpus(7, 5, 120, 8)
    got = {r["key"]: r["class_id"] for r in near_dedup.classes(docs_of(texts)).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_hard_rows(docs_of):
    rows = {r["key"]: r for r in near_dedup.classes(docs_of(HARD)).collect()}
    assert len(rows) == len(HARD) and rows[6]["class_id"] == 5 and [rows[i]["class_id"] for i in (0, 1, 2, 3)] == [0, 1, 2, 3]


def test_null_and_repeated_ids(docs_of):
    texts = ["the same five words here"] * 3 + ["another text of six words only"]
    rows = near_dedup.classes(docs_of(texts, [None, 4, 4, None])).collect()
    assert collections.Counter((r["key"], r["class_id"], r["kept"]) for r in rows) == {(None, 4, False): 1, (4, 4, True): 1, (4, 4, False): 1, (None, None, True): 1}


def test_empty_table(docs_of):
    assert near_dedup.classes(docs_of([])).collect() == []


def test_other_columns_do_not_matter(docs_of):
    from pyspark.sql import functions as F

    df = docs_of(["a b c d e f", "a b c d e f"]).withColumns({c: F.lit(1) for c in ("key", "node", "digest", "batch", "bands")})
    assert {r["class_id"] for r in near_dedup.classes(df).collect()} == {0}


def test_packed_counts_come_back():
    low = np.sort(np.random.default_rng(1).choice(1 << 40, 1000, replace=False).astype(np.uint64))
    counts = np.random.default_rng(2).integers(1, 300, 1000)
    a, b = near_dedup.unpack_counts(near_dedup.pack_counts(low, counts))
    assert (a == low).all() and (b == counts).all()
    assert len(near_dedup.unpack_counts(near_dedup.pack_counts(low[:0], counts[:0]))[0]) == 0


def test_samples_agree_as_often_as_weights_do():
    draw = np.random.default_rng(5)
    ids = draw.integers(0, 2**63, 400).astype(np.uint64)
    a, b = draw.uniform(0.5, 5, 400), draw.uniform(0.5, 5, 400)
    b[:250] = a[:250]
    starts, sizes = np.zeros(1, np.int64), np.array([400])
    sampler = near_dedup.Sampler(3000)
    same = (sampler.sample(ids, a, starts, sizes) == sampler.sample(ids, b, starts, sizes)).mean()
    assert abs(same - np.minimum(a, b).sum() / np.maximum(a, b).sum()) < 0.04
