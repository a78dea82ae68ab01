from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import oracle
import pytest
from llm_cases import HARD

from terravane.llm import ranked_search
from terravane.llm import registry

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOW = {c: c + 32 for c in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOW))


def plain_ranking(docs, items, k=10):
    own = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n, length = len(own), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = {}
    for item, text in items:
        rows = []
        for i, c in own:
            m = 100 - 90 + (90 * sum(c.values()) * n) // length
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if s > 0:
                rows.append((-s, i is None, i or 0))
        out[item] = [(-s, None if none else i) for s, none, i in sorted(rows)[:k]]
    return out


def found(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["item_id"], r["rank"])):
        out.setdefault(r["item_id"], []).append((r["score"], r["doc_id"]))
    return out


def test_query_equals_its_sql(spark, sf_dir):
    oracle.check(spark, "op11", registry.QUERIES["op11_ranked_search"], registry.ORACLES["op11_ranked_search"], sf_dir)


@pytest.mark.parametrize("most", [2000, 1 << 25])
def test_ranking_equals_all_scores(spark, docs_of, monkeypatch, most):
    rng = np.random.default_rng(1)
    words = [f"w{int(x)}" for x in rng.zipf(1.3, 40_000) % 500]
    texts, at = [], 0
    for n in rng.integers(1, 120, 600):
        texts.append(" ".join(words[at : at + n]).title())
        at = (at + int(n)) % 39_000
    texts += [*HARD, texts[5], texts[5]]
    items = [(i, t) for i, t in enumerate([*texts[::60], "", "only unknown", "Same words", "é Ж 漢字"])] + [(99, None)]
    monkeypatch.setattr(ranked_search, "SHARD_CHARS", most)
    monkeypatch.setattr(ranked_search.index, "__defaults__", ("doc_id", "text", most))
    docs = docs_of(texts).repartition(3)
    out = ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string"))
    assert out.columns == ["item_id", "rank", "doc_id", "score"]
    want = {i: x for i, x in plain_ranking(list(enumerate(texts)), items).items() if x}
    assert found(out.collect()) == want


def test_null_ids_ties_clashing_names_and_empty_tables(spark):
    rows = [(None, "red apple", 1, "x"), (3, "red apple", 2, "y"), (2, "red apple", 3, "z"), (2, "red apple", 4, "w"), (7, "green", 5, "v")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score long, term string")
    items = spark.createDataFrame([(1, "Red!"), (1, "apple"), (2, "green")], "item_id int, text string")
    got = found(ranked_search.search(docs, items).collect())
    assert [i for _, i in got[1]] == [2, 2, 3, None] and len({s for s, _ in got[1]}) == 1
    assert [i for _, i in got[2]] == [7]
    assert ranked_search.search(docs.limit(0), items).count() == 0
    assert ranked_search.search(docs, items.limit(0)).count() == 0


def test_blocks_are_skipped_and_read_back(monkeypatch):
    rng = np.random.default_rng(2)
    shard = ranked_search.Shard()
    texts = [b" ".join(b"c%d" % (x % 40) for x in rng.zipf(1.2, 60)) + (b" rare common" if i % 997 == 3 else b"") for i in range(6000)]
    for i, t in enumerate(texts):
        shard.add(i, t)
    body = shard.packed(6000, sum(shard.size))
    lists = ranked_search.Lists(body)
    for term in (b"c1", b"c39", b"rare"):
        at = lists.find(term)
        docs = np.concatenate([lists.block(b, b == lists.first[at])[0] for b in range(lists.first[at], lists.ends[at])])
        assert docs.tolist() == [i for i, t in enumerate(texts) if term in t.split()]
    lists = ranked_search.Lists(body)
    lists.search([(b"rare", 9000), (b"common", 9000), *((b"c%d" % i, 5) for i in range(1, 40))], [], 5)
    assert len(lists.open) < len(lists.last) / 2
