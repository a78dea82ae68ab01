from __future__ import annotations

import hashlib
import random
from collections import defaultdict

import pytest
from llm_cases import HARD
from pyspark.sql import functions as F

from terravane.llm import mixing

DOCS = "doc_id long, text string, lang string, source string"


def filled(budget, children):
    """Water filling by repeated rounds; children: name -> (weight, most)."""
    got, live = dict.fromkeys(children, 0.0), {c for c, (w, m) in children.items() if w > 0 and m > 0}
    while live and budget > 1e-9:
        whole = sum(children[c][0] for c in live)
        full = {c for c in live if children[c][1] <= budget * children[c][0] / whole + 1e-12}
        if not full:
            for c in live:
                got[c] = budget * children[c][0] / whole
            return got
        for c in full:
            got[c] = children[c][1]
            budget -= children[c][1]
        live -= full
    return got


def brute(rows, weights, max_epochs, budget=None):
    leaves = defaultdict(list)
    for i, text, lang, source in rows:
        digits = "".join(ch for ch in (source or "") if ch.isdigit())
        leaves[(f"domain{int(digits or 0) // 5}" if source is not None else None, lang, source)].append((i, len((text or "").split())))
    most = {k: sum(n for _, n in v) * float(max_epochs) for k, v in leaves.items()}
    w = lambda level, name: weights.get(level, {}).get(name, 1.0)
    total = sum(most.values()) / max_epochs if budget is None else budget
    share = {(): min(total, sum(most.values()))}
    for depth, level in enumerate(("domain", "lang", "source"), 1):
        for parent in [k for k in share if len(k) == depth - 1]:
            kids = {k[:depth] for k in most if k[: depth - 1] == parent}
            share |= filled(share[parent], {c: (w(level, c[-1]), sum(m for k, m in most.items() if k[:depth] == c)) for c in kids})
    out = {}
    for leaf, docs in leaves.items():
        tokens, own = sum(n for _, n in docs), int(share[leaf] + 1e-6)
        whole = own // tokens if tokens else 0
        rest = own - whole * tokens
        order = sorted(docs, key=lambda d: (hashlib.md5(f"7|{whole}|{d[0]}".encode()).hexdigest(), d[0]))
        upto = 0
        for i, n in order:
            upto += n
            out[i] = (own, whole + int(rest > 0 and upto <= rest))
    return out


@pytest.mark.parametrize("seed,budget,slices", [(1, None, 4096), (2, 500.0, 4), (3, 1e9, 16), (4, 50.0, 1)])
def test_equals_water_filling_by_rounds(spark, seed, budget, slices):
    draw = random.Random(seed)
    rows = [(i, "w " * draw.randint(0, 30), draw.choice(["en", "de", "fr", None]), draw.choice(["src0"] * 6 + ["src1", "src7", "src16", "other"])) for i in range(300)]
    weights = {"domain": {"domain0": 2.0, "domain3": 0.5}, "lang": {"en": 3.0}, "source": {"src0": 2.0}}
    got = {r["key"]: (r["budget"], r["epochs"]) for r in mixing.select(spark.createDataFrame(rows, DOCS), weights, budget, slices=slices).collect()}
    assert got == brute(rows, weights, mixing.MAX_EPOCHS, budget)


def test_shares_meet_the_weights(spark):
    rows = [(i, "w " * 10, "en" if i % 2 else "de", f"src{i % 3}") for i in range(3000)]
    out = mixing.select(spark.createDataFrame(rows, DOCS), {"lang": {"en": 3.0, "de": 1.0}}, 10_000)
    got = {r["lang"]: r["t"] for r in out.groupBy("lang").agg(F.sum(F.col("n_tokens") * F.col("epochs")).alias("t")).collect()}
    assert abs(got["en"] - 7500) <= 60 and abs(got["de"] - 2500) <= 60


def test_a_shortage_goes_to_siblings_first(spark):
    rows = [(0, "w " * 10, "en", "src0"), *[(i, "w " * 100, "en", "src1") for i in range(1, 50)], *[(i, "w " * 100, "de", "src2") for i in range(50, 99)]]
    out = mixing.select(spark.createDataFrame(rows, DOCS), {}, 2000, max_epochs=1)
    budgets = {r["source"]: r["budget"] for r in out.select("source", "budget").distinct().collect()}
    assert budgets == {"src0": 10, "src1": 990, "src2": 1000}


def test_weight_zero_and_no_tokens(spark):
    rows = [(0, "a b", "en", "src0"), (1, "a b", "de", "src1"), (2, None, "fr", "src2")]
    got = {r["key"]: r["epochs"] for r in mixing.select(spark.createDataFrame(rows, DOCS), {"lang": {"de": 0.0}}, max_epochs=1).collect()}
    assert got == {0: 1, 1: 0, 2: 0}
    assert [r["epochs"] for r in mixing.select(spark.createDataFrame([(1, None, None, None)], DOCS), {}).collect()] == [0]


def test_hard_rows_and_an_empty_table(docs_of):
    from pyspark.sql import functions as F

    rows = mixing.select(docs_of(HARD).withColumn("budget", F.lit(1)).withColumn("leaf", F.lit("x")), {}).collect()
    assert len(rows) == len(HARD) and sum(r["n_tokens"] for r in rows) == sum(len([w for w in __import__("re").split("[\\x20\\x09-\\x0D]+", t or "") if w]) for t in HARD)
    assert mixing.select(docs_of([]), {}).collect() == []


def test_repeated_rows_are_told_apart_by_their_row(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "src0")] * 4, DOCS).withColumn("row", F.monotonically_increasing_id())
    out = mixing.select(df, {}, 6, row="row").collect()
    assert sum(r["epochs"] for r in out) == 2 and len({r["row"] for r in out}) == 4
