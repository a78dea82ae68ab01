"""Columns beside those that an operator reads change nothing, whatever their names."""

from __future__ import annotations

from collections import Counter

import pytest
from llm_cases import HARD
from pyspark.sql import functions as F

from terravane.llm import bit_search, context_tree, exact_dedup, line_dedup, mixing, near_dedup, packing, pseudonyms, token_store

P = pytest.importorskip("public_tokenizers")
PATH = P.path("word_bpe_49k.json")
NAMES = ["key", "body", "batch", "bucket", "row", "deal", "slice", "digest", "spans", "start", "n", "score", "class_id", "epochs", "ids", "_metadata", "v", "x"]


def crowded(docs):
    return docs.withColumns({c: F.lit(k).cast("string") for k, c in enumerate(NAMES)})


def rows(df):
    return Counter(map(repr, df.collect()))


def stored(docs, home):
    return token_store.write_store(docs, home, PATH, 1)


OPERATORS = {
    "op1": lambda d, _: pseudonyms.pseudonymise(d, b"key"),
    "op2": stored,
    "op3": lambda d, _: packing.pack(d, PATH, 2, 64).drop("sequence_id", "offset"),
    "op4": lambda d, _: exact_dedup.dedup(d),
    "op5": lambda d, _: near_dedup.classes(d),
    "op6": lambda d, _: context_tree.score(d),
    "op7": lambda d, _: mixing.select(d, {}, budget=200.0),
    "op9": lambda d, _: line_dedup.remove_repeats(d),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_other_columns_change_nothing(docs_of, tmp_path, name):
    docs = docs_of([*HARD[:8], *HARD[9:], "one line\nmore of it\nand a third\n" * 3, "mail a.b@example.org now"])
    plain = OPERATORS[name](docs, f"file://{tmp_path}/a")
    assert rows(OPERATORS[name](crowded(docs), f"file://{tmp_path}/b")) == rows(plain)


def test_other_columns_change_no_search(spark):
    made = spark.createDataFrame([(i, [0.1 * i, 0.5 - 0.05 * i]) for i in range(12)], "vec_id long, embedding array<double>")
    found = [rows(bit_search.top_k(q := bit_search.quantised(d, "vec_id", "embedding"), q.where("vec_id % 5 = 0"), 3)) for d in (made, made.withColumns({c: F.lit(1) for c in ("v", "x", "rank", "score", "block")}))]
    assert found[0] == found[1] and found[0]
