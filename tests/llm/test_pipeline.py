from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pytest
from llm_cases import HARD
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from terravane.llm import mixing, toxicity

WHITE = "[ \t\n\x0b\x0c\r]"


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    """The documents before and after each stage."""
    home = tmp_path_factory.mktemp("stages")
    out = [spark.read.parquet(f"{sf_dir}/documents.parquet")]
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, out[-1], sf_dir).write.parquet(f"{home}/{k}")
        out.append(spark.read.parquet(f"{home}/{k}"))
    return out


def rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_all_but_the_last_return_the_columns_of_documents(stages):
    assert all(d.schema.names == stages[0].schema.names and d.dtypes == stages[0].dtypes for d in stages[:5])


def test_toxic_documents_go_and_no_others(spark, sf_dir, stages):
    model = toxicity.fit(stages[0], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    bad = {r["key"] for r in toxicity.score(stages[0], model).where("predicted = 1").collect()}
    assert rows(stages[1]) == Counter({r: n for r, n in rows(stages[0]).items() if r[0] not in bad}) and bad


def test_one_of_equal_texts_stays(stages):
    best = {}
    for r in stages[1].collect():
        key = re.sub(WHITE, "", r["text"] or "")
        best[key] = min(best.get(key, (1, 0, None)), (-len(r["text"] or ""), r["doc_id"], tuple(r)))
    assert rows(stages[2]) == Counter(v[2] for v in best.values())


def test_one_of_each_class_stays(stages):
    from test_near_dedup import brute

    docs = sorted(map(tuple, stages[2].collect()))
    of = brute([d[1] for d in docs])
    assert rows(stages[3]) == Counter(docs[i] for i in set(of))


def test_documents_are_taken_as_often_as_planned(stages):
    from test_mixing import brute

    docs = stages[3].collect()
    want = brute([(r["doc_id"], r["text"], r["lang"], r["source"]) for r in docs], mixing.TARGETS, mixing.MAX_EPOCHS)
    assert rows(stages[4]) == Counter({tuple(r): want[r["doc_id"]][1] for r in docs if want[r["doc_id"]][1]})


def test_windows_hold_every_taken_document(stages):
    tokenizers = pytest.importorskip("tokenizers")
    import public_tokenizers

    t = tokenizers.Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter(r["doc_id"] for r in stages[4].collect())
    texts = {r["doc_id"]: r["text"] for r in stages[4].collect()}
    got = stages[5].groupBy("doc_id").agg(F.sum("length").alias("n"), F.count_if(F.col("start") == 0).alias("times")).collect()
    assert {r["doc_id"]: (r["n"], r["times"]) for r in got} == {i: (n * (len(t.encode(texts[i] or "", add_special_tokens=False).ids) + 1), n) for i, n in want.items()}
    ends = stages[5].groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).collect()
    assert all(r["n"] == r["end"] <= 4096 for r in ends)
    assert all(np.frombuffer(r["ids"], "<u4").size == r["length"] for r in stages[5].limit(20).collect())


def test_run_is_the_stages_one_after_another(spark, sf_dir, stages):
    out = pipeline.run(spark, sf_dir)
    assert out.columns == stages[5].columns and out.agg(F.sum("length")).first()[0] == stages[5].agg(F.sum("length")).first()[0]


def test_hard_and_repeated_rows_with_clashing_columns(spark, sf_dir, docs_of):
    docs = docs_of([*HARD, "x y z", "x y z"], [*range(len(HARD)), 77, 77]).withColumns({c: F.lit(1) for c in ("key", "row", "epochs", "node", "kept")})
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir)
        assert "key" in docs.columns and docs.count() > 0
    assert docs.where("doc_id = 77").groupBy("doc_id").count().count() <= 1
    empty = docs_of([])
    for _, stage in pipeline.STAGES:
        empty = stage(spark, empty, sf_dir)
        assert empty.count() == 0
