from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_cases import HARD

from terravane.llm import alignment

tokenizers = pytest.importorskip("tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")
P = pytest.importorskip("public_tokenizers")
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")
ODD = [" ", "  ", "a ", " a", "a  b", "\n\n x", "a\n  b\t\tc", "x\r\ny", "<|endoftext|> <s> </s><unk>", "café   x", "▁a", "日本 語 🙂👍🏽", "'s 't don't I'LL !!'s", "a\n", "\t", "\n", "a \n b", "123 456a7", "é ﬁ", "\x00a", "<0x0A>", "a b", "x" * 5000]


@pytest.fixture(scope="module")
def plain():
    """Groups by definition: token ends of either side, cut where both end."""
    a = tokenizers.Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)
    letters = {chr(i): i for i in [*range(33, 127), *range(161, 173), *range(174, 256)]}
    rest = [i for i in range(256) if i not in letters.values()]
    letters |= {chr(256 + k): i for k, i in enumerate(rest)}

    def piece(i):
        return bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()

    def run(text):
        if not text:
            return [], []
        ids = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
        own = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids[0]], [piece(i) for i in ids[1]]
        if any(b"".join(x) != (" " + text).encode() for x in own):
            return [], []
        ends = [np.cumsum([len(t) for t in x]).tolist() for x in own]
        groups, links, i, j = [], [], 0, 0
        for end in sorted(set(ends[0]) & set(ends[1])):
            n, m = ends[0].index(end) + 1, ends[1].index(end) + 1
            groups.append((ids[0][i:n], ids[1][j:m]))
            links.append((ids[0][n - 1], ids[1][m - 1]))
            i, j = n, m
        return groups, links

    return run


def expected(plain, texts):
    own = [plain(t) for t in texts]
    count = Counter(x for _, links in own for x in links)
    most = defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for groups, links in own:
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        out.append((sum(len(a) for a, _ in groups), sum(len(b) for _, b in groups), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return out


COLUMNS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_every_document_equals_the_definition(spark, sf_dir, docs_of, plain, monkeypatch):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()] + [*HARD, *ODD]
    monkeypatch.setattr(alignment, "BATCH_CHARS", 20_000)
    rows = {r["key"]: tuple(r[c] for c in COLUMNS) for r in alignment.digests(docs_of(texts).repartition(3), A, B).collect()}
    want = expected(plain, texts)
    assert [rows[i] for i in range(len(texts))] == want


def test_a_full_memory_changes_nothing(spark, sf_dir):
    texts = [r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    small, large = alignment.Aligner(A, B, limit=50), alignment.Aligner(A, B)
    for t in [*texts, *ODD, *(x or "" for x in HARD)]:
        x, y, z = small.align(t), large.align(t), (large._whole(t) if t else None) or (0, 0, "", np.zeros(0))
        assert x[:3] == y[:3] == z[:3] and x[3].tolist() == y[3].tolist() == z[3].tolist(), t[:50]


def test_labels_and_their_scan():
    labels = alignment.both_labels(b"@A@@AA", b"@B@B@B")
    assert labels == b"@C@BAC" and alignment.group_sizes(labels) == [(1, 1), (2, 2)]


def test_nulls_repeats_clashing_names_and_empty_tables(spark):
    rows = [(None, "one word", 1, "x"), (4, "one word", 2, "y"), (4, "one word", 3, None), (5, None, 4, "z"), (6, "", 5, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch long, pairs string")
    out = alignment.digests(docs, A, B).collect()
    assert Counter(r["key"] for r in out) == Counter({None: 1, 4: 2, 5: 1, 6: 1})
    assert len({tuple(r)[1:] for r in out if r["key"] in (None, 4)}) == 1
    assert all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "") for r in out if r["key"] in (5, 6))
    assert next(r for r in out if r["key"] == 4)["count_sum"] == 3 * next(r for r in out if r["key"] == 4)["n_links"]
    assert alignment.digests(docs.limit(0), A, B).count() == 0
