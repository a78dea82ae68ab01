from __future__ import annotations

import random

import pytest

from terravane.sources import readers


def made(draw, queries, features):
    """Numbers of a file, and what they say."""
    numbers, docs, pairs = [queries, features], [], []
    for q in range(queries):
        n = draw.choice([0, 1, 1, 2, 3, 5])
        numbers.append(n)
        for d in range(n):
            own = [draw.choice([0.0, 1.0, 2.0, 3.0, -1.5, 0.25]) for _ in range(features + 1)]  # whole numbers may look like the beginning of a query
            numbers += own
            docs.append((q, d, tuple(own[:-1]), own[-1]))
        for i in range(n):
            for j in range(n):
                w = draw.choice([0.0, 0.0, 1.0, 2.5])
                numbers.append(w)
                if w:
                    pairs.append((q, i, j, w))
    return numbers, docs, pairs


@pytest.mark.parametrize(("piece", "seed", "features"), [(3, 1, 2), (16, 2, 0), (64, 3, 5), (1 << 20, 4, 3)])
def test_a_file_in_pieces_is_read_as_a_whole(spark, tmp_path, piece, seed, features):
    draw = random.Random(seed)
    numbers, docs, pairs = made(draw, 25, features)
    for k in range(2):  # two files, cut and broken anywhere
        own = numbers[: len(numbers) // 3] if not k else numbers[len(numbers) // 3 :]
        (tmp_path / f"part-{k}").write_text("".join(f"{x}{draw.choice([' ', '  ', chr(10), chr(10) * 2, chr(9)])}" for x in own))
    found, weighed = readers.read_ranking_queries(spark, str(tmp_path), piece)
    assert sorted((r["query_id"], r["doc_id"], tuple(r["features"]), r["target"]) for r in found.collect()) == docs
    assert sorted((r["query_id"], r["i"], r["j"], r["w"]) for r in weighed.collect()) == pairs


def test_no_queries_and_no_numbers(spark, tmp_path):
    for k, text in enumerate(("0 4\n", "", "\n\n")):
        (tmp_path / str(k)).write_text(text)
        docs, pairs = readers.read_ranking_queries(spark, str(tmp_path / str(k)))
        assert docs.count() == 0 and pairs.count() == 0
    (tmp_path / "bad").write_text("1 1\n1 x 0\n0\n")
    with pytest.raises(Exception, match="(?i)cast"):
        readers.read_ranking_queries(spark, str(tmp_path / "bad"))[0].collect()
