from __future__ import annotations

import glob

from terravane.sources import ranking_stream, shared


def test_only_rows_across_the_end_of_a_piece_are_put_together(spark, tmp_path):
    base, size, f = shared.shared_base(spark).removeprefix("file://"), 256, 1
    numbers, docs, pairs = [30, f], [], []
    for q, n in enumerate([2, 40, 0, *[3] * 26, 1]):  # the second is longer than several pieces
        numbers.append(n)
        for d in range(n):
            numbers += [d + 0.5, q + 0.25]
            docs.append((q, d, (d + 0.5,), q + 0.25))
        for i in range(n):
            for j in range(n):
                numbers.append(float((i + j) % 2))
                if (i + j) % 2:
                    pairs.append((q, i, j, 1.0))
    for k in range(2):
        own = numbers[:700] if not k else numbers[700:]
        (tmp_path / f"part-{k}").write_text("\n".join(" ".join(map(str, own[i : i + 50])) for i in range(0, len(own), 50)) + "\n")
    before = set(glob.glob(f"{base}/terravane/ranking-*"))
    found, weighed = ranking_stream.read(spark, str(tmp_path), size)
    assert sorted((r["query_id"], r["doc_id"], tuple(r["features"]), r["target"]) for r in found.collect()) == docs
    assert sorted((r["query_id"], r["i"], r["j"], r["w"]) for r in weighed.collect()) == pairs
    (home,) = set(glob.glob(f"{base}/terravane/ranking-*")) - before
    pieces, parts = spark.read.parquet(f"{home}/pieces"), spark.read.parquet(f"{home}/parts")
    assert pieces.count() == -(-700 // size) + -(-(len(numbers) - 700) // size)  # numbers are stored once, a row for a piece
    assert 0 < parts.where("not whole").count() <= 2 * pieces.count()
