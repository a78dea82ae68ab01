from __future__ import annotations

import random

import pytest
from llm_cases import HARD

from terravane.llm import batches, line_dedup

WHITE = " \t\n\x0b\x0c\r"


def brute(texts):
    """The same rule over all lines at once."""
    first, out = {}, []
    for d, text in enumerate(texts):
        lines = (text or "").split("\n")
        bare = [x.strip(WHITE) for x in lines]
        gone = set()
        for i in range(len(lines) - 2):
            w = tuple(bare[i : i + 3])
            if not any(w):
                continue
            if w not in first:
                first[w] = (d, i)
            else:
                e, j = first[w]
                gone |= {k for k in range(i, i + 3) if e != d or k > j + 2}
        out.append(("\n".join(x for k, x in enumerate(lines) if k not in gone), len(lines), len(gone)))
    return out


def run(docs):
    return {r["key"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.remove_repeats(docs).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_equals_the_rule_over_all_lines(docs_of, seed, monkeypatch):
    monkeypatch.setattr(batches, "BATCH_BYTES", 300)
    draw = random.Random(seed)
    texts = ["\n".join(draw.choice(["a", " a\r", "b", "c", "", "d e f", "x" * 40]) for _ in range(draw.randint(0, 14))) for _ in range(60)]
    got = run(docs_of(texts).repartition(4))
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_a_passage_stays_where_it_was_first(docs_of):
    passage = "one\ntwo\nthree\nfour"
    got = run(docs_of([f"x\n{passage}\ny", passage, f"{passage}\nz\n{passage}"]))
    assert got == {0: (f"x\n{passage}\ny", 6, 0), 1: ("", 4, 4), 2: ("z", 9, 8)}


def test_lines_that_repeat_at_once_stay_three_times(docs_of):
    assert run(docs_of(["\n".join(["a"] * 9)]))[0] == ("a\na\na", 9, 6)


def test_spans(docs_of):
    rows = {r["key"]: r["spans"] for r in line_dedup.remove_repeats(docs_of(["a\nb\nc\nd", "q\na\nb\nc\nd\nr"])).collect()}
    assert [(s["start"], s["end"]) for s in rows[1]] == [(1, 5)] and rows[0] == []


def test_hard_rows(docs_of):
    got = run(docs_of(HARD))
    assert got[0] == ("", 1, 0) and got[9] == ("a line\na line\na line", 50, 47) and [got[i] for i in range(len(HARD))] == brute(HARD)
    assert run(docs_of([])) == {}


def test_null_ids_come_last_and_equal_ids_are_kept_apart(docs_of):
    p = "a\nb\nc"
    rows = line_dedup.remove_repeats(docs_of([p, p, p], [None, 3, 3]).coalesce(1)).collect()
    assert sorted((str(r["key"]), r["n_removed"]) for r in rows) == [("3", 0), ("3", 3), ("None", 3)]
