from __future__ import annotations

import datetime
import math
import random
import re
import string
import zlib
from collections import Counter

import numpy as np
import pytest
from llm_cases import HARD
from pyspark.sql import functions as F

from terravane.llm import batches, context_tree, pseudonyms, toxicity


def kt(a, b):
    """Krichevsky-Trofimov probability, one decision after the other."""
    out, seen = 0.0, [0, 0]
    for bit, n in ((0, a), (1, b)):
        for _ in range(n):
            out += math.log((seen[bit] + 0.5) / (sum(seen) + 1))
            seen[bit] += 1
    return out


class Brute:
    """Context-tree weighting from its definition, a node at a time."""

    def __init__(self, texts, depth):
        self.depth, self.nodes = depth, {}
        for t in texts:
            for context, prefix, bit in self.steps(t):
                for d in range(depth + 1):
                    self.nodes.setdefault((context[depth - d :], prefix), [0, 0])[bit] += 1

    def steps(self, text):
        data = b"\xff" * self.depth + text + b"\xff"
        for i in range(self.depth, len(data)):
            bits = f"{data[i]:08b}"
            for t in range(8):
                yield data[i - self.depth : i], bits[:t], int(bits[t])

    def weighted(self, context, prefix):
        own = kt(*self.nodes[context, prefix])
        if len(context) == self.depth:
            return own
        below = sum(self.weighted(bytes([c]) + context, prefix) for c in range(256) if (bytes([c]) + context, prefix) in self.nodes)
        return np.logaddexp(own, below) - math.log(2)

    def p(self, context, prefix, bit):
        p = 0.5
        known = False
        for d in range(self.depth, -1, -1):
            own = context[self.depth - d :]
            if (own, prefix) in self.nodes:
                n = self.nodes[own, prefix]
                estimate = (n[bit] + 0.5) / (sum(n) + 1)
                if known:
                    below = sum(self.weighted(bytes([c]) + own, prefix) for c in range(256) if (bytes([c]) + own, prefix) in self.nodes)
                    w = 1 / (1 + math.exp(min(below - kt(*n), 700)))
                    p = w * estimate + (1 - w) * p
                else:
                    p, known = estimate, True
        return p

    def score(self, text):
        return sum(math.log10(self.p(*s)) for s in self.steps(text))


def lower(t):
    return (t or "").encode().lower()


@pytest.mark.parametrize("bucket", [8, context_tree.BUCKET_BYTES])
def test_context_trees_equal_their_definition(docs_of, monkeypatch, bucket):
    monkeypatch.setattr(context_tree, "BUCKET_BYTES", bucket)
    draw = random.Random(3)
    texts = ["".join(draw.choice("ab c") for _ in range(draw.randint(0, 12))) for _ in range(14)] + ["É a", None]
    rows = {r["doc_id"]: r for r in context_tree.score(docs_of(texts).repartition(2)).collect()}
    away = [context_tree.held_out(i) for i in range(len(texts))]
    assert any(away)
    model = Brute([lower(t) for t, x in zip(texts, away, strict=True) if not x], context_tree.DEPTH)
    counts = Counter(w for t, x in zip(texts, away, strict=True) if not x for w in [*re.findall(rb"[^\x20\x09-\x0d]+", lower(t)), None])
    n, v = sum(counts.values()), len(counts)
    for i, t in enumerate(texts):
        r = rows[i]
        tokens = [*re.findall(rb"[^\x20\x09-\x0d]+", lower(t)), None]
        assert r["score"] == pytest.approx(model.score(lower(t)), abs=1e-5), t
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, len(tokens), sum(counts[w] > 0 for w in tokens), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens))


def test_scores_do_not_depend_on_pieces_or_batches(docs_of, spark, sf_dir, monkeypatch):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(40)
    one = {r["doc_id"]: r["score"] for r in context_tree.score(docs).collect()}
    docs2 = docs.repartition(5)
    monkeypatch.setattr(context_tree, "BATCH_BYTES", 5000)
    monkeypatch.setattr(context_tree, "BUCKET_BYTES", 20_000)
    two = {r["doc_id"]: r["score"] for r in context_tree.score(docs2).collect()}
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-3 for k in one)
    keys = [k for part in (1 << 18, 7) for k, _ in [tuple(np.concatenate(x) for x in zip(*context_tree.strings([b"", b"abc", b"x" * 50], part), strict=True))]]
    assert (keys[0] == keys[1]).all() and len(keys[0]) == 1 + 4 + 51


def test_hard_rows_and_empty_tables(docs_of):
    rows = context_tree.score(docs_of(HARD)).collect()
    assert len(rows) == len(HARD) and all(r["score"] < 0 for r in rows) and context_tree.score(docs_of([])).collect() == []
    only = [i for i in range(200) if context_tree.held_out(i)][:2]
    r = context_tree.score(docs_of(["a", ""], only)).collect()
    assert {x["train_tokens"] for x in r} == {0} and all(math.isfinite(x["score"]) for x in r)


def test_the_model_beats_the_words_on_the_table(spark, sf_dir):
    rows = context_tree.op6_context_tree(spark, sf_dir).where("held_out").collect()
    assert sum(r["score"] for r in rows) > 1.6 * sum(r["base_score"] for r in rows)


def auc(scored):
    pos, neg = [s for s, y in scored if y], [s for s, y in scored if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_toxicity_on_held_out_rows(spark):
    path = "/root/testdata/sf0.1"  # the smaller tables hold out a handful of toxic rows
    rows = toxicity.op10_toxicity(spark, path).join(spark.read.parquet(f"{path}/labels.parquet"), "doc_id").where("held_out").collect()
    scored = [(r["score"], r["toxic"]) for r in rows]
    assert auc(scored) > 0.9 and np.mean([(r["predicted"] == r["toxic"]) for r in rows]) > 0.9


def test_toxicity_neighbours_are_exact():
    rng = np.random.default_rng(2)
    index = toxicity.Neighbours(rng.uniform(0.5, 3, 30))
    made = []
    for i in range(300):
        f = np.sort(rng.choice(30, rng.integers(1, 8), replace=False))
        made.append((i, int(rng.integers(0, 2)), f, rng.integers(1, 4, len(f))))
    index.build(made)
    dense = np.zeros((300, 30))
    for k, (_, _, f, n) in enumerate(sorted(made)):
        dense[k, f] = index.weigh(f, n)
    for _ in range(40):
        f = np.sort(rng.choice(30, rng.integers(1, 10), replace=False))
        n = rng.integers(1, 4, len(f))
        q = np.zeros(30)
        q[f] = index.weigh(f, n)
        cos = np.round(dense @ q, 12)
        want = sorted((-c, i) for i, c in enumerate(cos) if c > 0)[:15]
        got = index.nearest(f, n, 15)
        assert [c for c, _ in got] == pytest.approx([-c for c, _ in want]) and len(got) == len(want)


def test_clean_examples_are_neighbours_with_whole_vectors(spark, docs_of):
    texts = [f"river stone {'meadow' if i % 2 else 'harbour'} word{chr(97 + i % 26)} {'vile' if i % 5 == 0 else 'calm'}" for i in range(120)]
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(120)], "doc_id long, toxic int")
    docs = docs_of([*texts, "calm meadow by a river"])
    evidence = toxicity.score(docs, toxicity.fit(docs, labels)).where("key = 120").first()["evidence"]
    assert len(evidence) == toxicity.EVIDENCE and {e["toxic"] for e in evidence} == {0}


def test_scores_from_texts_to_calibration_by_brute_force(spark, docs_of):
    draw = random.Random(8)
    texts = [" ".join(draw.choice(["river", "riverbank", "stone", "harbour", "meadowland", "vile", "calm", f"w{draw.randint(0, 9)}x"]) for _ in range(draw.randint(1, 30))) for _ in range(90)]
    texts += ["", None, texts[0], "unknown"]
    labels = {i: int((texts[i] or "").count("vile") > 2) for i in range(0, 80)}
    docs, table = docs_of(texts), spark.createDataFrame(list(labels.items()), "doc_id long, toxic int")
    model, read = toxicity.fit_and_read(docs, table)
    got = {r["key"]: r for r in toxicity.score(docs, model).collect()}

    counts = [Counter(f for w in (t or "").split() for f in toxicity.features_of(w)) for t in texts]
    train = [i for i in labels if zlib.crc32(str(i).encode()) % 5 != 0]
    known = {f for i in train for f in counts[i]}
    df = Counter(f for c in counts for f in c)
    idf = {f: 1 + math.log((len(texts) + 1) / (df[f] + 1)) for f in known}

    def vector(c):
        w = {f: (1 + math.log(n)) * idf[f] for f, n in c.items() if f in known}
        norm = math.sqrt(sum(x * x for x in w.values()))
        return {f: x / norm for f, x in w.items()}

    vectors = [vector(c) for c in counts]

    k = toxicity.neighbours(sum(labels[i] for i in train))
    assert 3 <= k < toxicity.NEIGHBOURS

    def vote(i, others):  # a text's own label has no vote
        others = [j for j in others if (texts[j] or "") != (texts[i] or "")]
        cos = sorted(((round(sum(x * vectors[j].get(f, 0) for f, x in vectors[i].items()), 7), -j) for j in others), reverse=True)[: max(k, toxicity.EVIDENCE)]
        cos = [(c, -j) for c, j in cos if c > 0]
        return (sum(c for c, j in cos[:k] if labels[j]) / (sum(c for c, _ in cos[:k]) + 0.05), cos) if cos else (0.0, [])

    at, shares = toxicity.monotone(np.round([vote(i, train)[0] for i in train], 6), np.array([labels[i] for i in train]))
    for i in range(len(texts)):
        want, cos = vote(i, train)
        assert got[i]["score"] == pytest.approx(np.interp(want, at, shares), abs=2e-3), texts[i]
        assert [e["cosine"] for e in got[i]["evidence"]] == pytest.approx([c for c, _ in cos][: toxicity.EVIDENCE], abs=1e-6)
    assert {r["key"]: r["score"] for r in toxicity.score_read(read, model).collect()} == {i: r["score"] for i, r in got.items()}


def test_no_row_votes_for_itself(spark, docs_of):
    """Turning the label of one text, of which there are three copies, changes no score of these copies but by the calibration of all."""
    texts = [f"river stone {'meadow' if i % 3 else 'harbour'} word{chr(97 + i % 26)} {'vile' if i % 5 == 0 else 'calm'}" for i in range(130)]
    docs = docs_of([*texts, *["copied text by a river"] * 3, "never labelled river"])
    rows = [(i, int(i % 5 == 0)) for i in range(130)]
    evidence = {}
    for own in (0, 1):
        labels = spark.createDataFrame([*rows, (130, own), (131, own), (132, own)], "doc_id long, toxic int")
        found = {r["key"]: [e["doc_id"] for e in r["evidence"]] for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect()}
        assert all(found[i] and not {130, 131, 132} & set(found[i]) for i in (130, 131, 132))
        assert all(i not in found[i] for i in range(130))
        evidence[own] = found[130]
    assert evidence[0] == evidence[1]


def test_equal_cosines_go_to_smaller_ids(spark, docs_of):
    texts = [f"river stone {'vile' if i % 2 else 'calm'}" for i in range(40)] + ["river stone"]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    model = toxicity.fit(docs_of(texts), labels)
    near = toxicity.score(docs_of(texts), model).where("key = 40").first()["evidence"]
    train = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 0]
    assert len({e["cosine"] for e in near}) == 1 and [e["doc_id"] for e in near] == train[: len(near)]


def test_monotone_fit():
    at, shares = toxicity.monotone(np.array([0.1, 0.2, 0.3, 0.4]), np.array([0, 1, 0, 1]))
    assert (np.diff(shares) > 0).all() and at[0] == 0.1 and at[1] == pytest.approx(0.25)


def test_toxicity_of_hard_rows(spark, docs_of):
    labels = spark.createDataFrame([(i, 0, int(i % 2)) for i in range(len(HARD))] + [(None, 0, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    docs = docs_of(HARD)
    model = toxicity.fit(docs, labels)
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == len(HARD) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert toxicity.score(docs_of([]), toxicity.fit(docs_of([]), labels)).collect() == []
    assert toxicity.keep_clean(docs, model).columns == docs.columns
    none = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r["score"] for r in toxicity.score(docs, none).collect()} == {0.0}


def test_a_stored_index_finds_the_same_neighbours(tmp_path):
    rng = np.random.default_rng(6)
    index = toxicity.Neighbours(rng.uniform(0.5, 3, 40))
    made = [(i * 3, int(i % 4 == 0), np.sort(rng.choice(40, 6, replace=False)), rng.integers(1, 4, 6)) for i in range(200)]
    asked = [r[2:] for r in made[:50]]
    for rows in (made, []):
        index.build(list(rows)).save(f"file://{tmp_path}/{len(rows)}")
        again = toxicity.Neighbours.load(f"file://{tmp_path}/{len(rows)}")
        assert again.nearest_of(asked, 15) == index.nearest_of(asked, 15) and again.ids == index.ids and (again.labels == index.labels).all()


def two_languages(rng, n):
    """Examples of which every other one has features 0 to 19, and the others 20 to 39; each has one of 40 to 59 as well."""
    return [(i, i % 2, np.sort([*(20 * (i % 2) + rng.choice(20, 8, replace=False)), 40 + rng.integers(0, 20)]), rng.integers(1, 4, 9), i // 3) for i in range(n)]


def test_sections_have_full_lists_of_their_own(monkeypatch):
    for name, size in (("BLOCK", 8), ("SECTION", 80), ("STRIP", 2), ("FULL_LISTS", 20), ("TOGETHER", 32)):
        monkeypatch.setattr(toxicity, name, size)
    rng = np.random.default_rng(9)
    made = two_languages(rng, 330)
    index = toxicity.Neighbours(rng.uniform(0.5, 3, 60)).build(list(made))
    assert len(index.example if hasattr(index, "example") else index.postings) < 2 * 330  # under one order of features for all a language would be postings
    dense = np.zeros((330, 60))
    for i, _, f, n, _ in made:
        dense[i, f] = index.weigh(f, n)
    asked = [*two_languages(rng, 60), *made, (0, 0, np.zeros(0, np.int64), np.zeros(0, np.int64), -1)]
    for k in (3, 15, 100, 400):
        for (_, _, f, n, digest), near in zip(asked, index.nearest_others([r[2:] for r in asked], k), strict=True):
            cosines = dense[:, f] @ index.weigh(f, n) if len(f) else np.zeros(330)
            want = sorted((-c, i) for i, c in enumerate(np.round(cosines, 12)) if c > 0 and i // 3 != digest)[:k]
            assert [c for c, _ in near] == pytest.approx([-c for c, _ in want], abs=1e-6)
            assert all(made[index.ids[at]][4] != digest for _, at in near)


def test_copies_of_a_text_do_not_widen_its_search(monkeypatch):
    rng = np.random.default_rng(4)
    f, n = np.arange(9), np.ones(9, np.int64)
    made = [(i, 0, f, n, 7) for i in range(300)] + [(300 + i, 1, np.sort(rng.choice(30, 9, replace=False)), n, 100 + i) for i in range(200)]
    index = toxicity.Neighbours(np.ones(30)).build(list(made))
    asked, best = [], toxicity.Neighbours._best
    monkeypatch.setattr(toxicity.Neighbours, "_best", lambda self, *x: asked.append(x[-1]) or best(self, *x))
    (near,) = index.nearest_others([(f, n, 7)], 15)
    assert asked == [15] and len(near) == 15 and min(index.ids[at] for _, at in near) >= 300


def test_words_bring_their_beginnings():
    texts = ["Riverbank riverbank's stone\u2019s RIVER_bank x", "ΟΔΟΣ οδός. Straße ½ a²b m³ naïve\u00a0ŒUVRE", "İstanbul\x1cunknownword river", "", " 12 _ "]
    names = sorted({f for t in texts[:2] for f in toxicity.features_of(t)} | {"^unkn"})
    reader = toxicity.Reader(names)
    again = toxicity.Reader(names, reader.beginnings)
    for t in texts:
        want = Counter(f for c in t.split() for f in toxicity.features_of(c) if f in reader.number)
        for r in (reader, again):
            features, counts = r.counts(t)
            assert dict(zip((names[i] for i in features), counts.tolist(), strict=True)) == want and (np.diff(features) > 0).all()
    assert reader.beginnings[reader.number["riverbank"]].tolist() == [reader.number["^rive"], reader.number["^riverb"]]


def test_dropping_toxic_rows_keeps_all_columns_and_clashing_names(spark, docs_of):
    texts = [f"river stone {'meadow' if i % 2 else 'harbour'} {'vile rotten' if i % 5 == 0 else 'calm'}" for i in range(150)]
    docs = docs_of([*texts, None, "", texts[0], texts[1], "vile rotten " * 5000], ids=[*range(150), 150, 151, 0, 1, None])
    docs = docs.select("*", F.lit(1).alias("Features"), F.lit("x").alias("_features"), F.lit("y").alias("body"), F.lit(None).cast("int").alias("key"))
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(150)], "doc_id long, toxic int")
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.schema.names == docs.schema.names and kept.dtypes == docs.dtypes
    assert Counter(map(tuple, kept.collect())) == Counter(tuple(r) for r in docs.collect() if "vile" not in (r["text"] or ""))
    assert toxicity.drop_toxic(docs.limit(0), labels).collect() == []
    assert toxicity.drop_toxic(docs, labels.where("toxic = 0")).count() == docs.count()
    bare = docs_of(["", None, " "] * 9)
    assert toxicity.drop_toxic(bare, spark.createDataFrame([(i, 1) for i in range(27)], "doc_id long, toxic int")).count() == 0


VALUES = {
    "card": "4111 1111 1111 1111", "iban": "GB82 WEST 1234 5698 7654 32", "ssn": "123-45-6789", "phone": "+1 (415) 555-2671", "ip": "192.168.10.7", "date": "2024-02-29", "email": "Jane.Doe@example.org", "secret": "0123456789abcdef0123456789abcdef",
}


@pytest.mark.parametrize("kind", sorted(VALUES))
def test_pseudonyms_keep_the_form_and_come_back(kind):
    value = VALUES[kind]
    there, back = pseudonyms.Pseudonyms(b"key"), pseudonyms.Pseudonyms(b"key", forward=False)
    text, spans = there.apply(f"see {value} now")
    assert [s["kind"] for s in spans] == [kind] and text != f"see {value} now"
    shape = lambda s: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "0", s)))
    if kind not in ("secret", "ip"):
        assert shape(text) == shape(f"see {value} now")
    assert back.apply(text)[0] == f"see {value} now"
    assert there.apply(f"{value} and {value}")[0].count(spans[0]["pseudonym"]) == 2 and pseudonyms.Pseudonyms(b"other").apply(value)[0] != there.apply(value)[0]


def there_and_back(values, width=True):
    """Pseudonyms of the values: one for each, undone by the key, of one width with them but for names of months."""
    there, back = pseudonyms.Pseudonyms(b"key"), pseudonyms.Pseudonyms(b"key", forward=False)
    made = [there.apply(v) for v in values]
    assert all(len(spans) == 1 and spans[0]["end"] - spans[0]["start"] == len(v) and (len(v) == len(t) or not width) for (t, spans), v in zip(made, values, strict=True))
    assert len({t for t, _ in made}) == len(set(values)) and [back.apply(t)[0] for t, _ in made] == list(values)
    return [t for t, _ in made]


@pytest.mark.parametrize("form", ["{y}-{m:02d}-{d:02d}", "{d}.{m}.{y}", "{d:02d}.{m:02d}.{y}", "{m}/{d}/{y}", "{m:02d}/{d:02d}/{y}", "{d}/{m}/{y}", "{d:02d}/{m:02d}/{y}", "{n} {d}, {y}", "{d} {n} {y}"])
def test_dates_are_permuted_one_to_one(form):
    import calendar

    days = [(y, m, d) for y in range(2015, 2025) for m in range(1, 13) for d in range(1, calendar.monthrange(y, m)[1] + 1)]
    values = [form.format(y=y, m=m, d=d, n=calendar.month_name[m]) for y, m, d in days]
    there_and_back(values, width="{n}" not in form)


def test_all_slash_dates_together_are_permuted_one_to_one():
    values = {f"{a}/{b}/{y}" for y in (2019, 2020) for a in range(1, 32) for b in range(1, 32) if (a <= 12 or b <= 12) and not (max(a, b) > 28)}
    there_and_back(sorted(values))


def test_other_kinds_are_permuted_one_to_one():
    draw = random.Random(5)
    there_and_back([f"{a:03d}-{draw.randint(1, 99):02d}-{draw.randint(1, 9999):04d}" for a in range(1, 899) if a != 666])
    cards = [f"4{draw.randint(0, 10**14 - 1):014d}" for _ in range(500)]
    there_and_back([c + str(pseudonyms.luhn(c)) for c in cards])
    there_and_back([f"+49 30 {i:07d}" for i in range(1000)])
    there_and_back([f"{draw.getrandbits(128):032x}".replace("0", "a", 1) for _ in range(300)])


def test_names_in_any_script_are_masked():
    values = [f"{first}{i}@mail.ru" for first in ("иван", "user.имя", "Łukasz", "李雷", "müller") for i in range(40)]
    for value, new in zip(values, there_and_back(values), strict=True):
        assert not re.search("иван|имя|Łukasz|李雷|müller", new), value


def test_one_phone_number_has_one_pseudonym():
    names = pseudonyms.Pseudonyms(b"key")
    made = {re.sub(r"\D", "", names.apply(v)[0])[-10:] for v in ("+15551234567", "+1 555 123 4567", "(555) 123-4567", "555.123.4567", "+1-555-123-4567")}
    assert len(made) == 1 and names.apply("+15551234567")[0].startswith("+1") and made != {"5551234567"}


def test_the_query_masks_and_comes_back(spark, sf_dir):
    rows = {r["doc_id"]: r for r in pseudonyms.op1_pseudonyms(spark, sf_dir).collect()}
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    names, back = pseudonyms.Pseudonyms(b"for tests only"), pseudonyms.Pseudonyms(b"for tests only", forward=False)
    assert rows.keys() == texts.keys() and any(r["spans"] for r in rows.values())
    for i, t in texts.items():
        assert t is None or rows[i]["text"] == names.apply(t)[0]
        for s in rows[i]["spans"]:
            value = t[s["start"] : s["end"]]
            assert back.of({"card": "number"}.get(s["kind"], s["kind"]), s["pseudonym"])[1] == value, value


BESIDE = [
    ("iban", "DE89370400440532013000", " IS MINE"), ("iban", "DE89 3704 0044 0532 0130 00", " BIC COBADEFF"), ("iban", "GB82WEST12345698765432", " NOW"), ("card", "4111 1111 1111 1111", " 123"), ("card", "4111 1111 1111 1111", " 12/25"), ("ssn", "123-45-6789", " 12345"),
    ("date", "2020-01-02", " 2021-03-04"), ("date", "2020-01-02", " 123-45-6789"), ("ssn", "123-45-6789", " 987-65-4321"), ("card", "3782 822463 10005", " 7777"), ("iban", "NO9386011117947", " 4111 1111 1111 1111"),
]


@pytest.mark.parametrize(("kind", "value", "behind"), BESIDE)
def test_what_stands_behind_a_value_does_not_hide_it(kind, value, behind):
    names = pseudonyms.Pseudonyms(b"key")
    alone = names.apply(value)[0]
    text, spans = names.apply(f"see {value}{behind}")
    assert alone != value and text.startswith(f"see {alone}") and (spans[0]["kind"], spans[0]["start"], spans[0]["end"]) == (kind, 4, 4 + len(value))


def valid_values(text):
    """Valid values by a detector of its own: whole white-space tokens, or as many as an IBAN or a card has."""
    words, out = text.split(), []
    for i in range(len(words)):
        for n in range(1, 8):
            part = words[i : i + n]
            bare = "".join(part)
            if re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]+", bare) and len(bare) == pseudonyms.IBAN_LENGTHS.get(bare[:2]) and int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1:
                out.append(" ".join(part))
            if [len(p) for p in part] == [4, 4, 4, 4] and bare.isdigit() and sum(int(c) if k % 2 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(bare)) % 10 == 0:
                out.append(" ".join(part))
    for w in words:
        m = re.fullmatch(r"(\d{3})-(\d{2})-(\d{4})", w)
        if m and m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
            out.append(w)
        try:
            out += [w] if re.fullmatch(r"\d{4}-\d{2}-\d{2}", w) and datetime.date.fromisoformat(w).year in range(1900, 2100) else []
        except ValueError:
            pass
    return out


def test_values_side_by_side_leave_nothing_in_clear():
    draw, names = random.Random(12), pseudonyms.Pseudonyms(b"key")

    def iban():
        country = draw.choice(["DE", "FR", "NO", "ES"])
        rest = "".join(draw.choice(string.digits) for _ in range(pseudonyms.IBAN_LENGTHS[country] - 4))
        bare = f"{country}{pseudonyms._iban_check(country, rest):02d}{rest}"
        return bare if draw.random() < 0.5 else " ".join(bare[k : k + 4] for k in range(0, len(bare), 4))

    def card():
        own = "4" + "".join(draw.choice(string.digits) for _ in range(14))
        own += str(pseudonyms.luhn(own))
        return " ".join(own[k : k + 4] for k in range(0, 16, 4))

    kinds = [iban, card, lambda: f"{draw.randint(1, 665):03d}-{draw.randint(1, 99):02d}-{draw.randint(1, 9999):04d}", lambda: f"{draw.randint(1950, 2050)}-{draw.randint(1, 12):02d}-{draw.randint(1, 28):02d}", lambda: draw.choice(["BIC", "word", "IS", "42", "12345", "X1"])]
    missed, total = 0, 0
    for _ in range(400):
        text = " ".join(draw.choice(kinds)() for _ in range(6))
        covered = [(s["start"], s["end"]) for s in names.apply(text)[1]]
        for value in valid_values(text):
            at = text.find(value)
            total += 1
            missed += not any(a < at + len(value) and at < b for a, b in covered)
    assert total > 900 and missed == 0


def test_the_key_is_needed_on_a_cluster():
    class Cluster:
        conf = type("C", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("S", (), {"master": "yarn"})  # noqa: N815

    with pytest.raises(ValueError, match="secret"):
        pseudonyms.op1_pseudonyms(Cluster(), "/nowhere")


@pytest.mark.parametrize("value", ["q" * 5000 + "@example.org", "0a" * 2000, "7f" * 64])
def test_very_long_values_are_permuted_whole(value):
    """Python writes no number of over 4300 digits; both ends of a long value change."""
    names = pseudonyms.Pseudonyms(b"key")
    made, spans = names.apply(value)
    assert len(spans) == 1 and len(made) == len(value) and made[:8] != value[:8]
    assert pseudonyms.Pseudonyms(b"key", forward=False).apply(made)[0] == value


def test_invalid_values_stay():
    text = "4111 1111 1111 1112, 999.1.1.1, 2023-02-30, 000-12-3456, 1234, nothing@"
    assert pseudonyms.Pseudonyms(b"key").apply(text) == (text, [])


@pytest.mark.parametrize("n", [2, 10, 97, 1000, 10**6 + 3])
def test_permutations(n):
    f = pseudonyms.Feistel(b"k")
    some = range(n) if n <= 1000 else random.Random(1).sample(range(n), 500)
    made = [f.permute(x, n, "t") for x in some]
    assert len(set(made)) == len(made) and all(0 <= y < n for y in made) and [f.permute(y, n, "t", False) for y in made] == list(some)


def test_pseudonyms_of_hard_rows(docs_of):
    rows = {r["doc_id"]: r for r in pseudonyms.pseudonymise(docs_of(HARD), b"k").collect()}
    assert rows[0]["text"] is None and rows[1]["text"] == "" and all(rows[i]["text"] == t for i, t in enumerate(HARD))
    assert pseudonyms.pseudonymise(docs_of([]), b"k").collect() == []
