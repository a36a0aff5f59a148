"""Phrases, caps and filter audits against brute force on small tables."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamella.llm import caps, filter_audit as audit, phrases, vocabulary
from lamella.llm.caps import caps_of, margin_for, near_vectors, words_for
from lamella.llm.filter_audit import clashes, filter_audit, interactions, row_measures, term_matrix
from lamella.llm.phrases import TwoWayIndex, collocations, phrase_counts

DOCS = "doc_id long, text string, lang string, ids int, rank string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def plain_collocations(rows, longest, least, share, top):
    count, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", lower(text or "")):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang or "und"] += len(words)
            for k in range(1, longest + 1):
                count[lang or "und"].update(tuple(words[i : i + k]) for i in range(len(words) - k + 1))
    out = []
    for lang, f in count.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        rows = []
        for p, a in good.items():
            score, _, left, right = min((1_000_000 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            inside = any(len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q))) and 100 * b >= share * a for q, b in good.items())
            if not inside:
                rows.append((-score, -a, " ".join(p).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(rows)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, left, right, total[lang], -score))
    return sorted(out)


@pytest.mark.parametrize(("longest", "top", "shard"), [(3, 2000, 40), (4, 5, 1 << 20), (2, 3, 7)])
def test_collocations_against_brute_force(spark, monkeypatch, longest, top, shard):
    monkeypatch.setattr(phrases, "SHARD", shard)
    draw = random.Random(longest)
    words = ["the", "The", "of", "é", "x\x0by", "naïve", "\x1c", "a", "b", "c"]
    text = lambda n: "".join(draw.choice(words) + draw.choice([" ", "  ", "\t", " ", ". ", ",", "\n"]) for _ in range(n))
    rows = [(i, text(draw.randrange(40)), draw.choice(["en", "de", None, "und"]), 1, "x") for i in range(60)]
    rows += [(7, None, "en", None, None), (None, "of the of the", "en", None, None), (8, "", "fr", None, None), (9, text(3000), "en", None, None)]
    got = collocations(spark.createDataFrame(rows, DOCS).repartition(3), longest=longest, least=4, share=50, top=top)
    assert sorted(map(tuple, got.collect())) == plain_collocations([(r[1], r[2]) for r in rows], longest, 4, 50, top)


def test_collocations_of_nothing_and_in_big_numbers(spark):
    assert collocations(spark.createDataFrame([], DOCS)).count() == 0
    assert collocations(spark.createDataFrame([(1, "a b", "en", 1, "x")], DOCS)).count() == 0
    one = collocations(spark.createDataFrame([(i, "New York", None, 1, "x") for i in range(10)], DOCS)).collect()
    assert [tuple(r) for r in one] == [("und", 1, "new york", 10, 10, 10, 20, 1_000_000)]


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_intervals_of_the_index(depth):
    draw = np.random.default_rng(depth)
    sequence = np.append(draw.integers(0, 4, 300), 0).astype(np.int32)
    every = {length: np.full(1 << 10, 255, dtype=np.uint8) for length in range(2, depth + 1)}
    grown, size = TwoWayIndex(sequence, depth).phrases(np.arange(10), depth, every)
    runs = Counter(tuple(sequence[i : i + depth].tolist()) for i in range(len(sequence) - depth + 1))
    assert dict(zip(map(tuple, grown.tolist()), size.tolist(), strict=True)) == {p: n for p, n in runs.items() if 0 not in p}


def test_longer_phrases_come_from_frequent_parts_only(spark):
    rows = [(1, [1, 2, 3] * 3 + [1, 2], [11, 12, 13])]
    shards = spark.createDataFrame([(s, np.array(q, dtype="<i4").tobytes(), i) for s, q, i in rows], "shard long, sequence binary, ids array<long>")
    got = {tuple(r["ids"]): r["a"] for r in phrase_counts(shards, 3, 3).collect()}
    assert got == {(11, 12): 4, (12, 13): 3, (13, 11): 3, (11, 12, 13): 3, (12, 13, 11): 3, (13, 11, 12): 3}


def test_words_get_one_number_everywhere(spark):
    rows = [(0, "en", ["a", "b"], [1, 2]), (1, "en", ["b", "c"], [3, 1]), (2, "de", ["b"], [9]), (3, "fr", [], [])]
    shards = spark.createDataFrame(rows, "shard long, lang string, words array<string>, uses array<long>")
    known = vocabulary.dictionary(shards, ["lang"], 2)
    number = {(r["lang"], r["word"]): (r["n"], r["id"]) for r in known.collect()}
    assert {k: n for k, (n, _) in number.items()} == {("en", "b"): 5, ("de", "b"): 9} and len({i for _, i in number.values()}) == 2
    ids = {r["shard"]: r["ids"] for r in vocabulary.with_global_ids(shards, known, ["lang"]).collect()}
    assert ids == {0: [0, number["en", "b"][1]], 1: [number["en", "b"][1], 0], 2: [number["de", "b"][1]], 3: []}


VECTORS = "vec_id long, embedding array<float>, label int, node string, n long"


def plain_links(rows, cosine):
    vectors = [None if r[1] is None or r[2] is None or not r[1] or any(x is None or not np.isfinite(x) for x in r[1]) or not any(r[1]) else np.array(r[1], dtype=np.float32).astype(float) for r in rows]
    near = defaultdict(list)
    for i, x in enumerate(vectors):
        for j, y in enumerate(vectors):
            if i != j and x is not None and y is not None and rows[i][2] == rows[j][2] and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= cosine:
                near[i].append(j)
    seen, out = {}, []
    for i in range(len(rows)):
        if i not in seen:
            group, todo = {i}, [i]
            while todo:
                todo = [k for j in todo for k in near[j] if k not in group and not group.add(k)]
            named = [rows[j][0] for j in group if rows[j][0] is not None]
            seen |= {j: min(named, default=None) for j in group}
        out.append((rows[i][0], len(near[i]), seen[i], rows[i][0] is not None and rows[i][0] == seen[i]))
    return sorted(out, key=str)


@pytest.mark.parametrize("cell", [1024, 6])
def test_near_vectors_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(caps, "CELL", cell)
    draw = np.random.default_rng(cell)
    rows = []
    for kind, dims in ((1, 64), (1, 64), (2, 64), (2, 3), (None, 8), (3, 1)):
        for center in draw.standard_normal((6, dims)):
            for spread in (0, 0, 0.05, 0.1, 0.15, 0.2, 0.25, 0.3):
                rows.append((len(rows) if len(rows) % 17 else None, (center * draw.choice([1, 2.5]) + spread * draw.standard_normal(dims)).tolist(), kind, "x", 1))
    chain = [np.cos(0.15 * i) * np.eye(64)[0] + np.sin(0.15 * i) * np.eye(64)[1] for i in range(12)]
    rows += [(1000 + i, v.tolist(), 4, "x", 1) for i, v in enumerate(chain)]
    rows += [(2000, None, 1, "x", 1), (2001, [0.0] * 64, 1, "x", 1), (2002, [float("nan")] * 64, 1, "x", 1), (2003, [], 1, "x", 1), (2003, [1.0, None], 1, "x", 1), (None, [float("inf")], 1, "x", 1), (2004, rows[0][1], None, "x", 1)]
    got = near_vectors(spark.createDataFrame(rows, VECTORS).repartition(3), 0.98).collect()
    assert sorted(map(tuple, got), key=str) == plain_links(rows, 0.98)


def test_near_vectors_of_nothing(spark):
    assert near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    assert [tuple(r) for r in near_vectors(spark.createDataFrame([(5, None, None, "x", 1)], VECTORS)).collect()] == [(5, 0, 5, True)]


@pytest.mark.parametrize("dims", [16, 64, 384])
def test_pairs_at_the_limit_share_caps(dims):
    draw = np.random.default_rng(dims)
    x, z = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in draw.standard_normal((2, 600, dims)))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = 0.98 * x + np.sqrt(1 - 0.98**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    found = []
    for v in (x, y):
        row, cap = caps_of(v, margin_for(dims, 0.98), words_for(5000))
        found.append(set(zip(row.tolist(), cap.tolist(), strict=True)))
    codes = {(r, c % caps.CODES) for r, c in found[0] & found[1]}
    assert len({r for r, _ in codes}) == 600 and len(codes) > 0.99 * 600 * caps.CODES
    strangers = len({r for r, c in {((r + 1) % 600, c) for r, c in found[0]} & found[1]})
    assert strangers < 60


def plain_audit(rows, labels):
    known = {}
    for doc, good, toxic in labels:
        g, t = known.get(doc, (False, False))
        known[doc] = (g or good == 1, t or toxic == 1)
    failed = []
    for doc, text, lang in rows:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words)) + "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + "D" * bool(re.search(r"[#$%&*|]", text))
        fails += "E" * any(d is not None and doc is not None and d < doc and (t or "") == text for d, t, _ in rows)
        failed.append((lang or "", fails, *known.get(doc, (False, False))))
    out = []
    for part in {f[0] for f in failed}:
        own = [f[1:] for f in failed if f[0] == part]
        lines, total = [], Counter()
        for order in map("".join, permutations("ABCDE")):
            for step in range(1, 6):
                letter, before = order[step - 1], order[: step - 1]
                fresh = [f for f in own if letter in f[0] and not set(before) & set(f[0])]
                kept = sum(not set(order[:step]) & set(f[0]) for f in own)
                redundant = sum(letter in f[0] for f in own) - len(fresh)
                lines.append((part, order, step, kept, len(fresh), redundant, sum(f[0] == letter for f in own), sum(f[1] for f in fresh), sum(f[2] for f in fresh)))
                total[letter] += len(fresh)
        out += [(*line, total[line[1][line[2] - 1]]) for line in lines]
    return sorted(out)


def test_filter_audit_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(audit, "SHARD", 300)
    draw = random.Random(5)
    text = lambda: " ".join(draw.choice(["Word", "word", "é", "a#b", "x\x1cy"]) if draw.random() < 0.4 else str(draw.randrange(10**6)) for _ in range(draw.choice([5, 99, 100, 130])))
    rows = [(i, text(), draw.choice(["en", "de"])) for i in range(40)]
    rows += [(100 + i, draw.choice(rows)[1], draw.choice(["en", None, ""])) for i in range(20)]
    rows += [(3, rows[3][1], "en"), (None, rows[0][1], "en"), (200, None, "en"), (201, "", None), (202, "A" * 50_000, "fr"), (203, " \t\n", "fr")]
    labels = [(d, draw.choice([0, 1, None]), draw.choice([0, 1])) for d in [*range(0, 120, 2), 3, 3, 200, 999]]
    docs = spark.createDataFrame([(d, t, g, 1, "x") for d, t, g in rows], "doc_id long, text string, lang string, fails int, n_words string").repartition(3)
    got = filter_audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    assert sorted(map(tuple, got.collect())) == plain_audit(rows, labels)
    assert filter_audit(docs.where("false"), spark.createDataFrame([], "doc_id long, quality int, toxic int")).count() == 0


def test_term_matrix(spark):
    docs = spark.createDataFrame([(1, "a b a"), (2, None), (3, "b\x0bc c c")], "doc_id long, text string")
    cells = Counter()
    for r in term_matrix(docs, ["doc_id"]).collect():
        indptr, indices, counts = (np.frombuffer(r[n], dtype=t) for n, t in (("indptr", np.int64), ("indices", np.int64), ("counts", np.int32)))
        for i, row in enumerate(r["rows"]):
            cells.update({(row["doc_id"], int(indices[j])): int(counts[j]) for j in range(indptr[i], indptr[i + 1])})
    number = {r["word"]: r["id"] for r in audit.word_numbers(docs).collect()}
    assert cells == Counter({(1, number["a"]): 2, (1, number["b"]): 1, (3, number["b"]): 1, (3, number["c"]): 3})
    assert sorted(map(tuple, row_measures(term_matrix(docs, ["doc_id"])).collect())) == [(1, 3, 2), (2, 0, 0), (3, 4, 2)]


def test_words_with_one_number_are_told_apart(spark):
    numbers = spark.createDataFrame([("a", 5), ("b", 5), ("c", 5), ("d", 0), ("e", 7)], "word string, id long")
    other = clashes(numbers)
    assert set(other) == {b"b", b"c"} and len({*other.values(), 5, 0, 7}) == 5


def test_orders_of_fewer_filters(spark):
    failed = spark.createDataFrame([("x", "A"), ("x", "AB"), ("x", ""), ("y", "B")], "part string, fails string")
    got = {tuple(r)[:8] for r in interactions(failed, "part", {"n": F.lit(True)}, "AB").select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "shapley").collect()}
    assert got == {("x", "AB", 1, 1, 2, 0, 1, 3), ("x", "AB", 2, 1, 0, 1, 0, 1), ("x", "BA", 1, 2, 1, 0, 0, 1), ("x", "BA", 2, 1, 1, 1, 1, 3), ("y", "AB", 1, 1, 0, 0, 0, 0), ("y", "AB", 2, 0, 1, 0, 1, 2), ("y", "BA", 1, 0, 1, 0, 1, 2), ("y", "BA", 2, 0, 0, 0, 0, 0)}
