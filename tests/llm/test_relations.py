"""Operators that bring documents together, against brute force on small tables."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from lamella.llm.common import connected_components, only, without, words
from lamella.llm.decontaminate import contaminated, local_score, with_leak_score, word_hashes
from lamella.llm.mixing import mixed, schedule, tempered, whole_parts
from lamella.llm.passages import compact_windows, compact_windows_with_ties, likeness, repeated_passages
from lamella.llm.simhash import grid_of, near_copies, near_groups
from lamella.llm.url_filter import url_filter
from lamella.llm import common, passages, simhash
from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string"


class Sets(dict):
    def find(self, x):
        self.setdefault(x, x)
        while self[x] != x:
            x = self[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self[max(a, b)] = min(a, b)


def plain_fingerprint(text, width):
    tokens = [w for w in re.split(r"[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    runs = [" ".join(tokens[i : i + width]) for i in range(max(1, len(tokens) - width + 1))] if tokens else []
    hashes = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if runs else 0


def corpus(seed, n=120):
    draw = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    out = []
    for i in range(n):
        if i and draw.random() < 0.5:
            tokens = out[draw.randrange(len(out))].split()
            for _ in range(draw.randint(0, 3)):
                if tokens:
                    tokens[draw.randrange(len(tokens))] = draw.choice(vocabulary)
            out.append(" ".join(tokens))
        else:
            out.append(" ".join(draw.choice(vocabulary) for _ in range(draw.choice((0, 1, 3, 40, 150)))))
    return list(enumerate(out))


def test_words_are_split_like_bytes():
    draw = random.Random(1)
    for _ in range(100):
        data = "".join(draw.choice("ab\t\n é\x0b\x1c\xa0") for _ in range(draw.randint(0, 30))).encode()
        hashes, starts, ends = words(data)
        assert [data[a:b] for a, b in zip(starts, ends)] == data.split()
        assert len(set(zip(hashes.tolist(), data.split()))) == len(set(data.split()))


def test_components(spark):
    draw = random.Random(2)
    edges = [(draw.randint(0, 150), draw.randint(0, 150)) for _ in range(110)] + [(5, 5), (None, 3)] + [(i, i + 1) for i in range(1000, 1060)]
    sets = Sets()
    for a, b in edges:
        if a is not None and a != b:
            sets.join(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == {x: sets.find(x) for x in list(sets)}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


@pytest.mark.parametrize("cell", [4096, 8])
def test_near_groups_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    docs = corpus(3) + [(900, None), (901, ""), (902, "One\tTwo"), (902, "One\tTwo")]
    prints = {i: plain_fingerprint(t or "", 4) for i, t in docs}
    sets = Sets()
    for a in prints:
        for b in prints:
            if bin(prints[a] ^ prints[b]).count("1") <= 4:
                sets.join(a, b)
    got = near_groups(spark.createDataFrame(docs, SCHEMA), width=4).collect()
    assert len(got) == len(docs)
    for r in got:
        assert int.from_bytes(r.fp, "big") == prints[r.doc_id]
        assert r.component_id == sets.find(r.doc_id)


def test_near_groups_edges(spark):
    assert near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    got = {(r.doc_id, r.component_id) for r in near_groups(spark.createDataFrame([(None, "a b c"), (4, "a b c"), (None, "alone")], SCHEMA)).collect()}
    assert got == {(None, 4), (4, 4), (None, None)}


@pytest.mark.parametrize("n", [10, 10**5, 10**8])
def test_grid_finds_every_link(n):
    draw = np.random.default_rng(4)
    parts = grid_of(n, 4)
    for _ in range(300):
        a = draw.integers(0, 2, 64)
        b = a.copy()
        b[draw.choice(64, 4, replace=False)] ^= 1
        ca, cb = (x.reshape(-1, 2).sum(axis=1) for x in (a, b))
        assert any((ca[p] == cb[p]).all() for p in parts)


def plain_copies(docs):
    """(id, smallest id) of what chains of Jaccard likenesses of 0.8 connect, by all pairs."""
    sets, grams = Sets(), {}
    for i, t in docs:
        if i is not None:
            tokens = (t or "").lower().split()
            grams.setdefault(i, []).append({tuple(tokens[k : k + 5]) for k in range(max(1, len(tokens) - 4))} if tokens else set())
    for a in grams:
        for b in grams:
            if a < b and any(x == y or len(x & y) >= 0.8 * len(x | y) for x in grams[a] for y in grams[b]):
                sets.join(a, b)
    return {(i, sets.find(i)) for i in grams if sets.find(i) != i}


@pytest.mark.parametrize("cell", [4096, 8])
def test_near_copies_against_brute_force(spark, monkeypatch, cell):
    monkeypatch.setattr(simhash, "CELL", cell)
    monkeypatch.setattr(common, "CROWD", 3 if cell == 8 else 64)
    docs = corpus(5) + [(900, None), (901, ""), (None, "w1 w2"), (902, "w1 w2"), (903, "W1\tw2"), (903, "other words"), (904, "other words")]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], SCHEMA + ", same int, node int")
    assert {tuple(r) for r in near_copies(frame).collect()} == plain_copies(docs)
    assert near_copies(frame.limit(0)).count() == 0


def variants(draw, n, size, edits, common=()):
    base, out = [f"w{draw.randrange(5000)}" for _ in range(size)], []
    for d in range(n):
        copy = list(base)
        for _ in range(draw.randint(*edits)):
            copy[draw.randrange(size)] = f"edit{draw.randrange(100000)}"
        out.append(" ".join([*copy, *common]))
    return out


def test_near_copies_in_crowds(spark):
    """Groups of variants with sparse links, and a passage that very many documents share."""
    draw = random.Random(14)
    passage = [f"p{i}" for i in range(60)]
    texts = variants(draw, 200, 200, (3, 5)) + variants(draw, 200, 120, (2, 3)) + [" ".join([*passage, *(f"w{draw.randrange(5000)}" for _ in range(draw.randint(0, 200)))]) for _ in range(200)]
    draw.shuffle(texts)
    docs = list(enumerate(texts))
    want = plain_copies(docs)
    assert want and {tuple(r) for r in near_copies(spark.createDataFrame(docs, SCHEMA)).collect()} == want


def test_without_keeps_all_other_rows(spark):
    docs, ids = spark.range(5000).selectExpr("if(id % 7 = 0, null, id % 900) as doc_id", "id as n"), spark.range(0, 900, 3).withColumnRenamed("id", "doc_id")
    got = {r.n for r in without(docs, ids).collect()}
    assert got == {i for i in range(5000) if i % 7 == 0 or i % 900 % 3}
    assert {r.n for r in only(docs, ids).join(ids, "doc_id").collect()} == set(range(5000)) - got
    assert without(docs, ids.limit(0)).count() == 5000 and only(docs, ids.limit(0)).count() == 0


def test_contaminated_finds_edited_copies(spark):
    draw = random.Random(6)
    vocabulary = [f"w{i}" for i in range(500)]
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(30))) for i in range(20)] + [(50, None), (51, ""), (52, "???")]
    docs, want = [], set()
    for d in range(60):
        text = [draw.choice(vocabulary) for _ in range(draw.choice((5, 200)))]
        if d % 3 == 0:
            i, item = items[draw.randrange(20)]
            copy = item.upper().split()
            for _ in range(d % 4):
                copy[draw.randrange(30)] = "edit,"
            text[3:3] = copy
            want.add((d, i))
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, "")]
    frame, asked = spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")
    for block in (8_000_000, 1500):
        got = {(r.doc_id, r.item_id) for r in contaminated(frame, asked, block_chars=block).collect()}
        assert got == want
    kept = {r.doc_id for r in with_leak_score(frame, asked, block_chars=1500).where("leak_score = 0").collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}
    assert contaminated(frame, asked.limit(0)).count() == 0 and contaminated(frame.limit(0), asked).count() == 0
    assert with_leak_score(frame, asked.limit(0)).count() == len(docs)


def plain_score(x, y):
    table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
    for i in range(1, len(x) + 1):
        for j in range(1, len(y) + 1):
            table[i][j] = max(0, table[i - 1][j - 1] + (2 if x[i - 1] == y[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
    return max(map(max, table)) / (2 * len(x))


def test_contaminated_against_all_alignments(spark):
    """Copies edited every so many words, against the alignment of every item with every text."""
    draw = random.Random(17)
    vocabulary = [f"w{i}" for i in range(800)] + ["the", "of"] * 40
    items = [(i, " ".join(draw.choice(vocabulary) for _ in range(draw.choice((12, 20, 40))))) for i in range(25)]
    docs = []
    for d in range(150):
        text = [draw.choice(vocabulary) for _ in range(draw.choice((20, 120)))]
        copy = items[draw.randrange(25)][1].split()
        every = draw.choice((0, 2, 3, 4, 6))
        if every:
            how = draw.choice(("replace", "insert", "delete"))
            copy = [x for n, w in enumerate(copy) for x in ([w] if n % every else {"replace": ["edit"], "insert": ["new", w], "delete": []}[how])]
            text[7:7] = copy
        docs.append((d, " ".join(text)))
    want = {(d, i): score for d, t in docs for i, x in items if (score := plain_score(x.split(), t.split())) >= 0.5}
    got = {(r.doc_id, r.item_id): r.score for r in contaminated(spark.createDataFrame(docs, SCHEMA), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) <= set(want) and all(got[k] == pytest.approx(want[k]) for k in got)
    assert len(want) > 80 and len(got) >= 0.95 * len(want)


def test_contaminated_short_items_and_clashes(spark):
    items = spark.createDataFrame([(1, "what is love"), (2, "yes"), (3, "a b c d"), (None, "yes")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Oh, WHAT is love?", 1), (2, "what is it, love", 2), (3, "x a b c d", 3), (4, "yes", 4), (None, "no, yes: yes", 5)], SCHEMA + ", item_id int")
    got = {(r.doc_id, r.item_id, r.score, r.first_word, r.end_word) for r in contaminated(docs, items).collect()}
    assert got == {(1, 1, 1.0, 1, 4), (3, 3, 1.0, 1, 5), (4, 2, 1.0, 0, 1), (4, None, 1.0, 0, 1), (None, 2, 1.0, 1, 2), (None, None, 1.0, 1, 2)}
    scored = with_leak_score(docs, items)
    assert scored.columns == ["doc_id", "text", "item_id", "leak_score"] and {r.item_id for r in scored.where("leak_score > 0").collect()} == {1, 3, 4, 5}


def test_local_score_against_table():
    draw = random.Random(7)
    for _ in range(60):
        a, b = (" ".join(draw.choice("abc") for _ in range(draw.randint(0, 12))) for _ in range(2))
        x, y = a.split(), b.split()
        table = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(1, len(x) + 1):
            for j in range(1, len(y) + 1):
                table[i][j] = max(0, table[i - 1][j - 1] + (2 if x[i - 1] == y[j - 1] else -1), table[i - 1][j] - 1, table[i][j - 1] - 1)
        assert local_score(word_hashes(a), word_hashes(b)) == max(map(max, table))


def test_schedule_stays_within_a_block():
    draw = random.Random(8)
    for _ in range(150):
        weights = {str(i): draw.choice([draw.random() ** 3 + 1e-3, 1.0, 0.5, 2.0**0.5]) for i in range(draw.randint(1, 25))}
        parts, top = whole_parts(weights)
        done = Counter()
        for n, (s, slot) in enumerate(schedule(parts, top, dict.fromkeys(parts, 1200))):
            if n == 1200:
                break
            done[s] += 1
            assert slot == n and all(abs(done[x] - (slot + 1) * p / top) < 1 for x, p in parts.items())


def test_mixed(spark):
    docs = [(i, "big" if i % 3 else "small", "x") for i in range(300)] + [(1000, None, "x"), (1001, "unknown", "x"), (7, "big", "x")]
    frame = spark.createDataFrame(docs, "doc_id long, source string, slot string")
    got = mixed(frame, {"big": 3, "small": 1}, block_rows=10, buckets=5).collect()
    assert len(got) == len(docs)
    placed = sorted((r.slot, r.place, r.source) for r in got if r.slot is not None)
    assert len(placed) == 301 and len({p[:2] for p in placed}) == 301
    assert {r.doc_id for r in got if r.slot is None} == {1000, 1001}
    last = min(max(s for s, _, x in placed if x == y) for y in ("small", "big"))
    for end in range(1, last):
        taken = Counter(x for s, p, x in placed if s < end and p == 0)
        assert abs(taken["big"] - end * 0.75) < 1 and abs(taken["small"] - end * 0.25) < 1
    assert mixed(frame.limit(0), {"big": 1.0}).count() == 0
    assert tempered(frame.where("source = 'big'")) == {"big": pytest.approx(201**0.5)}


@pytest.mark.parametrize("weights", [{"big": 0.9, "small": 0.1}, {"big": 2**0.5, "small": 1.0}])
def test_mixed_keeps_to_exact_weights(spark, weights):
    docs = spark.range(6000).selectExpr("id as doc_id", "if(id % 5 < 4, 'big', 'small') as source")
    got = mixed(docs, weights, block_rows=1).orderBy("slot").collect()
    assert len({r.slot for r in got}) == 6000
    last = min(max(r.slot for r in got if r.source == s) for s in weights)
    done, total = Counter(), sum(weights.values())
    for r in got:
        if r.slot <= last:
            done[r.source] += 1
            assert all(abs(done[s] - (r.slot + 1) * w / total) < 1 for s, w in weights.items())


def test_mixed_with_many_sources_or_none(spark):
    many = spark.range(4400).selectExpr("id as doc_id", "if(id < 2200, 'hot', concat('s', id % 1100)) as source")
    got = mixed(many, tempered(many), block_rows=1).collect()
    assert len({r.slot for r in got}) == 4400
    assert max(sum(r.slot < n for r in got if r.source == "hot") - n * 2200**0.5 / (2200**0.5 + 1100 * 2**0.5) for n in range(1, 1500, 10)) < 1
    none = spark.createDataFrame([(1, None), (2, None)], "doc_id long, source string")
    assert [r.slot for r in mixed(none, tempered(none)).collect()] == [None, None]
    assert mixed(none.limit(0), tempered(none.limit(0))).count() == 0
    empty = none.limit(0).withColumn("n", F.lit(1))
    assert mixed(empty, {"a": 1.0}).count() == 0


def test_mixed_keeps_rows_without_ids_and_clashing_columns(spark):
    docs = spark.range(2000).selectExpr("if(id % 3 = 0, null, id % 700) as doc_id", "if(id % 3 = 0, 'hot', 'b') as source", "id as name", "id as plan", "id as i")
    got = mixed(docs, {"hot": 1.0, "b": 3.0, "absent": 1.0}, block_rows=4).collect()
    assert len(got) == 2000 and {r.name for r in got} == {r.plan for r in got} == set(range(2000))
    assert len({(r.slot, r.place) for r in got}) == 2000
    for s, w in (("hot", 0.2), ("b", 0.6)):
        blocks = {r.block: r.slot for r in got if r.source == s}
        assert len(blocks) == -(-sum(r.source == s for r in got) // 4)
        assert all(int(k / w - 1e-9) <= slot < (k + 1) / w + 1 for k, slot in blocks.items())


def plain_windows(h, least):
    out = set()
    for i in range(len(h)):
        for j in range(i + least, len(h) + 1):
            place = i + int(np.argmin(h[i:j]))
            out.add((i, j, place))
    return out


@pytest.mark.parametrize("search", [compact_windows, compact_windows_with_ties])
def test_compact_windows_cover_each_run_once(search):
    draw = np.random.default_rng(9)
    for _ in range(60):
        h, least = draw.integers(0, 12, draw.integers(0, 25)).astype(np.uint64), int(draw.integers(1, 6))
        covered = [(i, j, place) for low, place, high in search(h, least) for i in range(low, place + 1) for j in range(max(place + 1, i + least), high + 1)]
        assert len(covered) == len(set(covered))
        assert set(covered) == plain_windows(h, least)


def test_repeated_passages(spark):
    draw = random.Random(10)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = [draw.choice(vocabulary) for _ in range(70)]
    docs = []
    for d in range(40):
        text = [draw.choice(vocabulary) for _ in range(draw.choice((10, 100, 400)))]
        if d % 4 == 0:
            copy = list(passage)
            if d % 8 == 0 and d:
                copy[35] = "edited"
            at = draw.randrange(len(text))
            text[at:at] = copy
        docs.append((d, " ".join(text)))
    docs += [(100, None), (101, ""), (None, " ".join(passage)), (102, " ".join(passage[:49]))]
    got = repeated_passages(spark.createDataFrame(docs, SCHEMA)).collect()
    assert {r.doc_id for r in got} == {d for d in range(4, 40, 4)}
    assert all(r.other_id < r.doc_id and r.other_id % 4 == 0 for r in got)
    for r in got:
        mine, theirs = docs[r.doc_id][1].split()[r.first_word : r.end_word], docs[r.other_id][1].split()[r.other_first : r.other_end]
        assert len(mine) >= 50 and set(passage) & set(mine) and abs(len(mine) - len(theirs)) <= 5
    assert repeated_passages(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("size,edits,small", [(60, (0, 1), False), (60, (1, 2), True), (100, (0, 3), False), (100, (1, 3), True)])
def test_passages_meet_later_holders(spark, monkeypatch, size, edits, small):
    """The first holder is often too far from a later copy, while one of the documents between the two is near enough."""
    if small:
        monkeypatch.setattr(passages, "GROUP", 16)
        monkeypatch.setattr(passages, "HOT", 3)
        monkeypatch.setattr(common, "CROWD", 8)
    draw = random.Random(size + edits[1])
    passage = [f"w{draw.randrange(5000)}" for _ in range(size)]
    docs, grams, want = [], [], set()
    for d in range(200):
        copy = list(passage)
        for _ in range(draw.randint(*edits)):
            copy[draw.randrange(size)] = f"edit{draw.randrange(100000)}"
        text = [f"w{draw.randrange(5000)}" for _ in range(120)]
        text[50:50] = copy
        docs.append((d, " ".join(text)))
        grams.append({tuple(copy[i : i + 5]) for i in range(size - 4)})
        if any(len(grams[d] & g) >= 0.8 * len(grams[d] | g) for g in grams[:-1]):
            want.add(d)
    got = {r.doc_id for r in repeated_passages(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert len(want) > 20 and len(got & want) >= 0.95 * len(want)


def test_window_places_of_many_texts_are_those_of_compact_windows():
    """All texts of a chunk in one pass, with places as one text after another has them, repeats included."""
    draw = np.random.default_rng(8)
    sizes = [0, 3, 46, 300, 45, 700, 1, 64]
    texts = [draw.integers(0, 1 << 64, n, dtype=np.uint64) for n in sizes] + [np.tile(draw.integers(0, 1 << 64, n, dtype=np.uint64), 60) for n in (1, 2, 30, 50)]
    edges = np.cumsum([0, *map(len, texts)])
    for least in (1, 2, 7, 46):
        want = [int(a) + p for a, h in zip(edges, texts, strict=False) for p in sorted(x[1] for x in compact_windows(h, least))]
        assert passages.window_places(np.concatenate(texts), common.whole(edges, least), least).tolist() == want
    words_ = [" ".join(f"A{draw.integers(50)}" for _ in range(n)) for n in sizes]
    chunks = list(common.token_chunks([None, *words_, "", "\n x"], 900))
    assert len(chunks) > 2 and [first for first, _, _ in chunks] == [0, *np.cumsum([len(e) - 1 for _, _, e in chunks])[:-1]]
    got = [tokens[a:b].tolist() for _, tokens, edges in chunks for a, b in zip(edges, edges[1:], strict=False)]
    assert got == [common.words(t.encode().lower())[0].tolist() for t in ["", *words_, "", "\n x"]]


@pytest.mark.parametrize("least", [46, 47])
def test_nearest_looks_closer_at_few_pairs_of_a_crowd(monkeypatch, least):
    """Windows that share a line only cost a bitmap's look; copies are found as by comparing each with each."""
    draw = np.random.default_rng(11)
    sizes, rows = [40, 300, 7, 90, 1], []
    for size in sizes:
        line = draw.integers(1, 1 << 32, 14)
        for i in range(size):
            row = draw.integers(1, 1 << 32, 2 * least)
            row[least - 7 : least + 7] = line
            if i and i % 5 == 0:  # a copy of an earlier one, edited, shifted behind the edit, or cut off
                row = rows[-draw.integers(1, i + 1)].copy()
                edit, by = int(draw.integers(least, 2 * least - 8)), int(draw.integers(-2, 3))
                row[edit + 5 :] = np.roll(row[edit + 5 :], by)
                row[edit : edit + 5] = draw.integers(1, 1 << 32, 5)
                row[2 * least - int(draw.integers(0, 12)) :] = 0
            rows.append(row)
    around = np.array(rows, dtype=np.uint32)
    group = np.repeat(np.arange(len(sizes)), sizes)
    doc = np.concatenate([np.sort(draw.integers(0, 3 * n, n)) for n in sizes])
    open_ = draw.random(len(group)) < 0.8
    center, want = np.ascontiguousarray(around[:, least - passages.CENTER : least + passages.CENTER]), {}
    for w in np.flatnonzero(open_).tolist():
        before = np.flatnonzero((group == group[w]) & (doc < doc[w]))
        common = passages.in_common(around, center, np.full(len(before), w), before)
        if common.max(initial=0) >= 2 * 0.8 / 1.8 * least:
            want[w] = common.max()
    pairs, plain = [], passages.in_common

    def counted(around, center, mine, theirs):
        pairs.append(len(mine))
        return plain(around, center, mine, theirs)

    monkeypatch.setattr(passages, "in_common", counted)
    mine, theirs = passages.nearest(group, doc, open_, around, 0.8)
    assert len(want) > 40 and mine.tolist() == list(want)
    assert (group[mine] == group[theirs]).all() and (doc[theirs] < doc[mine]).all()
    assert plain(around, center, mine, theirs).tolist() == list(want.values())
    assert sum(pairs) < 0.1 * sum(n * n for n in sizes) / 2


def test_rows_about_many_texts_are_those_of_each():
    draw = np.random.default_rng(12)
    texts = [draw.integers(0, 1 << 64, n, dtype=np.uint64) for n in (0, 3, 50, 300, 5, 4, 0, 1)]
    edges = np.cumsum([0, *map(len, texts)])
    for length in (1, 2, 46):
        rows, starts = passages._rows_about(np.concatenate(texts), edges, length)
        for text, start in zip(texts, starts.tolist(), strict=True):
            padded = np.pad(common.shingles(text, passages.WIDTH).astype(np.uint32) | np.uint32(1), length)
            for at in range(len(padded) - 2 * length):
                assert rows[start + at].tolist() == padded[at + 1 : at + 1 + 2 * length].tolist()


def test_likeness_numbers_shingles_once():
    """One sort for both texts, however many passages are judged, and the shingles of many lists in one pass."""
    draw = np.random.default_rng(13)
    text = draw.integers(0, 1 << 32, 600, dtype=np.uint64)
    edited = text.copy()
    edited[[100, 101, 102, 103, 230, 380, 381, 382, 383, 384]] = np.arange(10, dtype=np.uint64)
    calls = [0]

    class Counted:
        def __getattr__(self, name):
            calls[0] += name in ("unique", "argsort", "sort", "searchsorted")
            return getattr(np, name)

    found = likeness(text, edited, 50, 0.95)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(passages, "np", Counted())
        assert likeness(text, edited, 50, 0.95) == found
    assert calls == [1]
    assert sorted((s, e) for s, e, *_ in found) == sorted((s, e) for _, _, s, e, _ in found) and len(found) >= 2
    assert all(similarity >= 0.95 for *_, similarity in found)
    lists = [text[:0], text[:3], text[3:8], text[8:300], text[:0], text[300:301]]
    arrow = pa.array([x.astype(np.uint32).view(np.int32) for x in lists], pa.list_(pa.int32()))
    for some in (slice(0, 6), slice(2, 5), slice(0, 1)):
        got = passages._shingles_of_each(arrow.slice(some.start, some.stop - some.start))
        assert [x.tolist() for x in got] == [common.shingles(x, passages.WIDTH).tolist() for x in lists[some]]


def test_passages_edges(spark):
    """Repeated words, a very long text, repeated rows and ids, and columns with other names."""
    draw = random.Random(20)
    long = [f"w{draw.randrange(5000)}" for _ in range(20_000)]
    docs = [(1, "one two " * 3000), (2, "one two " * 3000), (3, " ".join(long)), (4, " ".join(long[9000:9060])), (4, " ".join(long[9000:9060])), (5, " ".join(long[:30] + long[100:130])), (6, "")]
    got = repeated_passages(spark.createDataFrame([(*d, 1, 1) for d in docs], SCHEMA + ", value int, place int")).collect()
    assert {r.doc_id for r in got} == {2, 4}
    assert {(r.first_word, r.end_word, r.other_id, r.other_first) for r in got if r.doc_id == 4} == {(0, 60, 3, 9000)}
    assert next(r.end_word - r.first_word for r in got if r.doc_id == 2) > 100


def test_likeness_over_a_wide_gap():
    plain = np.arange(1, 201, dtype=np.uint64)
    edited = plain.copy()
    edited[[95, 98, 102, 106]] += np.uint64(1000)
    for a, b in ((plain, edited), (edited, plain)):
        assert [(s, e, s2, e2) for s, e, s2, e2, _ in likeness(a, b, 150, 0.8)] == [(0, 200, 0, 200)]


RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("a.example.net", "/", "block"), ("example.net", "/en/x", "block"), (None, "/", "block"), ("org", "/fr/", "allow"), ("org", "/fr/", "block")]


def test_url_filter_against_brute_force(spark):
    draw = random.Random(11)
    hosts = ["net", "example.net", "a.example.net", "b.a.example.net", "xexample.net", "org", "w.org", "com", "", "EXAMPLE.net", "example.net:80", "..net"]
    paths = ["", "/", "/en/", "/en/x", "/en/xy?q=/fr/", "/fr/#a", "/en", "?x", "/fr/z"]
    urls = [f"http://{draw.choice(hosts)}{draw.choice(paths)}" for _ in range(200)] + [None, "", "nothing", "a://b://net/", "x://net/\nen"]
    rules = {h + p: (h, p, v) for h, p, v in sorted((r for r in RULES if r[0]), key=lambda r: r[2])}
    got = url_filter(spark.createDataFrame([(i, u, "q", "old") for i, u in enumerate(urls)], "page_id long, url string, extra string, rule string"), spark.createDataFrame(RULES, "host string, path string, verdict string"), salts=3).collect()
    assert len(got) == len(urls) and got[0].extra == "q"
    for r in got:
        rest = (r.url or "").split("://", 1)[1] if "://" in (r.url or "") else None
        host = re.split(r"[/?#]", rest)[0] if rest is not None else ""
        path = re.split(r"[?#]", rest[len(host) :])[0] if rest is not None else ""
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        fits = [k for k, (h, p, _) in rules.items() if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = max(fits, key=len, default=None)
        assert (r.host, r.path, r.rule) == (host, path, best)
        assert r.verdict == (rules[best][2] if best else "allow")
    assert url_filter(spark.createDataFrame([], "url string"), spark.createDataFrame(RULES, "host string, path string, verdict string")).count() == 0
    assert url_filter(spark.createDataFrame([("http://net/",)], "url string"), spark.createDataFrame([], "host string, path string, verdict string")).collect()[0].verdict == "allow"
