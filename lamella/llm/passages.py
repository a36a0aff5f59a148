"""Near-duplicate passages by compact windows of min-hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F

from lamella.llm.common import bucket_of, crowd_levels, cut, mix, only, pieces, shingles, token_chunks, whole, words

#: Words in a shingle, hash functions, and how many of these must bring a passage forward.
WIDTH, HASHES, ENOUGH = 5, 4, 2
#: Passages whose offsets between two documents differ by less share a candidate; words read around it.
DRIFT, AROUND = 64, 80
#: Windows of one value that are compared at a time, and the level (the logarithm of the documents) above which a value's
#: windows are dealt over several tasks.
GROUP, HOT = 2048, 12


def compact_windows(h: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """(first, place, end): every run of ``least`` or more inside ``first .. end`` over ``place`` has its minimum there.

    The windows are the nodes of the Cartesian tree of ``h`` over ranges that are long enough; of equal
    minima the leftmost counts.
    """
    out, todo = [], [(0, len(h))] if len(h) >= max(1, least) else []
    while todo:
        low, high = todo.pop()
        place = low + int(h[low:high].argmin())
        out.append((low, place, high))
        if place - low >= least:
            todo.append((low, place))
        if high - place - 1 >= least:
            todo.append((place + 1, high))
    return out


def compact_windows_with_ties(h: np.ndarray, least: int) -> list[tuple[int, int, int]]:
    """The same for values that recur often: all places of a minimum are taken at once."""
    out, todo = [], [(0, len(h))]
    while todo:
        low, high = todo.pop()
        if high - low < least:
            continue
        part = h[low:high]
        for place in (low + np.flatnonzero(part == part.min())).tolist():
            if high - low < least:
                break
            out.append((low, place, high))
            if place - low >= least:
                todo.append((low, place))
            low = place + 1
        else:
            todo.append((low, high))
    return out


def window_places(h: np.ndarray, starts: np.ndarray, least: int) -> np.ndarray:
    """Places of the compact windows of many texts' values, all texts at once: of the least value, the leftmost of equal ones, of each run of ``least`` values.

    ``starts`` are the runs' first places, in order. A window holds a run of ``least`` over its place, whose minimum it is, so these
    are the places of ``compact_windows``. Values keep the bits above the place's.
    """
    mask = np.uint64((1 << len(h).bit_length()) - 1)
    low, width = h & ~mask | np.arange(len(h), dtype=np.uint64), 1
    while 2 * width <= least:
        low, width = np.minimum(low[:-width], low[width:]), 2 * width
    place = (np.minimum(low[starts], low[starts + least - width]) & mask).astype(np.int64)
    return place[np.concatenate(([True], place[1:] != place[:-1]))] if len(place) else place


def _tokens(text: str | None) -> np.ndarray:
    return words((text or "").encode().lower())[0]


def windows(docs: DataFrame, least_words: int, levels: Broadcast) -> DataFrame:
    """``key, value, doc_id, at`` of the compact windows of all texts, under each hash function.

    ``at`` is twice the window's place, and one more but for the leftmost window of a value in its document. Of places of one
    value less than half of ``least_words`` apart, one stands for all. The key is the value; a value of very many
    documents has several keys, and is named beside them.
    """
    least = max(1, least_words - WIDTH + 1)
    seeds = [np.uint64(0xD1B54A32D192ED03 * (i + 1) & 0xFFFFFFFFFFFFFFFF) for i in range(HASHES)]
    size = 1 << 17 if least_words > WIDTH else 0  # texts of fewer words than a shingle's stand alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            columns: list[list[np.ndarray]] = [[], [], [], []]
            ids = batch.column(0).to_numpy()
            for first, tokens, edges in token_chunks(batch.column(1).to_pylist(), size):
                base = shingles(tokens, WIDTH)
                ends = np.minimum(edges, len(base)) if len(edges) == 2 else edges
                starts = whole(ends, least if len(edges) == 2 else least + WIDTH - 1)
                if not len(starts):
                    continue
                for seed in seeds:
                    h = mix(base + seed)
                    place = window_places(h, starts, least)
                    text = np.searchsorted(edges, place, side="right") - 1
                    order = np.lexsort((h[place], text))
                    place, text = place[order], text[order]
                    own = h[place]
                    follows = np.concatenate(([False], (own[1:] == own[:-1]) & (text[1:] == text[:-1])))
                    if follows.any():
                        stands, last = np.ones(len(place), dtype=bool), 0
                        for i in np.flatnonzero(follows).tolist():
                            last = last if follows[i - 1] else i - 1
                            stands[i] = place[i] - place[last] >= least // 2
                            last = i if stands[i] else last
                        place, text, own, follows = place[stands], text[stands], own[stands], follows[stands]
                    doc = ids[first + text]
                    level = levels.value[bucket_of(base[place])].astype(np.int64)
                    salts = np.left_shift(1, np.maximum(level - HOT, 0))
                    key = np.where(salts > 1, mix(own + mix(np.uint64(1) + mix(doc.view(np.uint64)) % salts.view(np.uint64))), own)
                    columns[0].append(key)
                    columns[1].append(np.where(salts > 1, own, np.uint64(0)))
                    columns[2].append(doc)
                    columns[3].append((2 * (place - edges[text]) + follows).astype(np.int32))
            if columns[0]:
                key, value, doc, at = (np.concatenate(c) for c in columns)
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(value.view(np.int64), mask=value == 0), pa.array(doc), pa.array(at)], ["key", "value", "doc_id", "at"])

    return docs.select("doc_id", "text").mapInArrow(run, "key long, value long, doc_id long, at int")


def _meetings(found: DataFrame, parts: int) -> DataFrame:
    """``value, doc_id, place, lead, other_id, other_place``: each window but the first document's, and the first of its key."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (None, None, None)  # key, first document, its place
        for batch in batches:
            key, doc, at = (batch.column(n).to_numpy() for n in ("key", "doc_id", "at"))
            if not len(key):
                continue
            new = np.concatenate(([key[0] != held[0]], key[1:] != key[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            other, place = np.where(first >= 0, doc[first], held[1] or 0), np.where(first >= 0, at[first] >> 1, held[2] or 0)
            held = key[-1], other[-1], place[-1]
            salted = np.asarray(batch.column("value").is_valid())
            keep = pa.array((doc != other) | salted & new)
            value = pc.coalesce(batch.column("value"), batch.column("key"))
            columns = [value, batch.column("doc_id"), pa.array(at >> 1), pa.array(at & 1 == 0), pa.array(other, pa.int64(), mask=doc == other), pa.array(place.astype(np.int32))]
            yield pa.RecordBatch.from_arrays([c.filter(keep) for c in columns], ["value", "doc_id", "place", "lead", "other_id", "other_place"])

    schema = "value long, doc_id long, place int, lead boolean, other_id long, other_place int"
    met = cut(found.repartition(parts, "key").sortWithinPartitions("key", "doc_id", "at").mapInArrow(meet, schema))
    # the first ones of a value's several keys meet the first of all
    several = met.where("other_id is null").drop("other_id", "other_place")
    first = several.groupBy("value").agg(F.min(F.struct("doc_id", "place")).alias("x")).select("value", F.col("x.doc_id").alias("other_id"), F.col("x.place").alias("other_place"))
    return met.where("other_id is not null").unionByName(several.join(first, "value").where("doc_id > other_id"))


def likeness(a: np.ndarray, b: np.ndarray, least_words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """(first, end, other first, other end, Jaccard) of the passages of ``b`` that ``a`` has nearly too, in words.

    Shared shingles a few edits apart are one passage if it is alike enough as a whole. If not, equal runs grow
    together only while each edit is made up for by what is equal on either side, so a long equal run
    stands however different the rest is.
    """
    return _likeness(shingles(a, WIDTH), shingles(b, WIDTH), least_words, similarity)


def _likeness(a: np.ndarray, b: np.ndarray, least_words: int, similarity: float) -> list[tuple[int, int, int, int, float]]:
    """The same from the texts' shingles, which are numbered once; sets are flags by number."""
    both_sides = np.concatenate((a, b))
    order = np.argsort(both_sides)
    ranked = both_sides[order]
    new = np.zeros(len(order), dtype=np.int64)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty_like(new)
    number[order] = np.cumsum(new)
    sa, sb = number[: len(a)], number[len(a) :]

    def flags(numbers: np.ndarray) -> np.ndarray:
        out = np.zeros(len(number), dtype=bool)
        out[numbers] = True
        return out

    every = flags(sa)
    at = np.flatnonzero(every[sb])
    price = 2 * similarity / max(1e-9, 1 - similarity)
    out = []

    def report(start: int, end: int) -> bool:
        if end - start + WIDTH - 1 < least_words:
            return False
        mine = flags(sb[start:end])
        n_mine = np.count_nonzero(mine)
        if np.count_nonzero(mine & every) < similarity * n_mine:
            return False
        there = np.flatnonzero(mine[sa])
        apart = np.flatnonzero(there[1:] - there[:-1] > 2 * WIDTH)
        firsts, lasts = [int(there[0]), *there[apart + 1].tolist()], [*there[apart].tolist(), int(there[-1])]
        best, place = 0.0, (0, 0)
        for i, first in enumerate(firsts):  # the neighbouring places of these shingles that are most alike together
            for last in lasts[i:]:
                other = flags(sa[first : last + 1])
                n_other = np.count_nonzero(other)
                if n_mine < similarity * n_other:
                    break
                both = np.count_nonzero(other & mine)
                if (alike := both / (n_mine + n_other - both)) > best:
                    best, place = alike, (first, last)
        if best < similarity:
            return False
        out.append((start, end + WIDTH - 1, place[0], place[1] + WIDTH, best))
        return True

    todo = [at] if len(at) else []
    while todo:
        near = todo.pop()
        if near[-1] - near[0] + WIDTH < least_words:
            continue
        if report(int(near[0]), int(near[-1]) + 1):
            continue
        gaps = near[1:] - near[:-1]
        if len(gaps) and gaps.max() > 2 * WIDTH:
            wide = int(gaps.argmax()) + 1
            todo += [near[wide:], near[:wide]]
            continue
        grown: list[list[float]] = []
        ends = np.flatnonzero(gaps > 1)
        for first, last in zip([int(near[0]), *near[ends + 1].tolist()], [*near[ends].tolist(), int(near[-1])], strict=True):
            length = last - first + 1
            cost = price * (first - grown[-1][1]) if grown else 0
            if grown and cost <= min(grown[-1][2], length):
                grown[-1][1:] = [last + 1, grown[-1][2] + length - cost]
            else:
                grown.append([first, last + 1, length])
        for start, end, _ in grown:
            report(int(start), int(end))
    return out


def _shingles_of_each(lists: pa.ListArray) -> list[np.ndarray]:
    """The shingles of each list of words, all made in one pass."""
    at = lists.offsets.to_numpy()
    tokens = lists.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]].view(np.uint32).astype(np.uint64)
    every, at = shingles(tokens, WIDTH), (at - at[0]).tolist()
    return [every[a : b - WIDTH + 1] if b - a >= WIDTH else shingles(tokens[a:b], WIDTH) for a, b in zip(at, at[1:], strict=False)]


def _candidates(met: DataFrame, enough: int) -> DataFrame:
    """``other_id, doc_id, drift, low, high, least, most`` of runs of offsets less than ``DRIFT`` apart that ``enough`` values share."""
    pair = Window.partitionBy("other_id", "doc_id").orderBy("shift")
    met = met.select("other_id", "doc_id", "value", "place", (F.col("place") - F.col("other_place")).alias("shift"))
    met = met.withColumn("_new", (F.col("shift") - F.lag("shift").over(pair) >= DRIFT).cast("int"))
    met = met.withColumn("drift", F.coalesce(F.sum("_new").over(pair), F.lit(0)))
    found = met.groupBy("other_id", "doc_id", "drift").agg(
        F.min("place").alias("low"), (F.max("place") + WIDTH).alias("high"), F.min("shift").alias("least"), F.max("shift").alias("most"), F.count_distinct("value").alias("n"),
    )
    return cut(found.where(F.col("n") >= enough).drop("n"))


def _verified(rows: DataFrame, candidates: DataFrame, least_words: int, similarity: float) -> DataFrame:
    """The passages of ``candidates`` that are alike enough in the texts, each of which is read once."""
    reach = 2 * least_words + AROUND  # no two neighbouring windows of a passage are further apart, nor the outermost from its ends
    pair = ("other_id", "doc_id", "drift")
    asked = candidates.select(F.col("doc_id").alias("id"), *pair, F.lit(True).alias("later"), (F.col("low") - reach).alias("low"), (F.col("high") + reach).alias("high"))
    asked = asked.unionByName(candidates.select(F.col("other_id").alias("id"), *pair, F.lit(False).alias("later"), (F.col("low") - F.col("most") - reach).alias("low"), (F.col("high") - F.col("least") + reach).alias("high")))
    # a document that very many later ones ask for is read by several tasks
    listed = asked.groupBy("id", F.pmod(F.xxhash64(*pair), F.lit(64)).alias("_part")).agg(F.collect_list(F.struct(*pair, "later", "low", "high")).alias("asked"))
    listed = cut(listed.select(F.col("id").alias("doc_id"), "asked"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            texts, asked = batch.column("text").to_pylist(), batch.column("asked")
            low, high, out = asked.flatten().field("low").to_numpy(), asked.flatten().field("high").to_numpy(), []
            low, at = np.maximum(low, 0), 0
            for text, n in zip(texts, asked.value_lengths().to_pylist(), strict=True):
                tokens = _tokens(text).astype(np.uint32)  # a shingle of five still has 160 bits
                out += [tokens[a : max(0, b)].view(np.int32) for a, b in zip(low[at : at + n].tolist(), high[at : at + n].tolist(), strict=True)]
                at += n
            flat = asked.flatten()
            yield pa.RecordBatch.from_arrays([*(flat.field(n) for n in (*pair, "later")), pa.array(low, pa.int32()), pa.array(out, pa.list_(pa.int32()))], [*pair, "later", "low", "tokens"])

    spans = only(rows, listed.select("doc_id")).join(listed, "doc_id").select("text", "asked")
    spans = spans.mapInArrow(read, "other_id long, doc_id long, drift long, later boolean, low int, tokens array<int>")
    sides = spans.groupBy("other_id", "doc_id", "drift").agg(
        *[F.min(F.when(side, F.struct("low", "tokens"))).alias(name) for name, side in (("mine", F.col("later")), ("theirs", ~F.col("later")))]
    )

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            out = []
            (la, sa), (lb, sb) = ((batch.column(n).field("low").to_pylist(), _shingles_of_each(batch.column(n).field("tokens"))) for n in ("theirs", "mine"))
            for i, (other, doc) in enumerate(zip(batch.column("other_id").to_pylist(), batch.column("doc_id").to_pylist(), strict=True)):
                found = _likeness(sa[i], sb[i], least_words, similarity)
                out += [(doc, s + lb[i], e + lb[i], other, s2 + la[i], e2 + la[i], j) for s, e, s2, e2, j in found]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in RESULT.split(", ")])

    return sides.mapInArrow(verify, RESULT).groupBy("doc_id", "first_word", "other_id").agg(F.max(F.struct("end_word", "similarity", "other_first", "other_end")).alias("x")).select("doc_id", "first_word", "x.end_word", "other_id", "x.other_first", "x.other_end", "x.similarity")


#: Shingles next to a place that are looked at first, and how many of them, and of all around it, two windows have in common at least.
CENTER, CLOSE, SAME = 12, 6, 12


def _counts(equal: np.ndarray) -> np.ndarray:
    """How many of each row are true, of 255 at most: bytes are added eight or four at a time where they can be."""
    for kind, ones, shift in ((np.uint64, 0x0101010101010101, 56), (np.uint32, 0x01010101, 24)):
        if len(equal) and equal.shape[1] % np.dtype(kind).itemsize == 0 and equal.flags.c_contiguous:
            return np.add.reduce(equal.view(kind), axis=1, dtype=kind) * kind(ones) >> kind(shift)
    return equal.sum(axis=1, dtype=np.uint8)


def in_common(around: np.ndarray, center: np.ndarray, mine: np.ndarray, theirs: np.ndarray) -> np.ndarray:
    """For rows ``mine`` and ``theirs`` of ``around``, the most shingles in common in half a row that contains the place, its middle.

    Rows have the shingles about a place in order, zero beyond the text; ``center`` are their middle columns. Edits move what follows by two words at most.
    """
    length = around.shape[1] // 2
    out = np.zeros(len(mine), dtype=np.int64)
    for at in range(0, len(mine), 4096):
        close = np.flatnonzero(_counts(center[mine[at : at + 4096]] == center[theirs[at : at + 4096]]) >= CLOSE) + at
        a, b = around[mine[close]], around[theirs[close]]
        equal = a == b
        many = _counts(equal & (a != 0)) >= SAME
        close, a, b, equal = close[many], a[many], b[many], equal[many]
        for d in (1, 2):
            equal[:, d:] |= a[:, d:] == b[:, :-d]
            equal[:, :-d] |= a[:, :-d] == b[:, d:]
        equal &= a != 0
        run = np.cumsum(np.pad(equal, ((0, 0), (1, 0))), axis=1, dtype=np.int16)
        out[close] = (run[:, length:] - run[:, :-length]).max(axis=1, initial=0)
    return out


def _bits(columns: np.ndarray) -> np.ndarray:
    """A bitmap of 64 bits of each row's values but zeros."""
    out = np.zeros(len(columns), dtype=np.uint64)
    for column in columns.T:
        out |= np.left_shift((column != 0).astype(np.uint64), column >> np.uint32(8) & np.uint32(63))
    return out


def _sides(around: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(bits, zeros, bits with two more places on either end) of the shingles before the place of each row, and of those behind it.

    Half a row that contains the place has all of one side or the other. What a row lacks of another's bits, at that row's
    places or two beside them, is the least number of shingles that it has not in common.
    """
    place, reach = around.shape[1] // 2 - 1, around.shape[1] // 4
    out = []
    for low, high in ((place - reach, place), (place + 1, place + 1 + reach)):
        bits = _bits(around[:, low:high])
        beside = _bits(around[:, max(0, low - 2) : low]) | _bits(around[:, high : high + 2])
        out.append((bits, np.count_nonzero(around[:, low:high] == 0, axis=1), bits | beside))
    return out


def nearest(group: np.ndarray, doc: np.ndarray, open_: np.ndarray, around: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of rows in order of group and document: the open ones, and for each the window of an earlier document in its group that has most in common with it, if enough for a passage.

    Pairs whose bitmaps show that they have less in common are not looked at closer.
    """
    first = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    size = np.diff(np.concatenate((first, [len(group)])))
    place = np.arange(len(group)) - np.repeat(first, size)
    middle = around.shape[1] // 2
    enough = 2 * similarity / (1 + similarity) * middle
    spare = middle - int(np.ceil(enough))
    sides = _sides(around)
    center = np.ascontiguousarray(around[:, middle - CENTER : middle + CENTER])
    best, most = np.full(len(group), -1), np.zeros(len(group), dtype=np.int64)
    small = np.repeat(np.add.reduceat(1 + open_, first) <= 64, size)
    rows = np.flatnonzero(open_ & small & (place > 0))
    for lag in range(1, 64):
        rows = rows[place[rows] >= lag]
        if not len(rows):
            break
        before = rows[doc[rows - lag] < doc[rows]]
        before = before[np.logical_or.reduce([np.bitwise_count(own[before] & ~other[before - lag]) + none[before] <= spare for own, none, other in sides])]
        common = in_common(around, center, before, before - lag)
        better = common > most[before]
        most[before[better]], best[before[better]] = common[better], (before - lag)[better]

    def compare(mine: np.ndarray, theirs: np.ndarray) -> None:
        common = in_common(around, center, mine, theirs)
        begin = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
        top = np.maximum.reduceat(common, begin)
        at = np.flatnonzero(common == np.repeat(top, np.diff(np.concatenate((begin, [len(mine)])))))
        at = at[np.concatenate(([True], mine[at[1:]] != mine[at[:-1]]))]  # the earliest of those with most
        most[mine[begin]], best[mine[begin]] = top, theirs[at]

    held: list[tuple[np.ndarray, np.ndarray]] = []
    rows = np.flatnonzero(open_ & ~small)
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])))
    begun = np.maximum.accumulate(np.where(new, np.arange(len(group)), 0))  # the first row of its document in the group
    for crowd in np.split(rows, np.flatnonzero(group[rows[1:]] != group[rows[:-1]]) + 1) if len(rows) else []:
        start = crowd[0] - place[crowd[0]]
        for at in range(0, len(crowd), 64):
            mine = crowd[at : at + 64]
            theirs = slice(start, begun[mine[-1]])
            like = np.logical_or.reduce([np.bitwise_count(own[mine, None] & ~other[theirs]) <= spare - none[mine, None] for own, none, other in sides])
            like &= np.arange(theirs.start, theirs.stop) < begun[mine, None]
            i, j = np.nonzero(like)
            if len(i):
                held.append((mine[i], start + j))
            if sum(len(x) for x, _ in held) >= 1 << 16:
                compare(*map(np.concatenate, zip(*held, strict=True)))
                held = []
    if held:
        compare(*map(np.concatenate, zip(*held, strict=True)))
    chosen = np.flatnonzero(most >= enough)
    return chosen, best[chosen]


def _rows_about(tokens: np.ndarray, edges: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the ``2 * length`` shingles about each place of many texts, zero beyond a text, and the row of each text's first place."""
    size = np.diff(edges)
    n = np.maximum(size - WIDTH + 1, np.minimum(size, 1))
    starts = length + np.cumsum(n + length) - n - length
    base = np.zeros(length + int((n + length).sum()), dtype=np.uint32)
    if size.max(initial=0) >= WIDTH:
        from_ = whole(edges, WIDTH)
        base[from_ + np.repeat(starts - edges[:-1], np.maximum(size - WIDTH + 1, 0))] = shingles(tokens, WIDTH)[from_].astype(np.uint32) | np.uint32(1)
    for i in np.flatnonzero((size > 0) & (size < WIDTH)).tolist():
        base[starts[i]] = shingles(tokens[edges[i] : edges[i + 1]], WIDTH).astype(np.uint32)[0] | np.uint32(1)
    return np.lib.stride_tricks.sliding_window_view(base, 2 * length), starts - length + 1


def _met_by_open(rows: DataFrame, met: DataFrame, left: DataFrame, length: int, similarity: float, parts: int) -> DataFrame:
    """Windows ``left`` (value, doc_id, place) and, of all windows with their values in earlier documents, the ``nearest``."""
    holders = met.where("lead").select("value", "doc_id", "place").unionByName(met.select("value", F.col("other_id").alias("doc_id"), F.col("other_place").alias("place")))
    counts = left.groupBy("value").agg(F.count("*").alias("u"))
    places = holders.join(counts.select("value"), "value", "left_semi").withColumn("open", F.lit(False)).unionByName(left.withColumn("open", F.lit(True)))
    places = cut(places.groupBy("value", "doc_id", "place").agg(F.max("open").alias("open")))
    crowds = places.groupBy("value").agg(F.ceil(F.count("*") / GROUP).cast("int").alias("n"), F.ceil(F.count_if("open") / GROUP).cast("int").alias("u"))
    listed = cut(places.join(crowds, "value").groupBy("doc_id").agg(F.collect_list(F.struct("value", "place", "open", "n", "u")).alias("places")))
    schema = "value long, low int, high int, doc_id long, place int, open boolean, around binary"

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in schema.split(", ")]
        for batch in pieces(batches, 64):
            ids, found = batch.column("doc_id").to_numpy(), batch.column("places")
            value, at, is_open, n, u = (found.flatten().field(c).to_numpy(zero_copy_only=False) for c in ("value", "place", "open", "n", "u"))
            begin = np.concatenate(([0], np.cumsum(found.value_lengths().to_numpy())))
            for first, tokens, edges in token_chunks(batch.column("text").to_pylist()):
                around, starts = _rows_about(tokens, edges, length)
                own = slice(begin[first], begin[first + len(starts)])
                text = np.repeat(np.arange(len(starts)), np.diff(begin[first : first + len(starts) + 1]))
                part = mix(ids[first + text].view(np.uint64))
                # an open one that is alone with its value's few meets them once, as itself
                shut = np.where(is_open[own] & (n[own] == 1) & (u[own] == 1), 0, u[own])
                wide = np.where(is_open[own], n[own], 0)
                total = np.cumsum(shut + wide)
                for some in np.split(np.arange(len(text)), np.flatnonzero(np.diff(total >> 14)) + 1):
                    rows = [np.repeat(some, k[some]) for k in (shut, wide)]
                    turn = [np.arange(len(r)) - np.repeat(np.cumsum(k[some]) - k[some], k[some]) for r, k in zip(rows, (shut, wide), strict=True)]
                    low = np.concatenate((part[rows[0]] % n[own][rows[0]].astype(np.uint64), turn[1])).astype(np.int32)
                    high = np.concatenate((turn[0], part[rows[1]] % u[own][rows[1]].astype(np.uint64))).astype(np.int32)
                    every = np.concatenate(rows)
                    place = at[own][every]
                    shown = np.ascontiguousarray(around[starts[text[every]] + place])
                    offsets = np.arange(len(every) + 1, dtype=np.int32) * np.int32(8 * length)
                    binary = pa.Array.from_buffers(pa.binary(), len(every), [None, pa.py_buffer(offsets), pa.py_buffer(shown)])
                    yield pa.RecordBatch.from_arrays([pa.array(value[own][every]), pa.array(low), pa.array(high), pa.array(ids[first + text[every]]), pa.array(place), pa.array(np.arange(len(every)) >= len(rows[0])), binary], names)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def data(column: pa.Array) -> memoryview:
            offsets = np.frombuffer(column.buffers()[1], dtype=np.int32)
            return memoryview(column.buffers()[2])[offsets[column.offset] : offsets[column.offset + len(column)]]

        def done(rows: pa.Table) -> pa.RecordBatch:
            value, low, high, doc, place, is_open = (rows.column(n).to_numpy() for n in ("value", "low", "high", "doc_id", "place", "open"))
            around = np.frombuffer(b"".join(map(data, rows.column("around").chunks)), dtype=np.uint32).reshape(len(rows), -1)
            new = (value[1:] != value[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])
            w, other = nearest(np.concatenate(([0], np.cumsum(new))), doc, is_open, around, similarity)
            return pa.RecordBatch.from_arrays([pa.array(c) for c in (value[w], doc[w], place[w], doc[other], place[other])], ["value", "doc_id", "place", "other_id", "other_place"])

        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= 16_384:
                rows = pa.Table.from_batches(held)
                last = [rows.column(n).to_numpy() for n in ("value", "low", "high")]
                begun = len(rows) - int(np.argmin(np.append(np.logical_and.reduce([c == c[-1] for c in last])[::-1], False)))
                if begun:
                    yield done(rows.slice(0, begun))
                held = rows.slice(begun).to_batches()
        if sum(map(len, held)):
            yield done(pa.Table.from_batches(held))

    shown = only(rows, listed.select("doc_id")).join(listed, "doc_id").select("doc_id", "text", "places").mapInArrow(show, schema)
    return shown.repartition(parts, "value", "low", "high").sortWithinPartitions("value", "low", "high", "doc_id", "place").mapInArrow(choose, "value long, doc_id long, place int, other_id long, other_place int")


def repeated_passages(docs: DataFrame, least_words: int = 50, similarity: float = 0.8, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, first_word, end_word, other_id, other_first, other_end, similarity``: passages an earlier document has nearly too.

    Words are runs of anything but ASCII white space, A-Z lower-cased. Compact windows group all runs of
    ``least_words`` words that share a minimum of hashed five-word shingles. Windows with equal values first
    meet the earliest document that has the value, so an equal passage in very many documents costs one
    candidate for each. What ``ENOUGH`` hash functions bring forward at about the same offset is read in
    both texts and reported where the shingles' Jaccard likeness is ``similarity`` or more. Windows that
    no such passage covers are then compared with all earlier windows of their value, by the shingles around, and the
    nearest that can be a passage is read: a first holder that is too far hides no later, closer one, and
    a window costs one candidate more, however many have its value.

    The window values cross the network once; a value of very many documents is dealt over several tasks, and crowds
    are compared in pieces of ``GROUP``. Texts are read where they have candidates, and only words around these are sent.
    A document that repeats inside itself only is not reported. Null and short texts have no
    passages. Rows with equal ids count as one document and are not compared; null ids are left out.
    No rows give none. Other columns are not read.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text")).where("doc_id is not null and text is not null")
    levels = docs.sparkSession.sparkContext.broadcast(crowd_levels(rows, WIDTH))
    met = _meetings(windows(rows, least_words, levels), parts)
    found = cut(_verified(rows, _candidates(met, ENOUGH), least_words, similarity))

    known = found.select(F.col("doc_id").alias("_doc"), "first_word", "end_word")
    left = met.join(known, (F.col("doc_id") == F.col("_doc")) & (F.col("place") >= F.col("first_word")) & (F.col("place") < F.col("end_word")), "left_anti")
    left = cut(left.select("value", "doc_id", "place").distinct())
    more = _verified(rows, _candidates(_met_by_open(rows, met, left, least_words - WIDTH + 1, similarity, parts), 1), least_words, similarity)
    return found.unionByName(more).groupBy("doc_id", "first_word", "other_id").agg(F.max(F.struct("end_word", "similarity", "other_first", "other_end")).alias("x")).select("doc_id", "first_word", "x.end_word", "other_id", "x.other_first", "x.other_end", "x.similarity")


RESULT = "doc_id long, first_word int, end_word int, other_id long, other_first int, other_end int, similarity double"
