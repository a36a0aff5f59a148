"""Find test items inside training texts: rare n-gram seeds, then local alignment."""

from __future__ import annotations

import string
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from lamella.llm.common import words

_PLAIN = bytes(32 if chr(i) in string.punctuation else i for i in range(256))
MATCH, MISMATCH, GAP = 2, -1, -1
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_hashes(text: str | None) -> np.ndarray:
    """Hashes of the words in lower case; ASCII punctuation separates."""
    return words((text or "").lower().encode().translate(_PLAIN))[0]


def _hashes_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all ``texts``, one after another, and the number of each text's."""
    data = [(t or "").lower().encode().translate(_PLAIN) for t in texts]
    ends = np.cumsum([len(d) + 1 for d in data])
    hashes, starts, _ = words(b" ".join(data))
    return hashes, np.diff(np.searchsorted(starts, ends), prepend=0)


def _runs(hashes: np.ndarray, most: int) -> Iterator[tuple[int, np.ndarray]]:
    """(k, a hash for each run of k words), for k from 1 to ``most``."""
    value = hashes
    for k in range(1, min(most, len(hashes)) + 1):
        value = value if k == 1 else value[:-1] * _BASE + hashes[k - 1 :]
        yield k, value


def local_score(item: np.ndarray, passage: np.ndarray) -> int:
    """Best Smith-Waterman score of the two runs of words, a row of the table at a time."""
    row, best = np.zeros(len(passage) + 1, dtype=np.int64), 0
    ramp = np.arange(len(passage) + 1) * -GAP
    for word in item:
        step = np.maximum(row[:-1] + np.where(passage == word, MATCH, MISMATCH), row[1:] + GAP)
        new = np.concatenate(([0], np.maximum(step, 0)))
        row = np.maximum.accumulate(new + ramp) - ramp
        best = max(best, int(row.max()))
    return best


#: Words of the seeds, from the shortest; the longest are seeds however common they are.
GRAMS = (2, 3, 4)
#: A shorter seed is rare if at most this share of the documents has it, or this number.
RARE, FEW = 1 / 2000, 64


class Items:
    """A block of test items: their words, and which of them each seed belongs to.

    A seed begins at each word of an item: the shortest run of ``GRAMS`` words that is rare, or the longest.
    An item of fewer words is one seed as a whole.
    """

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids = ids
        found = [_hashes_of(texts[at : at + 1000]) for at in range(0, len(texts), 1000)]
        flat = np.concatenate([np.zeros(0, np.uint64), *(h for h, _ in found)])
        self.size = np.concatenate([np.zeros(0, np.int64), *(n for _, n in found)])
        self.words = np.split(flat, np.cumsum(self.size)[:-1]) if len(self.size) else []
        owner = np.repeat(np.arange(len(self.size)), self.size)
        self.table, self.sieve = {}, {}  # by length of seed: hashes in order, the item of each, and its place among all words
        for k, gram in _runs(flat, GRAMS[-1]):
            place = np.flatnonzero(owner[: len(gram)] == owner[k - 1 :])
            size = self.size[owner[place]]
            place = place[(size == k) | (size >= GRAMS[-1]) & (k in GRAMS)]
            order = np.argsort(gram[place], kind="stable")
            self.put(k, gram[place][order], owner[place[order]], place[order])

    def put(self, k: int, gram: np.ndarray, item: np.ndarray, place: np.ndarray) -> None:
        """Set the seeds of ``k`` words, with a sieve of their lowest bits, which tells most other hashes apart at once."""
        self.table[k] = gram, item, place
        self.sieve[k] = np.zeros(1 << max(12, (16 * len(gram)).bit_length()), dtype=bool)
        self.sieve[k][(gram & np.uint64(len(self.sieve[k]) - 1)).view(np.int64)] = True

    def held(self, words: np.ndarray, most: int = GRAMS[-1]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, seeds' hashes, where they begin) of a text's runs of up to ``most`` words that are seeds."""
        for k, grams in _runs(words, most):
            if k in self.table and len(own := self.table[k][0]):
                at = np.flatnonzero(self.sieve[k][(grams & np.uint64(len(self.sieve[k]) - 1)).view(np.int64)])
                near = grams[at]
                right = own[np.minimum(np.searchsorted(own, near), len(own) - 1)] == near
                yield k, near[right], at[right]

    def rarest(self, frequency: dict[tuple[int, int], int], docs: int) -> "Items":
        """Keep the seeds that their frequencies, by length and hash, choose."""
        limit = max(FEW, RARE * docs)
        settled = np.zeros(int(self.size.sum()), dtype=bool)
        for k, (gram, item, place) in list(self.table.items()):
            times = np.array([frequency.get((k, g), 0) for g in gram.view(np.int64).tolist()], dtype=np.int64)
            keep = ((times <= limit) | (k == np.minimum(self.size[item], GRAMS[-1]))) & ~settled[place]
            settled[place[keep]] = True
            self.put(k, gram[keep], item[keep], place[keep])
        return self

    def matches(self, text: str | None, threshold: float) -> list[tuple]:
        """(item id, score, first word, end) of the items that the text has, scores as shares of the best possible."""
        have = word_hashes(text)
        place: dict[int, list[int]] = {}
        for k, grams, at in self.held(have):
            own, item, _ = self.table[k]
            low, high = np.searchsorted(own, grams, "left"), np.searchsorted(own, grams, "right")
            for p, a, b in zip(at.tolist(), low.tolist(), high.tolist(), strict=True):
                for i in set(item[a:b].tolist()):
                    place.setdefault(i, []).extend((p, p + k - 1))
        out = []
        for i, where in place.items():
            item, best = self.words[i], (0, 0, 0)
            if len(item) < GRAMS[-1]:
                out.append((self.ids[i], 1.0, min(where), min(where) + len(item)))
                continue
            where.sort()
            start = prior = where[0]
            for p in [*where[1:], None]:
                if p is None or p - prior > 2 * len(item):
                    left, right = max(0, start - 2 * len(item)), min(len(have), prior + 1 + 2 * len(item))
                    near = have[left:right]
                    if np.isin(item, near).sum() >= threshold * len(item):  # no alignment scores more than its equal words
                        best = max(best, (local_score(item, near), start, prior + 1))
                    start = p
                prior = p
            score = best[0] / (MATCH * len(item))
            if score >= threshold:
                out.append((self.ids[i], score, *best[1:]))
        return out


def _seeded(docs: DataFrame, items: DataFrame, item_col: str, text: str, block_chars: int) -> Iterator[Broadcast]:
    """Blocks of items with their seeds, chosen by how many of ``docs`` have each run of words."""
    chosen = items.select(F.col(f"`{item_col}`").cast("long").alias("item_id"), F.col(f"`{text}`").alias("text")).where("text is not null")
    blocks = 1 + int(chosen.agg(F.sum(F.length("text"))).first()[0] or 0) // block_chars
    context = docs.sparkSession.sparkContext
    for block in range(blocks):
        own = chosen.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        own.sort(key=lambda r: (r["item_id"] is None, r["item_id"] or 0, r["text"]))
        held = Items([r["item_id"] for r in own], [r["text"] for r in own])
        shared = context.broadcast(held)

        def count(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                seen: dict[int, list[np.ndarray]] = {0: [np.zeros(len(batch), dtype=np.uint64)]}
                for t in batch.column(0).to_pylist():
                    for k, grams, _ in shared.value.held(word_hashes(t), GRAMS[-1] - 1):  # the longest seeds stay however common
                        seen.setdefault(k, []).append(np.unique(grams))
                for k, found in seen.items():
                    gram, n = np.unique(np.concatenate(found), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(gram), k, np.int32)), pa.array(gram.view(np.int64)), pa.array(n)], ["k", "gram", "n"])

        counts = docs.select(F.col(f"`{text}`")).mapInArrow(count, "k int, gram long, n long").groupBy("k", "gram").agg(F.sum("n").alias("n")).collect()
        times = {(r["k"], r["gram"]): r["n"] for r in counts}
        yield context.broadcast(held.rarest(times, times.get((0, 0), 0)))


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", item_col: str = "item_id", text: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """``doc_id, item_id, score, first_word, end_word``: the items that documents contain, whole or edited.

    Items are taken in blocks of about ``block_chars`` characters, so that what the driver and each task
    hold is bounded whatever the number of items; each block reads the documents twice. The first
    reading counts in how many documents each run of 2 to 4 words of the block occurs, summed before it is sent; a
    seed begins at each word of an item, the shortest run that is rare, or else that of 4 words. In the second,
    seeds bring items to passages, which a local alignment of words scores against the best possible. Documents
    are read whole where they lie; nothing but counts and results is shuffled. An item of fewer than 4 words counts
    only where all its words stand together, with score 1.

    A document that has an item several times gives one row, the best. An item in many documents gives
    a row for each. Texts without words, nulls, and items without words match nothing. Repeated rows
    give repeated rows. Equal items are reported each. Empty tables give no rows.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias(text))
    schema = "doc_id long, item_id long, score double, first_word long, end_word long"
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())

    def of_block(seeded: Broadcast) -> DataFrame:
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(d, *m) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in seeded.value.matches(t, threshold)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in schema.split(", ")])

        return rows.mapInArrow(search, schema)

    return reduce(DataFrame.unionByName, [of_block(b) for b in _seeded(rows, items, item_col, text, block_chars)])


def with_leak_score(docs: DataFrame, items: DataFrame, threshold: float = 0.5, item_col: str = "item_id", text: str = "text", block_chars: int = 8_000_000) -> DataFrame:
    """``docs`` with ``leak_score``: the best score of ``contaminated`` of the row's text, 0 if there is none.

    Rows and other columns stay; a column called leak_score is replaced. Otherwise as ``contaminated``.
    """
    out = docs.drop("leak_score").withColumn("leak_score", F.lit(0.0))
    place = docs.drop("leak_score").columns.index(text)
    for seeded in _seeded(docs, items, item_col, text, block_chars):

        def score(batches: Iterator[pa.RecordBatch], seeded: Broadcast = seeded) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                own = [max([s, *(m[1] for m in seeded.value.matches(t, threshold))]) for t, s in zip(batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(own, pa.float64())], batch.schema.names)

        out = out.mapInArrow(score, out.schema)
    return out
