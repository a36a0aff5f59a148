"""Collocations: phrases whose words stand together more often than apart, from an FM-index of each shard of the words."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from lamella.llm.common import mix, pieces, stored
from lamella.llm.vocabulary import SHARD, Coder, dictionary, shard_numbers, with_global_ids

#: Small letters for capital ones, a line feed for what ends a piece, a space for a tab.
FOLD = bytes.maketrans(bytes(range(65, 91)) + b".,;:!?\x0b\x0c\r\t", bytes(range(97, 123)) + b"\n" * 9 + b" ")
#: Parts in which the best of a language are sought before they meet.
PARTS = 64


class TwoWayIndex:
    """A bidirectional FM-index of word numbers, 0 for a break, ordered by the first ``depth`` words of each suffix.

    A phrase of up to ``depth`` words is an interval of the index and one, as long, of the index of the reversed
    sequence; many phrases are handled at once, as arrays of ``lo``, ``back`` (where the two intervals begin) and ``size``.
    """

    def __init__(self, sequence: np.ndarray, depth: int) -> None:
        self.sigma = int(sequence.max(initial=0)) + 1
        self.starts = np.concatenate(([0], np.cumsum(np.bincount(sequence, minlength=self.sigma))))
        self.left, self.right = self._transform(sequence, depth), self._transform(sequence[::-1], depth)

    def _transform(self, sequence: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """The word before each suffix, in the order of suffixes, and the row to which the suffix with that word goes."""
        rank, sigma = sequence.astype(np.int64), self.sigma
        for j in range(1, depth):
            if int(rank.max(initial=0)) >= (1 << 62) // sigma:
                rank = np.unique(rank, return_inverse=True)[1]
            rank = rank * sigma + np.roll(sequence, -j)
        before = np.roll(sequence, 1)[np.argsort(rank, kind="stable")]
        follow = np.empty(len(before), dtype=np.int64)
        follow[np.argsort(before, kind="stable")] = np.arange(len(before))
        return before, follow

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The words themselves, and their intervals."""
        size = np.diff(self.starts)
        word = np.flatnonzero(size[1:]) + 1
        return word, self.starts[word], self.starts[word], size[word]

    def _extend(self, table: tuple[np.ndarray, np.ndarray], lo: np.ndarray, other: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        before, follow = table
        ends = np.cumsum(size)
        start = ends - size
        of = np.repeat(np.arange(len(lo)), size)
        rows = np.arange(len(of)) + (lo - start)[of]
        key = of * self.sigma + before[rows]
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(key)), dtype=bool), key[1:] != key[:-1])))
        count = np.diff(np.concatenate((first, [len(key)])))
        of, word = key[first] // self.sigma, key[first] % self.sigma
        real = word > 0
        of, word, first, count = of[real], word[real], first[real], count[real]
        return of, word, follow[rows[order[first]]], other[of] + first - start[of], count

    def extend_left(self, lo: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each phrase with each word that stands before it: which phrase, which word, the intervals."""
        return self._extend(self.left, lo, back, size)

    def extend_right(self, lo: np.ndarray, back: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, ...]:
        """Each phrase with each word that stands behind it, likewise."""
        of, word, back, lo, count = self._extend(self.right, back, lo, size)
        return of, word, lo, back, count

    def phrases(self, names: np.ndarray, depth: int, maybe: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The phrases of ``depth`` words, a row of ``names`` each, and how often they occur, but those with a part that ``maybe`` rules out.

        Phrases grow to the right and to the left in turn. ``maybe`` has a bitmap of phrases for each length.
        """
        word, lo, back, size = self.words()
        grown = names[word].reshape(-1, 1)
        for length in range(2, depth + 1):
            right = length % 2 == 0
            of, word, lo, back, size = (self.extend_right if right else self.extend_left)(lo, back, size)
            grown = np.column_stack((grown[of], names[word]) if right else (names[word], grown[of]))
            keep = np.ones(len(grown), dtype=bool)
            for part in (grown[:, 1:], grown[:, :-1]) if length > 2 else ():
                keep &= has_bit(maybe[length - 1], part)
            grown, lo, back, size = grown[keep], lo[keep], back[keep], size[keep]
        return grown, size


def bit_of(phrases: np.ndarray, bits: int) -> np.ndarray:
    """A place among ``bits`` for each row of numbers of words."""
    key = np.zeros(len(phrases), dtype=np.uint64)
    for column in phrases.T:
        key = mix(key * np.uint64(3) + column.astype(np.uint64))
    return (key % np.uint64(bits)).astype(np.int64)


def has_bit(bitmap: np.ndarray, phrases: np.ndarray) -> np.ndarray:
    at = bit_of(phrases, 8 * len(bitmap))
    return (bitmap[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1


def bitmap_of(grams: DataFrame, names: list[str], most: int = 1 << 30) -> np.ndarray:
    """A bitmap of the phrases in ``grams``, with 16 bits for each, a power of two, and ``most`` in all.

    It says of some others too that they may be there: that costs time, never a phrase.
    """
    bits = min(most, max(1 << 18, 1 << (16 * grams.count()).bit_length()))

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = bit_of(np.column_stack([c.to_numpy() for c in batch.columns]), bits)
            yield pa.RecordBatch.from_arrays([pa.array(at + 1)], ["at"])  # Spark counts from 1

    at = grams.select(*names).mapInArrow(places, "at long")
    slices = at.groupBy(F.bitmap_bucket_number("at").alias("slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits"))
    bitmap = np.zeros(bits // 8, dtype=np.uint8)
    for row in slices.toLocalIterator():
        part = np.frombuffer(row["bits"], dtype=np.uint8)
        bitmap[(row["slice"] - 1) * len(part) :][: len(part)] = part
    return bitmap


def word_shards(docs: DataFrame, by: str = "lang", text: str = "text") -> DataFrame:
    """``shard, by, sequence, words, uses``: the words of documents as numbers into ``words``, from 1, with a 0 behind each piece.

    A-Z are lower-cased; ``.,;:!?``, line feeds and their like end a piece; spaces and tabs separate words. A task
    makes the shards of what it reads, of about ``SHARD`` words of one value of ``by``, so texts aren't shuffled.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers = shard_numbers(TaskContext.get().partitionId())
        open_: dict[str, tuple[Coder, list[np.ndarray]]] = {}
        sizes: dict[str, int] = {}

        def shard(name: str) -> pa.RecordBatch:
            coder, found = open_.pop(name)
            del sizes[name]
            sequence = np.concatenate(found)
            uses = np.bincount(sequence, minlength=len(coder))[1:]
            words = pa.array(list(coder)[1:], pa.binary()).cast(pa.string())
            listed = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x) for x in (words, pa.array(uses, pa.int64()))]
            return pa.RecordBatch.from_arrays([pa.array([next(numbers)], pa.int64()), pa.array([name]), pa.array([sequence.astype("<i4").tobytes()], pa.binary()), *listed], ["shard", by, "sequence", "words", "uses"])

        for batch in pieces(batches, 64):
            for name, data in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                coder, found = open_.setdefault(name, (Coder({b"\n": 0}), []))
                tokens = []
                for piece in data.translate(FOLD).split(b"\n"):
                    if words := piece.split():
                        tokens += words
                        tokens.append(b"\n")
                found.append(np.fromiter(map(coder.__getitem__, tokens), dtype=np.int32, count=len(tokens)))
                sizes[name] = sizes.get(name, 0) + len(tokens)
                if sizes[name] >= SHARD:
                    yield shard(name)
        for name in list(open_):
            yield shard(name)

    rows = docs.select(F.coalesce(F.col(f"`{by}`").cast("string"), F.lit("und")).alias(by), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    return rows.mapInArrow(build, f"shard long, `{by}` string, sequence binary, words array<string>, uses array<long>")


def phrase_counts(shards: DataFrame, longest: int, least: int) -> DataFrame:
    """``ids, a``: the phrases of 2 to ``longest`` words, as numbers of words, that occur ``least`` times or more.

    ``shards`` has ``sequence`` and ``ids``, the number of each of its words, 0 for a word that no phrase may hold. Each
    shard is indexed in its task and its phrases are read off the intervals; what shards have is summed. Lengths are
    counted one after another: a phrase comes forward only if both its shorter parts are frequent in all shards together.
    """
    spark, found, maybe = shards.sparkSession, [], {}
    for length in range(2, longest + 1):
        names = [f"w{i + 1}" for i in range(length)]
        known = spark.sparkContext.broadcast(maybe)

        def count(batches: Iterator[pa.RecordBatch], length: int = length, names: list[str] = names, known=known) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            for batch in batches:
                for i in range(len(batch)):
                    local = np.frombuffer(batch.column(0)[i].as_py(), dtype="<i4")
                    ids = np.concatenate(([0], batch.column(1)[i].values.to_numpy()))
                    may = np.flatnonzero(ids)
                    place = np.zeros(len(ids), dtype=np.int32)
                    place[may] = np.arange(1, len(may) + 1)
                    sequence = np.concatenate((place[local], np.zeros(1, dtype=np.int32)))
                    grown, size = TwoWayIndex(sequence, length).phrases(np.concatenate(([0], ids[may])), length, known.value)
                    for at in range(0, len(grown), 1 << 16):
                        some = grown[at : at + (1 << 16)]
                        yield pa.RecordBatch.from_arrays([*[pa.array(c) for c in some.T], pa.array(size[at : at + (1 << 16)].astype(np.int64))], [*names, "n"])

        each = shards.select("sequence", "ids").mapInArrow(count, ", ".join(f"{c} long" for c in [*names, "n"]))
        grams = stored(each.groupBy(*names).agg(F.sum("n").alias("a")).where(F.col("a") >= least), f"phrases-{length}")
        found.append(grams.select(F.array(*names).alias("ids"), "a"))
        if length < longest:
            maybe = {**maybe, length: bitmap_of(grams, names)}
    return reduce(DataFrame.unionByName, found)


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000, by: str = "lang", text: str = "text") -> DataFrame:
    """The ``top`` phrases of each ``by`` (null: ``und``): ``by, rank, phrase, a, l, r, n, score``.

    Candidates have 2 to ``longest`` words and occur ``least`` times or more (``a``). Cut in two where it holds least, a phrase
    has ``score = floor(1000000 * a * a / (l * r))``, ``l`` and ``r`` being how often its parts occur; of equal cuts the first
    counts. Candidates that lie inside a longer one with ``share`` percent of their occurrences or more are dropped. ``n`` is
    the number of words of all the ``by``. Ranks go by score, ``a`` and the bytes of the phrase.

    All parts of a candidate occur as often as it does, so words rarer than ``least`` end phrases like a stop. Counts are of
    all documents; repeated documents count each time. Null and empty texts have no words; a ``by`` without candidates has no rows.
    """
    local = stored(word_shards(docs, by, text), "word-shards")
    known = dictionary(local, [by], least)
    grams = phrase_counts(stored(with_global_ids(local, known, [by]), "numbered-shards"), longest, least)
    parts = grams.select("ids", F.col("a").alias("f")).unionByName(known.select(F.array("id").alias("ids"), F.col("n").alias("f")))

    size = F.size("ids")
    cuts = grams.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cuts = cuts.select("ids", "a", "k", F.slice("ids", F.lit(1), F.col("k")).alias("first"), F.slice("ids", F.col("k") + 1, size - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.select(F.col("ids").alias("first"), F.col("f").alias("l")), "first").join(parts.select(F.col("ids").alias("rest"), F.col("f").alias("r")), "rest")
    # 1000000 * a * a stays below 10 ** 37, so the quotient is exact
    score = F.expr("cast(1000000 as decimal(7,0)) * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast(l as decimal(15,0)) * cast(r as decimal(15,0)))")
    scored = cuts.withColumn("score", score).groupBy("ids").agg(F.first("a").alias("a"), F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    # what lies in a longer candidate lies in one longer by a word, which occurs as often or more
    longer = grams.where(size > 2).select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1))).alias("ids"), F.col("a").alias("more"))
    scored = scored.join(longer.groupBy("ids").agg(F.max("more").alias("more")), "ids", "left").where(F.coalesce(100 * F.col("more") < share * F.col("a"), F.lit(True)))

    spelt = scored.select("ids", "a", "cut", F.posexplode("ids").alias("at", "id")).join(known.select("id", by, "word"), "id")
    spelt = spelt.groupBy("ids").agg(F.first(by).alias(by), F.first("a").alias("a"), F.first("cut").alias("cut"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("words"))
    spelt = spelt.select(by, F.array_join(F.col("words.word"), " ").alias("phrase"), "a", "cut.l", "cut.r", "cut.score", F.pmod(F.hash("ids"), F.lit(PARTS)).alias("_part"))
    best = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of each part first, so that what meets in one task is PARTS * top rows at most
    near = spelt.withColumn("rank", F.row_number().over(Window.partitionBy(by, "_part").orderBy(*best))).where(F.col("rank") <= top)
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy(by).orderBy(*best)).cast("long")).where(F.col("rank") <= top)
    total = local.select(by, F.aggregate("uses", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy(by).agg(F.sum("n").alias("n"))
    return ranked.join(total, by).select(by, "rank", "phrase", "a", "l", "r", "n", "score")
