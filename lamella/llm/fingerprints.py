"""Document fingerprints from prefix polynomial hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from lamella.llm.common import mix

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_812_433_253)
#: Code points in a window, and windows kept in a fingerprint.
WINDOW, BINS = 16, 64
_P = np.uint64(PRIME)
_S = np.uint64(31)
INVERSES = {b: pow(b, -1, PRIME) for b in BASES}
RANGES = np.arange(BINS, dtype=np.uint64)
FLOORS = RANGES << np.uint64(58)
_powers: dict[int, np.ndarray] = {}


def _folded(x: np.ndarray) -> np.ndarray:
    """A number congruent to ``x`` modulo the Mersenne prime, 31 bits shorter or nearly reduced."""
    return (x & _P) + (x >> _S)


def _reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo the Mersenne prime."""
    x = _folded(_folded(_folded(x)))
    return np.minimum(x, x - _P)  # below the prime the difference wraps round


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None:
        have = np.ones(1, dtype=np.uint64)
    while len(have) < n:
        have = np.concatenate((have, _reduced(have * np.uint64(pow(base, len(have), PRIME)))))
    _powers[base] = have
    return have[:n]


class PrefixHash:
    """Prefix hash arrays of a text, one for each base: any span's hash comes from two of their entries."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64) + np.uint64(1)
        self.text, self.n, self._values = text, len(codes), None
        self.prefix = []
        for base in BASES:
            sums = np.zeros(self.n + 1, dtype=np.uint64)
            np.cumsum(_folded(codes * _power(base, self.n)), out=sums[1:])
            self.prefix.append(sums)

    def spans(self, starts: np.ndarray | slice, ends: np.ndarray | slice) -> np.ndarray:
        """Hashes of the spans, which depend on their characters only."""
        parts = [_reduced(_folded(prefix[ends] - prefix[starts]) * _power(INVERSES[base], self.n + 1)[starts]) for base, prefix in zip(BASES, self.prefix, strict=True)]
        return (parts[0] << _S) | parts[1]

    def span(self, start: int, end: int) -> int:
        out = 0
        for base, prefix in zip(BASES, self.prefix, strict=True):
            out = out << 31 | (int(prefix[end]) - int(prefix[start])) * int(_power(INVERSES[base], self.n + 1)[start]) % PRIME
        return out

    def values(self) -> np.ndarray:
        """Scrambled hashes of all windows; a shorter text is one window, an empty one has none."""
        if self._values is None:
            if self.n >= WINDOW:
                hashes = self.spans(slice(0, self.n - WINDOW + 1), slice(WINDOW, self.n + 1))
            else:
                hashes = np.array([self.span(0, self.n)] if self.n else [], dtype=np.uint64)
            self._values = mix(hashes)
        return self._values

    def extension(self, at: int, other: "PrefixHash", there: int) -> int:
        """Length of the longest common extension of ``self[at:]`` and ``other[there:]``, by doubling, then binary search."""
        most = min(self.n - at, other.n - there)

        def same(size: int) -> bool:
            return self.span(at, at + size) == other.span(there, there + size)

        low, high = 0, 1
        while high <= most and same(high):
            low, high = high, 2 * high
        high = min(high - 1, most)
        while low < high:
            half = (low + high + 1) // 2
            if same(half):
                low = half
            else:
                high = half - 1
        return low


class Sketch:
    """A text's hash and 16 bits of its least window hash in each of ``BINS`` ranges (-1: none there)."""

    def __init__(self, whole: int, values: np.ndarray):
        self.whole, self.bins = whole, np.full(BINS, -1, dtype=np.int32)
        if len(values):
            values = np.sort(values)
            at = np.minimum(np.searchsorted(values, FLOORS), len(values) - 1)
            least = values[at]
            full = least >> np.uint64(58) == RANGES
            self.bins[full] = (least[full] & np.uint64(0xFFFF)).astype(np.int32)

    def __str__(self) -> str:
        if (self.bins >= 0).all():
            return f"{self.whole:016x}:" + self.bins.astype(">u2").tobytes().hex()
        return f"{self.whole:016x}:" + "".join("...." if b < 0 else f"{b:04x}" for b in self.bins.tolist())

    def likeness(self, other: "Sketch") -> float:
        """Share of the windows of either text that both have, as their least ones tell it: 1 for equal texts."""
        if self.whole == other.whole and (self.bins == other.bins).all():
            return 1.0
        some = (self.bins >= 0) | (other.bins >= 0)
        return float(((self.bins == other.bins) & some).sum() / max(1, some.sum()))


def sketch(h: PrefixHash) -> Sketch:
    return Sketch(h.span(0, h.n), h.values())


def joined(a: PrefixHash, cut: int, b: PrefixHash, end: int) -> Sketch:
    """The sketch of ``a[:cut] + b[:end]``: the windows inside either are known, those over the joint are hashed."""
    n = cut + end
    if n < WINDOW:
        return sketch(PrefixHash(a.text[:cut] + b.text[:end]))
    whole = 0
    for base, own, other in zip(BASES, a.prefix, b.prefix, strict=True):
        whole = whole << 31 | (int(own[cut]) + int(other[end]) * int(_power(base, cut + 1)[cut])) % PRIME
    known = [h.values()[: size - WINDOW + 1] for h, size in ((a, cut), (b, end)) if size >= WINDOW]
    joint = a.text[max(0, cut - WINDOW + 1) : cut] + b.text[: min(end, WINDOW - 1)]
    over = [PrefixHash(joint).values()] if cut and end and len(joint) >= WINDOW else []
    return Sketch(whole, np.concatenate(known + over))


def _bucket(key: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are below ``key``, by binary search."""
    if not bounds:
        return F.lit(0)
    cuts = F.array(*[F.lit(b).cast("long") for b in bounds])

    def step(s: Column, _: Column) -> Column:
        half = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        below = F.get(cuts, half) < key
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(below, half + 1).otherwise(s["lo"]).alias("lo"), F.when(below, s["hi"]).otherwise(half).alias("hi")))

    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(len(bounds).bit_length() + 1)), start, step)["lo"]


def in_descending_ranges(docs: DataFrame, id_col: str, text: str, parts: int) -> DataFrame:
    """Rows in ranges of ids, each range in one partition, descending, then the row that follows the range.

    The driver holds one bound and one highest id for each partition, no more. ``_tail`` marks the
    row that follows; after the last range comes the first row of all.
    """
    rows = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(-(1 << 63))).alias("_key"), F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ids = rows.select("_key")
    bounds = sorted({int(x) for x in ids.approxQuantile("_key", [i / parts for i in range(1, parts)], 0.1 / parts)}) if parts > 1 else []
    tops = {r["b"]: r["top"] for r in ids.groupBy(_bucket(F.col("_key"), bounds).alias("b")).agg(F.max("_key").alias("top")).collect()}
    order = sorted(tops)
    #: The first row of a range also goes behind the next higher one; that of the highest behind the lowest.
    behind = {tops[b]: order[(i + 1) % len(order)] for i, b in enumerate(order)}
    spark = docs.sparkSession
    extra = spark.createDataFrame(list(behind.items()) or [(None, None)], "_key long, _behind int")
    rows = rows.join(F.broadcast(extra), "_key", "left")  # a row for each partition at most
    own = F.struct(_bucket(F.col("_key"), bounds).cast("int").alias("part"), F.lit(False).alias("_tail"))
    places = F.when(F.col("_behind").isNull(), F.array(own)).otherwise(F.array(own, F.struct(F.col("_behind").alias("part"), F.lit(True).alias("_tail"))))
    placed = rows.select(F.explode(places).alias("_at"), "_key", "doc_id", "text").select("_at.*", "_key", "doc_id", "text")
    return placed.repartitionById(parts, F.col("part")).sortWithinPartitions("_tail", F.desc("_key"), "text").select("_tail", "doc_id", "text")


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, common_prefix long"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    held = None
    for batch in batches:
        out = []
        for tail, doc_id, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            following = (doc_id, h := PrefixHash(text), sketch(h))
            if held is not None:
                own_id, own, own_sketch = held
                half = own.n // 2
                cut, end = own.n - half, min(half, h.n)
                edited = joined(own, cut, h, end)
                digest = hashlib.sha256((own.text[:cut] + text[:end]).encode()).hexdigest()
                common = cut + own.extension(cut, h, 0) if end else cut
                out.append((own_id, own.n, digest, str(own_sketch), str(edited), own_sketch.likeness(edited), own_sketch.likeness(following[2]), min(common, cut + end)))
            held = following
            if tail:
                held = None
                break
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64(), pa.int64()), strict=True)], names)
        if held is None:
            return


def compared_fingerprints(docs: DataFrame, id_col: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Fingerprints of each text and of its edited text, and how like the former is to the latter's and the next one's.

    The edited text has its last half replaced by the beginning of the next document in descending
    order of ids (after the last: the first). Texts cross the network once, in ranges of ids; each
    partition is read as a stream that holds two texts.

    Null text: empty. Empty text: the zero fingerprint, like only itself. Null ids come last, as ties
    in order of text, as do repeated ids. One row alone is its own next. No rows give none. Other
    columns are not read.
    """
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return in_descending_ranges(docs, id_col, text, parts).mapInArrow(_compare, SCHEMA)
