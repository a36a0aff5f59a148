"""What several text operators share: hashing of words, durable cuts of lineage, components."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"n": 0}
#: Buckets in which common shingles are counted, and from how many documents on one is common.
LEVELS, CROWD = 1 << 20, 64


def folder(spark: SparkSession) -> str:
    """The shared folder that the session names in ``spark.checkpoint.dir``, or its checkpoint folder.

    Where none is named, one is made if driver and tasks share a machine, as in tests; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named and not spark.sparkContext.master.startswith("local["):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return (named or tempfile.mkdtemp(prefix="spark-")).rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in the cluster's checkpoint folder, so that lost executors cost no recomputation."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(folder(df.sparkSession))
    return df.checkpoint(eager=True)


def unused(name: str, columns: list[str]) -> str:
    """``name`` behind as many underscores as make it differ from all of ``columns``, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def _maybe(df: DataFrame, ids: DataFrame, bits: int = 1 << 23) -> DataFrame:
    """``df`` with ``maybe``: false where its id is surely none of ``ids`` (both have one called ``doc_id``).

    The ids are hashed into a bitmap, a megabyte whatever their number, that is broadcast by slices.
    """
    place = F.pmod(F.xxhash64("doc_id"), F.lit(bits))
    slices = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("_slice")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits"))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("_bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    joined = df.join(F.broadcast(slices), F.bitmap_bucket_number(place) == F.col("_slice"), "left")
    return joined.withColumn("maybe", F.coalesce(F.getbit(byte, (at % 8).cast("int")) == 1, F.lit(False))).drop("_slice", "_bits")


def only(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` that may have one of ``ids``: what goes into a join on the id, so that the rest isn't shuffled."""
    return _maybe(df, ids).where("maybe").drop("maybe")


def without(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``df`` whose ``doc_id`` is none of ``ids``; only rows that may have one are shuffled. Null ids stay."""
    marked = _maybe(df, ids)
    return marked.where("not maybe").drop("maybe").unionByName(marked.where("maybe").drop("maybe").join(ids, "doc_id", "left_anti"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's checkpoint folder and read it again."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if _powers["n"] < n:
        size = max(n, 2 * _powers["n"], 1 << 16)
        for name, base in (("pow", _BASE), ("inv", _INVERSE)):
            col = np.full(size, base, dtype=np.uint64)
            col[0] = 1
            _powers[name] = np.cumprod(col)
        _powers["n"] = size
    return _powers["pow"], _powers["inv"]


def pieces(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that what is unpacked at a time stays small."""
    for batch in batches:
        for at in range(0, len(batch), rows):
            yield batch.slice(at, rows)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A hash of each span of 64-bit ``values``, read off one running sum."""
    power, inverse = _tables(len(values))
    total = np.concatenate((np.zeros(1, dtype=np.uint64), np.cumsum(values * power[: len(values)])))
    return mix((total[ends] - total[starts]) * inverse[starts] ^ mix((ends - starts).astype(np.uint64)))


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end of each run of bytes that aren't ASCII white space.

    Each hash is read off one running sum over the text, so the cost is a few vector passes.
    """
    if not data:
        none = np.zeros(0, dtype=np.int64)
        return none.astype(np.uint64), none, none
    raw = np.frombuffer(data, dtype=np.uint8)
    gap = np.concatenate(([True], _SPACE[raw], [True]))
    edge = gap[1:] != gap[:-1]
    at = np.flatnonzero(edge)
    starts, ends = at[0::2], at[1::2]
    return spans(raw.astype(np.uint64) + np.uint64(1), starts, ends), starts, ends


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of ``k`` words; fewer words make one run of all; none, none."""
    if len(hashes) == 0:
        return hashes
    k = min(k, len(hashes))
    out = np.zeros(len(hashes) - k + 1, dtype=np.uint64)
    for i in range(k):
        out = out * np.uint64(_BASE) + hashes[i : len(hashes) - k + 1 + i]
    return mix(out)


def shingle_set(text: str, width: int) -> np.ndarray:
    """The distinct hashes of the runs of ``width`` words, A-Z lower-cased."""
    return np.unique(shingles(words(text.encode().lower())[0], width))


def token_chunks(texts: list[str | None], size: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of the first text, words, where each text's begin and the last one's end) of about ``size`` bytes of texts at a time, A-Z lower-cased.

    Short texts cost a few passes together, not each.
    """
    held: list[bytes] = []
    first, n = 0, 0
    for i, text in enumerate(texts):
        held.append((text or "").encode().lower())
        n += len(held[-1]) + 1
        if n >= size or i == len(texts) - 1:
            tokens, starts, _ = words(b"\n".join(held))
            yield first, tokens, np.concatenate(([0], np.searchsorted(starts, np.cumsum([len(t) + 1 for t in held]))))
            held, first, n = [], i + 1, 0


def whole(edges: np.ndarray, k: int) -> np.ndarray:
    """Starts of the runs of ``k`` places inside one text each, where texts lie between neighbouring ``edges``."""
    n = np.maximum(np.diff(edges) - k + 1, 0)
    return np.arange(n.sum()) + np.repeat(edges[:-1] - np.cumsum(n) + n, n)


def bucket_of(hashes: np.ndarray) -> np.ndarray:
    return (hashes % np.uint64(LEVELS)).view(np.int64)


def crowd_levels(rows: DataFrame, width: int) -> np.ndarray:
    """How common shingles are, by ``LEVELS`` buckets of their hashes: the rounded logarithm of the documents, 0 for most.

    Each task counts by buckets and sends those only that stand out in it, so this stays small whatever the input. What
    it misses costs time later, never a link: any order of shingles that all documents share will do.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(LEVELS, dtype=np.int64)
        for batch in pieces(batches):
            for _, tokens, edges in token_chunks(batch.column(0).to_pylist()):
                length = np.diff(edges)
                for i in np.flatnonzero((length > 0) & (length < width)).tolist():
                    np.add.at(count, bucket_of(shingles(tokens[edges[i] : edges[i + 1]], width)), 1)
                if length.max(initial=0) < width:
                    continue
                base = shingles(tokens, width)[whole(edges, width)]
                text = np.repeat(np.arange(len(length)), np.maximum(length - width + 1, 0))
                own = base + mix(text.astype(np.uint64) + np.uint64(1))  # differs where shingle or text do
                order = np.argsort(own)
                own = own[order]
                np.add.at(count, bucket_of(base[order[np.concatenate(([True], own[1:] != own[:-1]))]]), 1)
        at = np.flatnonzero(count >= max(8.0, 4 * count.mean()))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(count[at])], ["bucket", "n"])

    found = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") >= CROWD).collect()
    level = np.zeros(LEVELS, dtype=np.uint8)
    for r in found:
        level[r["bucket"]] = int(r["n"]).bit_length()
    return level


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", rounds: int = 60) -> DataFrame:
    """``node, component`` for every node of ``edges``: the component's smallest node.

    Alternates linking each node's larger neighbours, then its smaller ones, to the least of them.
    Every round is a handful of key joins and leaves at most as many edges as before; a round that
    changes nothing ends it. Nulls and loops are ignored; no edges give no rows.
    """
    e = edges.select(F.col(src).cast("long").alias("u"), F.col(dst).cast("long").alias("v")).where("u != v")
    e = cut(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def signature(x: DataFrame):
        return tuple(x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def least_of(x: DataFrame) -> DataFrame:
        return x.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))

    before = signature(e)
    for _ in range(rounds if before[0] else 0):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least_of(both), "u").where("v > u and v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = least_of(large)
        small = large.join(low, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u != v").distinct())
        after = signature(e)
        if after == before:
            break
        before = after
    else:
        if before[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
