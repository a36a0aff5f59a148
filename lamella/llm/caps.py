"""Near-duplicate vectors by spherical caps: each vector goes to all directions of product codes that it points along."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamella.llm.common import connected_components, cut, mix, pieces, stored

#: Codes, each turned at random on its own, and blocks of coordinates in each code's words.
CODES, BLOCKS = 3, 4
#: Vectors have at least so many coordinates; shorter ones get zeros, which change no cosine.
LEAST_DIMS = 16
#: Caps with more members are compared in pieces, a pair of pieces at a time.
CELL = 1024


@cache
def code(which: int, dims: int, words: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """A rotation of all coordinates, and for each block of them ``words`` vectors of length half, so that a direction has length 1."""
    draw = np.random.default_rng([which, dims, words])
    turn = np.linalg.qr(draw.standard_normal((dims, dims)))[0]
    blocks = [draw.standard_normal((len(b), words)) for b in np.array_split(np.arange(dims), BLOCKS)]
    return turn, [b / np.linalg.norm(b, axis=0) / np.sqrt(BLOCKS) for b in blocks]


def words_for(n: int) -> int:
    """Words in a block, for ``n`` vectors: directions grow faster than they do, so that strangers seldom share one."""
    return max(16, ceil(6 * n**0.25))


def margin_for(dims: int, cosine: float) -> float:
    """How far below its best direction's cosine a vector still counts as inside a cap.

    Between two vectors with ``cosine``, the cosines with a direction differ by their distance over the root of ``dims`` or so; the margin
    is 1.1 times that. Such a pair then shares no cap of one code about once in a thousand times, and of three once in 10 ** 9.
    """
    return 1.1 * np.sqrt((2 - 2 * cosine) / max(dims, LEAST_DIMS))


def caps_of(unit: np.ndarray, margin: float, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Which of the unit vectors lie in which caps of all codes, as pairs of row and cap.

    A direction is a word for each block; the cap around it holds what has a cosine with it within ``margin`` of the
    vector's best. Words are chosen block by block, and a choice is given up as soon as the best words of the blocks to
    come can't make up for it, so the caps are listed without looking at all directions.
    """
    rows, caps = [], []
    for which in range(CODES):
        turn, blocks = code(which, unit.shape[1], words)
        parts = np.split(unit @ turn, np.cumsum([len(b) for b in blocks])[:-1], axis=1)
        scores = [p @ b for p, b in zip(parts, blocks, strict=True)]
        hope = np.cumsum([s.max(axis=1) for s in scores[::-1]], axis=0)[::-1]
        least = hope[0] - margin - 1e-12
        row, total, name = np.arange(len(unit)), np.zeros(len(unit)), np.zeros(len(unit), dtype=np.int64)
        for i, s in enumerate(scores):
            grown = total[:, None] + s[row]
            rest = hope[i + 1][row] if i + 1 < BLOCKS else 0.0
            at, word = np.nonzero(grown >= (least[row] - rest)[:, None])
            row, total, name = row[at], grown[at, word], name[at] * words + word
        rows.append(row)
        caps.append(name.view(np.uint64) * np.uint64(CODES) + np.uint64(which))
    return np.concatenate(rows), np.concatenate(caps)


def unit_vectors(vectors: DataFrame, id_col: str, vector: str, by: str) -> DataFrame:
    """``vec_id, by, unit, same``: vectors divided by their length, packed as doubles, and a digest of vector and ``by``.

    ``unit`` is null where nothing can be compared: ``by`` or vector null or empty, a component null or not finite, or all zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 4096):
            units, same = [], []
            for label, row in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                x = row.values.to_numpy(zero_copy_only=False).astype(np.float64) + 0.0 if label is not None and row.is_valid and row.values.null_count == 0 else np.zeros(0)
                most = np.abs(x).max(initial=0.0)
                if not 0 < most < np.inf:
                    units.append(None)
                    same.append(None)
                    continue
                same.append(hashlib.blake2b(label.encode() + b"\0" + x.tobytes(), digest_size=16).digest())
                x = x / most if not 1e-100 < most < 1e100 else x  # the square of very small or large numbers is none
                units.append((x / np.sqrt(x @ x)).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(units, pa.binary()), pa.array(same, pa.binary())], ["vec_id", "by", "unit", "same"])

    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{by}`").cast("string").alias("by"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))
    return rows.mapInArrow(run, "vec_id long, by string, unit binary, same binary")


def in_caps(nodes: DataFrame, words: int, cosine: float) -> DataFrame:
    """``key, node``: each vector once for each cap that it lies in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 256):
            node = batch.column(0).to_numpy()
            label = np.array([int.from_bytes(hashlib.blake2b(b.encode(), digest_size=8).digest(), "big") for b in batch.column(1).to_pylist()], dtype=np.uint64)
            raw = batch.column(2).to_pylist()
            size = np.array([len(r) // 8 for r in raw])
            for dims in np.unique(size):
                own = np.flatnonzero(size == dims)
                unit = np.zeros((len(own), max(dims, LEAST_DIMS)))
                unit[:, :dims] = np.frombuffer(b"".join(raw[i] for i in own)).reshape(len(own), dims)
                row, cap = caps_of(unit, margin_for(dims, cosine), words)
                key = mix(mix(cap) ^ mix(label[own][row] + np.uint64(dims))).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node[own][row])], ["key", "node"])

    return nodes.select("node", "by", "unit").mapInArrow(run, "key long, node long")


def _compared(key: int, node: np.ndarray, side: np.ndarray | None, weight: np.ndarray, unit: np.ndarray, keys: list[np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the members of a cap: how much weight each is linked to here, and links that connect what is linked, as places.

    A pair that meets in several caps counts in the one with the least key. ``side`` says which of two pieces a member is of.
    """
    linked = unit @ unit.T >= cosine
    np.fill_diagonal(linked, False)
    if side is not None:
        linked &= side[:, None] != side[None, :]
    if linked.any():
        some = np.flatnonzero(linked.any(axis=1))
        before = [keys[i][: np.searchsorted(keys[i], key)] for i in some]
        owner, flat = np.repeat(some, [len(b) for b in before]), np.concatenate(before)
        order = np.argsort(flat, kind="stable")
        owner, flat = owner[order], flat[order]
        first = np.flatnonzero(np.concatenate((np.ones(min(1, len(flat)), dtype=bool), flat[1:] != flat[:-1])))
        for a, b in zip(first, np.append(first, len(flat))[1:], strict=True):
            if b - a > 1:
                linked[np.ix_(owner[a:b], owner[a:b])] = False
    total = linked.astype(np.float64) @ weight.astype(np.float64)
    src, dst, left = [], [], np.ones(len(node), dtype=bool)
    for start in np.flatnonzero(linked.any(axis=1)):
        if not left[start]:
            continue
        left[start], front = False, np.array([start])
        while len(front):
            front = np.flatnonzero(linked[front].any(axis=0) & left)
            left[front] = False
            src += [start] * len(front)
            dst += front.tolist()
    return total, np.array(src, dtype=np.int64), np.array(dst, dtype=np.int64)


def near_vectors(vectors: DataFrame, cosine: float = 0.98, id_col: str = "vec_id", vector: str = "embedding", by: str = "label") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every vector: how many others of the same ``by`` have a cosine of ``cosine`` or more with it.

    ``component_id`` is the smallest id that links reach, ``kept`` says whether it is the vector's own. Equal vectors are one node with a weight.
    Each node goes to the caps it lies in; those that share a cap are compared in double precision, each pair in the first cap that
    both lie in, so nothing is counted twice and no pair is sent anywhere: a cap gives sums and links that span what is linked.
    Caps of over ``CELL`` members are compared in pieces, every pair of pieces on its own, whatever their number. Two vectors with
    just ``cosine`` share no cap once in about 10 ** 9 times, nearer ones less.

    Vectors that are null, empty or zero, hold null or non-finite components or have a null ``by`` link with nothing and keep their id. Vectors
    of different lengths don't link. Repeated ids are vectors of their own; a null id counts and links but names no component unless
    alone (null). No rows give none.
    """
    table = cut(unit_vectors(vectors, id_col, vector, by))
    real = table.where("unit is not null")
    nodes = real.groupBy("same").agg(F.first("by").alias("by"), F.first("unit").alias("unit"), F.count("*").alias("weight"), F.min("vec_id").alias("low"))
    nodes = stored(nodes.withColumn("node", F.monotonically_increasing_id()), "vectors")
    keyed = cut(in_caps(nodes, words_for(nodes.count()), cosine))
    crowds = keyed.groupBy("key").agg(F.ceil(F.count("*") / CELL).cast("int").alias("n"), F.count("*").alias("size")).where("size > 1").drop("size")
    lists = keyed.join(crowds, "key").groupBy("node").agg(F.sort_array(F.collect_list(F.struct("key", "n"))).alias("keys"))
    cell = F.explode("keys").alias("cell")
    met = nodes.join(lists, "node").select("node", "by", "unit", "weight", F.col("keys.key").alias("keys"), cell)
    piece = F.pmod(F.xxhash64("node"), F.col("cell.n")).cast("int")
    met = met.select("cell.key", piece.alias("piece"), F.explode(F.sequence(F.lit(0), F.col("cell.n") - 1)).alias("other"), "node", "by", "unit", "weight", "keys")
    met = met.select("key", F.least("piece", "other").alias("low"), F.greatest("piece", "other").alias("high"), "piece", "node", "by", "unit", "weight", "keys")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place: tuple | None = None
        held: list[tuple] = []

        def done() -> pa.RecordBatch:
            src, dst, total = [], [], []
            kinds: dict[tuple, list[tuple]] = {}
            for row in held:
                kinds.setdefault((row[2], len(row[3])), []).append(row)
            for (_, dims), rows in kinds.items():
                if len(rows) > 1:
                    piece, node, _, unit, weight, keys = zip(*rows, strict=True)
                    node = np.array(node)
                    side = None if place[1] == place[2] else np.array(piece)
                    found, a, b = _compared(place[0], node, side, np.array(weight), np.frombuffer(b"".join(unit)).reshape(-1, dims // 8), keys, cosine)
                    hit = np.flatnonzero(found)
                    src += [node[hit], node[a]]
                    dst += [np.full(len(hit), -1), node[b]]
                    total += [found[hit].astype(np.int64), np.zeros(len(a), dtype=np.int64)]
            columns = [np.concatenate(c) if c else np.zeros(0, dtype=np.int64) for c in (src, dst, total)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["src", "dst", "n"])

        for batch in pieces(batches, 256):
            keys = [k.values.to_numpy() for k in batch.column("keys")]
            for key, low, high, *row, own in zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "piece", "node", "by", "unit", "weight")), keys, strict=True):
                if (key, low, high) != place:
                    if len(held) > 1:
                        yield done()
                    place, held = (key, low, high), []
                held.append((*row, own))
        if len(held) > 1:
            yield done()

    count = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = cut(met.repartition(count, "key", "low", "high").sortWithinPartitions("key", "low", "high", "node").mapInArrow(search, "src long, dst long, n long"))
    links = found.where("dst < 0").groupBy(F.col("src").alias("node")).agg(F.sum("n").alias("n"))
    reached = connected_components(found.where("dst >= 0"))
    named = nodes.join(links, "node", "left").join(reached, "node", "left").select("same", "low", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    least = named.groupBy("component").agg(F.min("low").alias("component_id"))
    named = named.join(least, "component").select("same", "n_links", "component_id")
    every = table.select("vec_id", "same").join(named, "same", "left")
    own = F.coalesce(F.col("component_id"), F.col("vec_id"))
    return every.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("vec_id") == own, F.lit(False)).alias("kept"))
