"""Near-duplicate groups by SimHash, segment popcounts and a grid of their equal parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import combinations
from math import ceil, comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lamella.llm.common import bucket_of, connected_components, crowd_levels, cut, mix, only, pieces, shingle_set

#: Bits in a segment. Two random segments have the same count in 3 of 8 cases.
SEGMENT = 2
SAME = 0.375
#: Cells with more members are compared in pieces, a pair of pieces at a time.
CELL = 4096
#: Least hashes of a set that stand for it at first.
SKETCH = 128


def shingle_hashes(text: bytes, width: int, seed: int = 42) -> np.ndarray:
    """XXH64 of each run of ``width`` words, A-Z lower-cased; fewer words make one run; none, none."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = (ends - [len(t) + 1 for t in tokens]).tolist()
    last = (ends - 1).tolist()
    width = min(width, len(tokens))
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(starts, last[width - 1 :], strict=False)], dtype=np.uint64)


def fingerprint(hashes: np.ndarray) -> bytes:
    """Bits set in over half of the hashes, in 8 bytes; no hashes: zero."""
    if len(hashes) == 0:
        return bytes(8)
    raw = hashes.astype(">u8").view(np.uint8).reshape(-1, 8)
    count = np.zeros(64, dtype=np.int64)
    for i in range(0, len(raw), 255):
        count += np.add.reduce(np.unpackbits(raw[i : i + 255], axis=1), axis=0, dtype=np.uint8)
    return np.packbits(2 * count > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row; null and empty texts have the zero fingerprint."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            prints = [fingerprint(shingle_hashes(t or b"", width)) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.binary())], ["doc_id", "fp"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, "doc_id long, fp binary")


def grid_of(n: int, max_bits: int, bits: int = 64, crowd: int = 32, most: int = 8) -> list[list[int]]:
    """Parts of the segments of which two fingerprints at most ``max_bits`` apart have one equal in counts.

    A differing bit changes the Manhattan distance of the counts by one at most and lies in one block,
    so of ``max_bits + r`` blocks at least r agree in every count. ``r`` grows with the number of
    fingerprints until a cell is expected to hold ``crowd``; at any size all links are found.
    """
    segments = np.arange(bits // SEGMENT)
    for r in range(1, most + 1):
        blocks = np.array_split(segments, max_bits + r)
        if n * SAME ** (r * len(segments) / (max_bits + r)) <= crowd or comb(max_bits + r + 1, r + 1) > 500:
            break
    return [np.concatenate(pick).tolist() for pick in combinations(blocks, r)]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=">u8").reshape(-1, 1).astype(np.uint64)


def cells(nodes: DataFrame, parts: list[list[int]]) -> DataFrame:
    """``key, node, fp``: each fingerprint once for each part of the grid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = mix(np.arange(1, 64 // SEGMENT + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        for whole in batches:
            for at in range(0, len(whole), 4096):
                batch = whole.slice(at, 4096)
                raw = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(len(batch), -1)
                counts = np.unpackbits(raw, axis=1).reshape(len(batch), -1, SEGMENT).sum(axis=2, dtype=np.uint64)
                keys = [mix((counts[:, p] * weight[p]).sum(axis=1, dtype=np.uint64) + np.uint64(i)) for i, p in enumerate(parts)]
                for key in keys:
                    yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), batch.column(0), batch.column(1)], ["key", "node", "fp"])

    return nodes.select("node", "fp").mapInArrow(run, "key long, node long, fp binary")


def _forest(fp: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect what is connected within ``max_bits``: each member to the nearest one found before it."""
    left, out = np.arange(1, len(fp)), []
    front = np.zeros(1, dtype=np.int64)
    while len(left):
        best, parent = np.full(len(left), 1 << 30), np.zeros(len(left), dtype=np.int64)
        step = max(1, (1 << 20) // (len(left) * fp.shape[1]))
        for i in range(0, len(front), step):
            some = front[i : i + step]
            apart = np.bitwise_count(fp[some][:, None, :] ^ fp[left][None, :, :]).sum(axis=2, dtype=np.int64)
            near = apart.argmin(axis=0)
            low = apart[near, np.arange(len(left))]
            better = low < best
            best[better], parent[better] = low[better], some[near[better]]
        hit = best <= max_bits
        out += zip(parent[hit].tolist(), left[hit].tolist(), strict=True)
        front, left = left[hit], left[~hit]
        if len(front) == 0 and len(left):
            front, left = left[:1], left[1:]
    return out


def _links(key: np.ndarray, node: np.ndarray, fp: np.ndarray, max_bits: int) -> tuple[list[int], list[int]]:
    """Links inside each run of equal keys."""
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    size = np.diff(np.concatenate((first, [len(key)])))
    place, length = np.arange(len(key)) - np.repeat(first, size), np.repeat(size, size)
    rows, hits = np.flatnonzero((length > 1) & (length <= 64)), []
    for lag in range(1, int(length[rows].max(initial=1))):
        rows = rows[place[rows] >= lag]
        near = rows[np.bitwise_count(fp[rows] ^ fp[rows - lag]).sum(axis=1) <= max_bits]
        hits += zip((near - lag).tolist(), near.tolist(), strict=True)
    few: dict[int, list] = {}
    for a, b in hits:
        few.setdefault(int(a - place[a]), []).append((a, b))
    pairs = [p for found in few.values() if len(found) < 3 for p in found]
    for start in [s for s, found in few.items() if len(found) > 2] + first[size > 64].tolist():
        pairs += [(start + a, start + b) for a, b in _forest(fp[start : start + length[start]], max_bits)]
    pairs = [(int(node[a]), int(node[b])) for a, b in pairs if node[a] != node[b]]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def links(nodes: DataFrame, parts: list[list[int]], max_bits: int) -> DataFrame:
    """``src, dst``: links at most ``max_bits`` apart that share a cell; within a cell only enough to connect what is linked.

    Cells with more than ``CELL`` members are split into pieces, and each pair of pieces becomes a
    cell of its own, so that no task compares more than two pieces at a time.
    """
    keyed = cells(nodes, parts)
    crowded = cut(keyed.groupBy("key").count().where(F.col("count") > CELL))
    if crowded.limit(1).count():
        keyed = keyed.join(crowded, "key", "left").withColumn("n", F.coalesce(F.ceil(F.col("count") / CELL), F.lit(1)).cast("int"))
        piece = F.pmod(F.xxhash64("node"), F.col("n")).cast("int")
        other = F.explode(F.sequence(F.lit(0), F.col("n") - 1))
        keyed = keyed.select("key", "node", "fp", "n", piece.alias("piece"), other.alias("other"))
        keyed = keyed.select(F.when(F.col("n") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("piece", "other"), F.greatest("piece", "other"))).alias("key"), "node", "fp")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None

        def done(rows: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in _links(*rows, max_bits)], ["src", "dst"])

        for batch in batches:
            if not len(batch):
                continue
            new = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), _matrix(batch.column(2)))
            held = new if held is None else tuple(np.concatenate(p) for p in zip(held, new, strict=True))
            last = int(np.searchsorted(held[0], held[0][-1]))
            if last:
                yield done(tuple(p[:last] for p in held))
                held = tuple(p[last:] for p in held)
        if held is not None:
            yield done(held)

    count = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return keyed.repartition(count, "key").sortWithinPartitions("key", "node").mapInArrow(search, "src long, dst long")


def near_groups(docs: DataFrame, width: int = 5, max_bits: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` of every row: documents whose 64-bit fingerprints chain at ``max_bits`` or fewer bits.

    ``component_id`` is the smallest id that can be reached. Equal fingerprints are one node, so copies
    are never paired. Distinct fingerprints are embedded as bit counts of segments; those within
    ``max_bits`` agree in whole parts of the counts, so each goes to a few cells of a grid, and inside
    a cell the bits themselves decide. Nothing is left out at any size of cell or group.

    Null and empty texts have the zero fingerprint and link like any other. Repeated rows and ids give
    repeated rows with the same component. A null id is linked but never names a component (null if
    its group has no other). No rows give none. Other columns are not read.
    """
    table, nodes, found = _printed(docs, width, max_bits, id_col, text)
    reached = connected_components(found)
    named = nodes.join(reached, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return table.join(named, "fp").select("doc_id", "fp", "component_id")


def _printed(docs: DataFrame, width: int, max_bits: int, id_col: str, text: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Fingerprints of all rows, the least id of each fingerprint (``fp, node``), and links between these."""
    table = cut(fingerprints(docs, width, id_col, text))
    nodes = cut(table.groupBy("fp").agg(F.min("doc_id").alias("node")))
    known = nodes.where("node is not null")
    return table, nodes, links(known, grid_of(known.count(), max_bits), max_bits)


def near_links(docs: DataFrame, width: int = 5, max_bits: int = 4, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``src, dst``: links enough to connect each of the ``near_groups``, for joining with links of other kinds. Null ids have none."""
    table, nodes, found = _printed(docs, width, max_bits, id_col, text)
    return found.unionByName(table.join(nodes, "fp").where("doc_id != node").select(F.col("doc_id").alias("src"), F.col("node").alias("dst")))


def alike(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """Links that connect what is connected by Jaccard likenesses of ``similarity`` or more: each set to one found before it."""
    size = np.array([len(s) for s in sets])
    _, flat = np.unique(np.concatenate(sets), return_inverse=True)
    own = np.split(flat, np.cumsum(size)[:-1])
    mark = np.zeros(int(flat.max(initial=0)) + 1, dtype=bool)
    left, front, out = np.arange(len(sets)), [], []
    held = None
    while len(left):
        if not front:
            front, left, held = [int(left[0])], left[1:], None
            continue
        at = front.pop()
        if held is None:
            held = np.concatenate([own[i] for i in left]), np.concatenate(([0], np.cumsum(size[left])[:-1]))
        mark[own[at]] = True
        both = np.add.reduceat(mark[held[0]].astype(np.int32), held[1])
        mark[own[at]] = False
        hit = both >= similarity * (size[at] + size[left] - both) - 1e-9
        if hit.any():
            out += [(at, i) for i in left[hit].tolist()]
            front += left[hit].tolist()
            left, held = left[~hit], None
    return out


def near_copies(docs: DataFrame, similarity: float = 0.8, width: int = 5, id_col: str = "doc_id", text: str = "text", also: DataFrame | None = None) -> DataFrame:
    """``doc_id, component_id`` of documents whose shingle sets have a Jaccard likeness of ``similarity`` or more to another's, by chains.

    At such likenesses SimHash fingerprints differ in so many bits that no grid of them finds all links, so candidates
    come from the sets themselves, and none is missed: of two sets so alike, at least one is among the first
    ``n - similarity * n + 1`` of either's n shingles, in any order that all share. The order puts shingles that stand
    out as common last, so that a passage of very many documents brings none of them together.

    Each shingle's holders of like size meet the smallest of them, one row a holder; a few holders whose sizes and places of the
    shingle leave no room for enough in common don't. All that meet at one are compared by their ``SKETCH`` least
    hashes, which leaves out what is nowhere near; the rest are read and linked there by exact comparison, each set to one found before it, so a group of copies costs a row each, not one for every
    two; all holders of one shingle meet at the same one, so every link is seen. Crowds of over ``CELL`` sets or
    ``CELL * 500`` shingles are compared in pieces, each pair of pieces on its own. Equal sets are one node. A row is
    returned only where a document belongs to a group under another's id; ``component_id`` is the smallest id of the group.
    Chains also run over the links in ``also`` (src, dst; ids of documents), all found at once.

    Null and empty texts are equal to each other. Rows with null ids are left out. Rows with one id count as
    one document. No rows give none. Other columns are not read.
    """
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).where("doc_id is not null")
    shared = docs.sparkSession.sparkContext.broadcast(crowd_levels(rows, width))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t, width) for t in batch.column(1).to_pylist()]
            same = [hashlib.md5(own.tobytes()).digest() for own in sets]
            sketch = [(own[:SKETCH] >> np.uint64(32)).astype(np.uint32).tobytes() for own in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(sketch, pa.binary())], ["doc_id", "same", "sketch"])

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            same, size, firsts = [], [], []
            for t in batch.column(1).to_pylist():
                own = shingle_set(t, width)
                order = np.lexsort((own, shared.value[bucket_of(own)]))
                same.append(hashlib.md5(own.tobytes()).digest())
                size.append(len(own))
                firsts.append(own[order[: len(own) - ceil(similarity * len(own) - 1e-9) + 1]].view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(size, pa.int32()), pa.array(firsts, pa.list_(pa.int64()))], ["doc_id", "same", "size", "firsts"])

    table = cut(rows.mapInArrow(describe, "doc_id long, same binary, sketch binary"))
    nodes = rows.mapInArrow(prefixes, "doc_id long, same binary, size int, firsts array<long>").groupBy("same").agg(F.min(F.struct("doc_id", "size", "firsts")).alias("x"))
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keyed = nodes.select(F.posexplode("x.firsts").alias("place", "key"), F.col("x.doc_id").alias("node"), F.col("x.size").alias("size")).select("key", "size", "node", "place")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key and size of the row before, node of its run's first row
        for batch in batches:
            key, size, node, place = (c.to_numpy().astype(np.int64) for c in batch.columns)
            if not len(key):
                continue
            goes_on = last is not None and last[0] == key[0] and last[1] >= similarity * size[0] - 1e-9
            if goes_on:  # the run's first row stands before the rest of the run
                key, size, node, place = (np.concatenate(([x], c)) for x, c in zip((key[0], last[1], last[2], 0), (key, size, node, place), strict=True))
            new = np.concatenate(([True], (key[1:] != key[:-1]) | (size[:-1] < similarity * size[1:] - 1e-9)))
            first = np.flatnonzero(new)
            length = np.diff(np.concatenate((first, [len(key)])))
            run, at = np.repeat(np.arange(len(first)), length), np.arange(len(key)) - np.repeat(first, length)
            open_ = length > 16  # all of these are kept, and of a run that may reach into another batch
            open_[-1], open_[0] = True, open_[0] or goes_on
            keep = open_[run]
            rows = np.flatnonzero(~keep)
            for lag in range(1, 16):
                rows = rows[at[rows] >= lag]
                other = rows - lag
                most = np.minimum(size[rows] - place[rows], size[other] - place[other])  # if this shingle is the first that both have
                hopeful = most >= similarity / (1 + similarity) * (size[rows] + size[other]) - 1e-9
                keep[rows[hopeful]] = keep[other[hopeful]] = True
            center = np.minimum.reduceat(np.where(keep, np.arange(len(key)), len(key)), first)[run]
            sent = np.flatnonzero(keep & (center < len(key)))
            sent = sent[node[center[sent]] != node[sent]]
            last = key[-1], size[-1], node[center[-1]]
            yield pa.RecordBatch.from_arrays([pa.array(node[center[sent]]), pa.array(node[sent]), pa.array(size[sent], pa.int32())], ["center", "node", "size"])

    met = cut(keyed.repartition(count, "key").sortWithinPartitions("key", "size", "node").mapInArrow(meet, "center long, node long, size int").groupBy("center", "node").agg(F.max("size").alias("size")))

    def listed(met: DataFrame, weight: Column) -> DataFrame:
        """For each node the first ones it meets, with the number of pieces of their crowds."""
        crowds = met.groupBy("center").agg(F.ceil(F.greatest((F.count("*") + 1) / CELL, F.sum(weight) / (500 * CELL))).cast("int").alias("n"))
        met = met.join(crowds, "center").select("center", "n", "node").unionByName(crowds.select("center", "n", F.col("center").alias("node")))
        return cut(met.groupBy(F.col("node").alias("doc_id")).agg(F.collect_list(F.struct("center", "n")).alias("centers")))

    def shown(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            out = []
            for doc, seen, centers in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "seen", "centers")), strict=True):
                own = seen if isinstance(seen, bytes) else shingle_set(seen, width).tobytes()
                part = int(mix(np.array([doc]).view(np.uint64))[0])
                for c in centers:
                    out += [(c["center"], min(part % c["n"], o), max(part % c["n"], o), doc, own) for o in range(c["n"])]
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], ["center", "low", "high", "node", "own"])

    def linked(seen: DataFrame, kind: type, least: float) -> DataFrame:
        """``center, src, dst``: links inside each crowd, by the sets in ``seen`` (texts, or bytes of ``kind``)."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: tuple = (None,)
            nodes: list[int] = []
            sets: list[np.ndarray] = []

            def done() -> pa.RecordBatch:
                found = [(held[0], nodes[a], nodes[b]) for a, b in alike(sets, least)] if sets else []
                return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(3)], ["center", "src", "dst"])

            for batch in pieces(batches):
                for *place, node, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if tuple(place) != held:
                        yield done()
                        held, nodes, sets = tuple(place), [], []
                    nodes.append(node)
                    sets.append(np.frombuffer(own, dtype=kind))
            yield done()

        dealt = seen.mapInArrow(shown, "center long, low int, high int, node long, own binary").repartition(count, "center", "low", "high")
        return dealt.sortWithinPartitions("center", "low", "high", "node").mapInArrow(run, "center long, src long, dst long")

    # by sketches first: of sets so alike, if one lies in the other, the least hashes have s / (2 - s) in common, and 0.22 less only once in many millions of times
    asked = listed(met, F.lit(SKETCH))
    near = linked(only(table, asked.select("doc_id")).join(asked, "doc_id").select("doc_id", F.col("sketch").alias("seen"), "centers"), np.uint32, similarity / (2 - similarity) - 0.22)
    near = near.select("center", "src").unionByName(near.select("center", F.col("dst").alias("src"))).where("center != src").groupBy("center", F.col("src").alias("node")).agg(F.lit(0).alias("_"))
    asked = listed(cut(met.join(near, ["center", "node"]).select("center", "node", "size")), F.col("size"))
    found = linked(only(rows, asked.select("doc_id")).join(asked, "doc_id").select("doc_id", F.col("text").alias("seen"), "centers"), np.uint64, similarity).select("src", "dst")
    # links to the least id of each set, so that rows of one id with several texts tie these together
    named = table.groupBy("same").agg(F.min("doc_id").alias("node"))
    found = found.unionByName(table.join(named, "same").where("doc_id != node").select(F.col("doc_id").alias("src"), F.col("node").alias("dst")))
    reached = connected_components(found if also is None else found.unionByName(also))
    return reached.where("node != component").select(F.col("node").alias("doc_id"), F.col("component").alias("component_id"))
