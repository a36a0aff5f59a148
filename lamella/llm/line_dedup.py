"""Delete from later documents the blocks of lines that an earlier one has too."""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from lamella.llm.common import cut, spans, unused


def patience(a: list, b: list) -> list[tuple[int, int]]:
    """Aligned positions of equal lines, increasing in both: common ends first, then lines unique to each side, then between these."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        times_a, times_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        where = {h: j for j, h in enumerate(b[b0:b1], b0) if times_b[h] == 1}
        unique = [(i, where[h]) for i, h in enumerate(a[a0:a1], a0) if times_a[h] == 1 and h in where]
        if not unique:
            continue
        ends: list[int] = []  # least end of an increasing run of each length, with the run by links back
        tops: list[int] = []
        back: list[int] = []
        for k, (_, j) in enumerate(unique):
            at = bisect_left(ends, j)
            ends[at : at + 1] = [j]
            tops[at : at + 1] = [k]
            back.append(tops[at - 1] if at else -1)
        k, anchors = tops[-1], []
        while k >= 0:
            anchors.append(unique[k])
            k = back[k]
        anchors.reverse()
        for (i, j), (i2, j2) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if i + 1 < i2 and j + 1 < j2:
                todo.append((i + 1, i2, j + 1, j2))
        out += anchors
    return sorted(out)


def runs(hashes: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first line, end) of the shortest runs of lines of ``least`` characters that begin at each line, and that end at each.

    Every line of a block of that size lies in such a run that lies in the block.
    """
    upto = np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))
    at = np.arange(len(sizes))
    ends, starts = np.searchsorted(upto, upto[:-1] + least), np.searchsorted(upto, upto[1:] - least, "right") - 1
    begun, ended = ends <= len(sizes), starts >= 0
    both = np.unique(np.concatenate((np.stack((at[begun], ends[begun]), 1), np.stack((starts[ended], at[ended] + 1), 1))), axis=0)
    return spans(hashes, both[:, 0], both[:, 1]), both[:, 0], both[:, 1]


def aligned_blocks(shared: list[tuple[int, int, int]], rounds: int = 8) -> list[tuple[int, int]]:
    """The blocks of lines (first, end) of a document that another has, of its runs (first, end, first line there) in both.

    Runs are aligned by patience diff, in their order here and there. What crosses an alignment is aligned anew,
    ``rounds`` times at most; a run that is still left is a block of its own, and so is a repetition of an aligned one.
    """
    left = sorted(set(shared))
    blocks: list[list[int]] = []

    def add(found: list[tuple[int, int]]) -> None:
        for first, end in sorted(found):
            if blocks and blocks[-1][0] <= first <= blocks[-1][1]:
                blocks[-1][1] = max(blocks[-1][1], end)
            else:
                blocks.append([first, end])

    for _ in range(rounds):
        if not left:
            break
        named = [((place, end - first), first, end) for first, end, place in left]
        once = {run: first for run, first, _ in reversed(named)}  # a run that recurs here is unique by its first place
        there = sorted(once)
        chosen = {there[i] for i, _ in patience(there, [run for run, first, _ in named if once[run] == first])}
        add([(first, end) for run, first, end in named if run in chosen])
        left = [x for x, (run, _, _) in zip(left, named, strict=True) if run not in chosen]
    add([(first, end) for first, end, _ in left])
    return sorted((first, end) for first, end in blocks)


SEEDS = "id long, mark long, hash long, first int, end int"


def _seeds(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(5)]
            for doc, mark, hashes, sizes in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                hash_, first, end = runs(np.array(hashes, dtype=np.int64).view(np.uint64), np.array(sizes, dtype=np.int64), least)
                for column, values in zip(columns, (np.full(len(hash_), doc), np.full(len(hash_), mark), hash_.view(np.int64), first.astype(np.int32), end.astype(np.int32)), strict=True):
                    column.append(values)
            if columns[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in columns], [c.split()[0] for c in SEEDS.split(", ")])

    return run


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        found = []
        for met in batch.column(2).to_pylist():
            by_holder: dict[int, list] = {}
            for m in met:
                by_holder.setdefault(m["other"], []).append((m["first"], m["end"], m["place"]))
            found.append([{"first": a, "end": b} for shared in by_holder.values() for a, b in aligned_blocks(shared)])
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, kind)], ["id", "mark", "blocks"])


def without_common_blocks(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = 40) -> DataFrame:
    """``docs`` without the blocks of lines that stand in a document of a smaller id too; adds ``n_lines_removed``.

    A block is consecutive lines of ``least`` characters or more together. Seeds are the hashes of the shortest
    runs of lines of that size: each holder of a run meets the run's first holder, so a run held by very many costs
    one row a holder, not one for every two, and as every line of a block lies in such a run, every block
    that any earlier document has is found, however its lines are ordered or first held elsewhere. The runs that
    two documents share are aligned by patience diff, and the aligned blocks deleted from the later one. Lines
    are compared without ASCII white space at their ends.

    Only hashes of runs are joined, never texts or whole lists of lines; texts cross the network once, to
    meet what is deleted from them. The first document that has a block keeps it, so every text survives once.
    Rows, order of lines and other columns stay, whatever their names; a document that is wholly repeated is left
    with an empty text. Null text stays null, empty stays empty; both have 0 lines removed. Rows with a null id are
    neither changed nor compared. Rows with equal ids are never compared with each other. A column called
    n_lines_removed is replaced. No rows give none.
    """
    source = F.col(f"`{text}`")
    key, mark = F.col(f"`{id_col}`").cast("long"), F.xxhash64(source)
    lines = F.split(source, "\n", -1)
    ends = F.lit(" \t\r\x0b\x0c")
    rows = docs.where(key.isNotNull() & (F.length(source) >= least))
    hashed = rows.select(
        key.alias("id"), mark.alias("mark"),
        F.transform(lines, lambda x: F.xxhash64(F.btrim(x, ends))).alias("hashes"), F.transform(lines, lambda x: F.length(F.btrim(x, ends))).alias("sizes"),
    )
    seeds = cut(hashed.dropDuplicates(["id", "mark"]).mapInArrow(_seeds(least), SEEDS))
    firsts = seeds.groupBy("hash").agg(F.min(F.struct("id", "first")).alias("at"), F.max("id").alias("last")).where("at.id < last")
    firsts = cut(firsts.select("hash", F.col("at.id").alias("other"), F.col("at.first").alias("place")))  # a plain table on this side lets the join split the rows of a very common run
    met = seeds.join(firsts, "hash").where("id > other").groupBy("id", "mark").agg(F.collect_list(F.struct("other", "first", "end", "place")).alias("met"))
    gone = met.mapInArrow(_align, "id long, mark long, blocks array<struct<first:int,end:int>>")

    names = {name: unused(name, docs.columns) for name in ("id", "mark", "blocks", "kept")}
    gone = gone.toDF(names["id"], names["mark"], names["blocks"])
    joined = docs.withColumns({names["id"]: key, names["mark"]: mark}).join(gone, [names["id"], names["mark"]], "left")
    stays = F.filter(lines, lambda _, i: ~F.exists(F.col(names["blocks"]), lambda g: (i >= g["first"]) & (i < g["end"])))
    joined = joined.withColumn(names["kept"], F.when(F.col(names["blocks"]).isNotNull(), stays))
    kept = F.col(names["kept"])
    removed = F.when(kept.isNotNull(), F.size(lines) - F.size(kept)).otherwise(0)
    return joined.withColumns({"n_lines_removed": removed, text: F.when(kept.isNotNull(), F.array_join(kept, "\n")).otherwise(source)}).select(*[f"`{c}`" for c in docs.columns if c != "n_lines_removed"], "n_lines_removed")
