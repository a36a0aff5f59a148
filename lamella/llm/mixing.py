"""Interleave sources to target weights by Pfair scheduling of blocks."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from fractions import Fraction
from heapq import heappop, heappush
from math import ceil, lcm

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import AtomicType

from lamella.llm.common import unused

def tempered(docs: DataFrame, power: float = 0.5, source: str = "source") -> dict[str, float]:
    """A weight for each source: its number of rows to ``power``, so that large sources count less than by size."""
    rows = docs.where(F.col(f"`{source}`").isNotNull()).groupBy(F.col(f"`{source}`").cast("string").alias("s")).count().collect()
    return {r["s"]: r["count"] ** power for r in rows}


def whole_parts(weights: dict[str, float]) -> tuple[dict[str, int], int]:
    """Each source's part of the sum of weights as a whole number, and the sum, without rounding."""
    if weights and min(weights.values()) <= 0:
        raise ValueError("weights must be positive")
    exact = {s: Fraction(w) for s, w in weights.items()}
    below = lcm(*(w.denominator for w in exact.values())) if exact else 1
    parts = {s: w.numerator * (below // w.denominator) for s, w in exact.items()}
    return parts, sum(parts.values())


def schedule(parts: dict[str, int], top: int, blocks: dict[str, int]) -> Iterator[tuple[str, int]]:
    """(source, slot) of all blocks, each source's in order: of the blocks released, the one with the earliest deadline runs.

    Block k = 1, 2, ... of a source of weight w is released at floor((k-1)/w) and due at ceil(k/w), so
    after any number of slots a source has had its weight's part of them but for less than one block. Of equal
    deadlines, one whose next window overlaps comes first, then the heavier. A source that has ended leaves slots empty.
    """
    waiting = [(0, s, 0) for s in sorted(parts) if blocks.get(s)]  # release, source, blocks done
    ready: list[tuple[int, bool, int, str, int]] = []
    now = 0
    while waiting or ready:
        if not ready:
            now = max(now, waiting[0][0])
        while waiting and waiting[0][0] <= now:
            _, s, k = heappop(waiting)
            heappush(ready, (-((k + 1) * -top // parts[s]), (k + 1) * top % parts[s] == 0, -parts[s], s, k))
        *_, s, k = heappop(ready)
        yield s, now
        if k + 1 < blocks[s]:
            heappush(waiting, ((k + 1) * top // parts[s], s, k + 1))
        now += 1


def mixed(docs: DataFrame, weights: dict[str, float], block_rows: int = 32, id_col: str = "doc_id", source: str = "source", buckets: int | None = None) -> DataFrame:
    """``docs`` with ``block, slot, place``: read by slot, then place, any beginning holds the sources in their weights.

    Each source's rows, in an order drawn by a hash of the id, fill blocks of ``block_rows``. Weights are taken exactly; up to the slot
    at which a source ends, no source is a whole block away from its weight; then slots stay empty and the others
    go on. Each slot depends on all before it, so the driver deals them out, one number for each block:
    some seconds for a million blocks. Larger tables want larger blocks; it never sees rows.

    Rows are numbered inside buckets of each source and the buckets' counts are added up. A source has
    its share of ``buckets`` (four for each shuffle partition), so one with a third of all rows is dealt
    over a third of them, and no bucket outgrows a partition. All rows and columns are kept, whatever their names;
    sources without a weight and null sources have a null slot, to be left out or mixed anew; without weights all
    are so. Repeated rows take a place each; ties in the hash go by id, then by the other columns. Null ids are dealt over buckets by their other columns.
    Columns called block, slot or place are replaced. No rows give none.
    """
    spark = docs.sparkSession
    parts, top = whole_parts(weights)
    kept = docs.drop("block", "slot", "place")
    name, draw, own, bucket, i, plan = (unused(n, docs.columns) for n in ("name", "draw", "own", "bucket", "i", "plan"))
    buckets = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = [F.col(f"`{f.name}`") for f in kept.schema if isinstance(f.dataType, AtomicType)]
    rows = kept.withColumns({name: F.col(f"`{source}`").cast("string"), draw: F.xxhash64(F.col(f"`{id_col}`"), F.lit("mix"))})

    size = {r["s"]: r["n"] for r in rows.groupBy(F.col(name).alias("s")).agg(F.count("*").alias("n")).collect() if r["s"] in parts}
    total = max(1, sum(size.values()))
    shared = spark.createDataFrame([(s, max(1, ceil(buckets * n / total))) for s, n in size.items()], f"`{name}` string, `{own}` int")
    rows = rows.join(F.broadcast(shared), name, "left")
    rows = rows.withColumn(bucket, F.pmod(F.xxhash64(draw, *plain), F.coalesce(own, F.lit(buckets))).cast("int"))
    counted = rows.where(F.col(own).isNotNull()).groupBy(F.col(name).alias("s"), F.col(bucket).alias("b")).agg(F.count("*").alias("n")).collect()
    held: dict[str, list[tuple[int, int, int]]] = {s: [] for s in size}  # bucket, its first row and end among the source's
    for r in sorted(counted, key=lambda r: (r["s"], r["b"])):
        before = held[r["s"]][-1][2] if held[r["s"]] else 0
        held[r["s"]].append((r["b"], before, before + r["n"]))
    slots: dict[str, array] = {s: array("q") for s in size}
    for s, slot in schedule(parts, top, {s: -(-n // block_rows) for s, n in size.items()}):
        slots[s].append(slot)
    table = [(s, b, low, low // block_rows, slots[s][low // block_rows : -(-high // block_rows)].tolist()) for s, found in held.items() for b, low, high in found]
    kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()))
    dealt = spark.createDataFrame(pa.table([pa.array([r[k] for r in table], kind) for k, kind in enumerate(kinds)], [name, bucket, "offset", "first", "slots"]))
    dealt = dealt.select(f"`{name}`", f"`{bucket}`", F.struct("offset", "first", "slots").alias(plan))

    numbered = rows.withColumn(i, F.row_number().over(Window.partitionBy(name, bucket).orderBy(draw, F.col(f"`{id_col}`"), F.xxhash64(draw, *plain))) - 1)
    numbered = numbered.join(dealt, [name, bucket], "left")
    at = F.col(i) + F.coalesce(F.col(f"{plan}.offset"), F.lit(0))
    block = F.floor(at / block_rows)
    numbered = numbered.withColumns({"block": block, "place": (at % block_rows).cast("long"), "slot": F.get(F.col(f"{plan}.slots"), (block - F.col(f"{plan}.first")).cast("int"))})
    return numbered.select(*[f"`{c}`" for c in kept.columns], "block", "slot", "place")
