"""Places and sliding windows in series of any length: a series is cut into ranges, and no task needs a whole one."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from lamella.operators.lineage import cut


def placed(df: DataFrame, keys: list[str], order: list[str | Column], out: str = "place") -> DataFrame:
    """``df`` with the place of each row, from 0, in its key's order; null keys are a key.

    Rows are dealt to tasks by ranges of key and order, so a key of very many rows lies in many; a row's place is its number in
    its range and what the key has in the ranges before. The ranges are written out, as another run could draw other ones.
    """
    count = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = [f"_order{i}" for i in range(len(order))]
    sorts = df.withColumns({n: F.col(o) if isinstance(o, str) else o for n, o in zip(names, order, strict=True)})
    held = cut(sorts.repartitionByRange(count, *keys, *names).withColumn("_range", F.spark_partition_id()))
    sizes = held.groupBy(*keys, "_range").agg(F.count("*").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sizes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_range").alias("_of_range"), before.alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys], F.col("_range") == F.col("_of_range"))
    number = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*names)) - 1
    joined = held.withColumn(out, number).join(starts, same)
    return joined.withColumn(out, F.col(out) + F.col("_before")).drop(*names, "_range", "_before", "_of_range", *[f"_of_{k}" for k in keys])


def sliding(df: DataFrame, keys: list[str], order: list[str | Column], before: int, after: int, value: Callable[[WindowSpec], Column], out: str, block: int = 8192) -> DataFrame:
    """``df`` with ``value`` over each row's window of ``before`` rows before it to ``after`` behind it, in its key's order.

    A key's rows are dealt in blocks of ``block`` places, with the rows of the blocks beside them that windows reach, so
    that windows are whole at the joints and a task holds no more than a block and its borders.
    """
    place = F.col("_place")
    rows = placed(df, keys, order, "_place").withColumn("_own", F.floor(place / block))
    rows = rows.withColumn("_block", F.explode(F.sequence(F.floor(F.greatest(place - after, F.lit(0)) / block), F.floor((place + before) / block))))
    window = Window.partitionBy(*keys, "_block").orderBy("_place").rowsBetween(-before, after)
    return rows.withColumn(out, value(window)).where("_block = _own").drop("_place", "_own", "_block")
