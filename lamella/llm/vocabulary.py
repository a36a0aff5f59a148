"""A dictionary of all words of a table, built from the dictionaries of its shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from lamella.llm.common import stored

#: Words in a shard, about; a longer document is a shard of its own.
SHARD = 1 << 20


class Coder(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def shard_numbers(partition: int):
    """Numbers of a task's shards, unlike those of any other task."""
    at = partition << 32
    while True:
        yield at
        at += 1


def dictionary(shards: DataFrame, by: list[str], least: int = 1) -> DataFrame:
    """``by..., word, n, id``: the words that occur ``least`` times or more under their ``by``, each with a number of its own.

    ``shards`` has ``words array<string>`` and ``uses array<long>``, how often each of its words occurs in the shard. A
    word costs a row for each shard that has it, not for each occurrence. The numbers are written out, so a lost
    executor can't change them.
    """
    each = shards.select(*by, F.explode(F.arrays_zip("words", "uses")).alias("w")).select(*by, F.col("w.words").alias("word"), F.col("w.uses").alias("uses"))
    counted = each.groupBy(*by, "word").agg(F.sum("uses").alias("n")).where(F.col("n") >= least)
    return stored(counted.withColumn("id", F.monotonically_increasing_id() + 1), "dictionary")


def with_global_ids(shards: DataFrame, known: DataFrame, by: list[str]) -> DataFrame:
    """``shards`` with ``ids array<long>`` in place of ``words`` and ``uses``: the dictionary's number of each of its words, 0 for those it leaves out.

    What meets in one row is the words of one shard, which ``SHARD`` bounds.
    """
    each = shards.select("shard", *by, F.posexplode("words").alias("place", "word"))
    numbered = each.join(known.select(*by, "word", "id"), [*by, "word"], "left").select("shard", "place", F.coalesce("id", F.lit(0)).alias("id"))
    ids = numbered.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("place", "id"))).alias("x")).select("shard", F.col("x.id").alias("ids"))
    return shards.drop("words", "uses").join(ids, "shard", "left").withColumn("ids", F.coalesce("ids", F.array().cast("array<long>")))
