"""How filters of documents interact: what each removes in every order, read off a sparse document-term matrix."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from lamella.llm.common import pieces, stored
from lamella.llm.vocabulary import SHARD

LETTERS = "ABCDE"


def word_numbers(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word, id``: the dictionary of all words of ``docs``.

    The number is the word's XXH64, but for the words that ``clashes`` finds. A task emits a word once for each ``SHARD`` words or so that it reads.
    """

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        size = 0
        for batch in pieces(batches, 64):
            for data in batch.column(0).cast(pa.binary()).to_pylist():
                tokens = data.split()
                seen.update(tokens)
                size += len(tokens)
                if size >= SHARD:
                    yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string())], ["word"])
                    seen, size = set(), 0
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()).cast(pa.string())], ["word"])

    words = docs.select(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).mapInArrow(distinct, "word string").distinct()
    return words.select("word", F.xxhash64("word").alias("id"))


def clashes(numbers: DataFrame) -> dict[bytes, int]:
    """Words that share their number with a lesser one, under numbers that no word has.

    Of n words some n * n / 2 ** 65 clash: none for the words of a language, a handful for ten thousand millions.
    """
    shared = numbers.groupBy("id").agg(F.count("*").alias("n"), F.min("word").alias("low")).where("n > 1").select("id", "low").collect()
    if not shared:
        return {}
    again = numbers.join(numbers.sparkSession.createDataFrame(shared), "id").where("word != low").select("word").collect()
    words, free = sorted(r["word"].encode() for r in again), 0
    while numbers.where(F.col("id").isin([free + i for i in range(len(words))])).count():
        free += len(words)
    return {word: free + i for i, word in enumerate(words)}


def term_matrix(docs: DataFrame, keep: list[str], text: str = "text") -> DataFrame:
    """The document-term matrix of ``docs`` in shards, compressed by rows: ``rows, indptr, indices, counts``.

    Row i of a shard is the document ``rows[i]``, a struct of the columns ``keep``; its entries are those from ``indptr[i]``
    up to ``indptr[i + 1]``: ``indices`` has the word's number in the dictionary of all documents (``word_numbers``), ``counts`` how often it
    occurs (packed integers of 64 and 32 bits). Words are runs of characters that aren't ASCII white space; null texts
    have none. A task makes shards of what it reads, of up to 64 documents or about ``SHARD`` words, so neither texts nor
    shards are shuffled. Repeated documents are rows of their own; no documents, no shards.
    """
    other = clashes(word_numbers(docs, text))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in keep]).alias("row"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    digest = xxhash.xxh64_intdigest

    def number(word: bytes) -> int:
        return other[word] if word in other else digest(word, 42)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = number if other else partial(digest, seed=42)
        for batch in pieces(batches, 64):
            at, found, size = 0, [], 0
            texts = batch.column(1).cast(pa.binary()).to_pylist()
            for i, data in enumerate(texts):
                tokens = data.split()
                found.append(np.unique(np.fromiter(map(one, tokens), dtype=np.uint64, count=len(tokens)), return_counts=True))
                size += len(tokens)
                if size >= SHARD or i + 1 == len(texts):
                    rows = pa.ListArray.from_arrays(pa.array([0, i + 1 - at], pa.int32()), batch.column(0).slice(at, i + 1 - at))
                    indices, counts = (np.concatenate([f[j] for f in found]) for j in range(2))
                    packed = [x.tobytes() for x in (np.cumsum([0, *(len(f[0]) for f in found)]), indices, counts.astype(np.int32))]
                    yield pa.RecordBatch.from_arrays([rows, *[pa.array([x], pa.binary()) for x in packed]], ["rows", "indptr", "indices", "counts"])
                    at, found, size = i + 1, [], 0

    return rows.mapInArrow(build, f"rows array<{rows.schema['row'].dataType.simpleString()}>, indptr binary, indices binary, counts binary")


def row_measures(matrix: DataFrame) -> DataFrame:
    """The documents of a ``term_matrix`` with ``n_words``, the sum of their row, and ``n_distinct``, its entries."""
    kind = matrix.schema["rows"].dataType.elementType

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                indptr, counts = (np.frombuffer(batch.column(n)[i].as_py(), dtype=t) for n, t in (("indptr", np.int64), ("counts", np.int32)))
                entries = np.diff(indptr)
                total = np.bincount(np.repeat(np.arange(len(entries)), entries), weights=counts, minlength=len(entries)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("rows")[i].values, pa.array(total), pa.array(entries)], ["row", "n_words", "n_distinct"])

    found = matrix.select("rows", "indptr", "counts").mapInArrow(measure, f"row {kind.simpleString()}, n_words long, n_distinct long")
    return found.select("row.*", "n_words", "n_distinct")


def failures(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep...`` and ``fails`` of every document: the letters of the filters that it fails.

    A: under 100 words. B: 100 * distinct words < 80 * words. C: 100 * A-Z characters > 10 * characters. D: one of
    ``#$%&*|`` occurs. E: another document with a smaller ``doc_id`` has the same text. Null texts are empty ones. Rows
    of one id don't repeat each other, and a null id neither repeats nor is repeated.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    plain = docs.select(*keep, F.col("doc_id").cast("long").alias("_id"), text.alias("_text"))
    seen = plain.withColumns({"_c": 100 * F.regexp_count("_text", F.lit("[A-Z]")) > 10 * F.length("_text"), "_d": F.col("_text").rlike(r"[#$%&*|]"), "_same": F.unhex(F.sha2("_text", 256))})
    measured = stored(row_measures(term_matrix(seen, [*keep, "_id", "_c", "_d", "_same"], "_text")), "row-measures")
    # one row a text: the id that stays; documents meet it by id and text, so a text with many copies is no hot key
    first = measured.where("_id is not null").groupBy("_same").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    marked = measured.join(first, ["_same", "_id"], "left")
    fails = [F.col("n_words") < 100, 100 * F.col("n_distinct") < 80 * F.col("n_words"), F.col("_c"), F.col("_d"), F.col("_id").isNotNull() & F.col("_first").isNull()]
    return marked.select(*keep, F.concat(*[F.when(f, letter).otherwise("") for letter, f in zip(LETTERS, fails, strict=True)]).alias("fails"))


def interactions(failed: DataFrame, by: str, extra: dict[str, Column], letters: str = LETTERS) -> DataFrame:
    """What each filter removes at each step of every order of the filters, by ``by``.

    ``failed`` has ``fails``, those of ``letters`` that a document fails; ``extra`` names conditions whose documents are counted among
    those removed. Returned for each value of ``by``, each order and each step, zeros included: ``kept`` after the
    step, ``removed`` in it, ``redundant`` (fails here, removed before), ``unique_fails`` (fails here and nowhere else),
    the ``extra`` counts, and ``shapley``: what the filter removes, summed over all orders. Documents are summed by
    what they fail first, at most two to the number of filters for each value of ``by``; the orders are dealt with on those sums.
    """
    sums = failed.groupBy(by, "fails").agg(F.count("*").alias("_n"), *[F.count_if(c).alias(f"_of_{name}") for name, c in extra.items()])
    orders = ["".join(order) for order in permutations(letters)]
    each = sums.withColumn("filter_order", F.explode(F.split(F.lit(",".join(orders)), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(letters)))))
    letter, earlier = F.substring("filter_order", F.col("step"), F.lit(1)), F.substring("filter_order", F.lit(1), F.col("step") - 1)
    own, before = F.contains("fails", letter), F.length(F.call_function("translate", earlier, F.col("fails"), F.lit(""))) < F.col("step") - 1
    each = each.withColumns({"_own": own, "_before": before, "_only": F.col("fails") == letter})
    total = lambda what, when: F.coalesce(F.sum(F.when(when, what)), F.lit(0)).cast("long")
    first = (F.lit(len(orders)) / F.greatest(F.length("fails"), F.lit(1))).cast("long")  # of the filters that a document fails, each comes first in as many orders
    return each.groupBy(by, "filter_order", "step").agg(
        total(F.col("_n"), F.expr("not _own and not _before")).alias("kept"), total(F.col("_n"), F.expr("_own and not _before")).alias("removed"),
        total(F.col("_n"), F.expr("_own and _before")).alias("redundant"), total(F.col("_n"), F.col("_only")).alias("unique_fails"),
        *[total(F.col(f"_of_{name}"), F.expr("_own and not _before")).alias(name) for name in extra], total(F.col("_n") * first, F.col("_own")).alias("shapley"),
    )


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``interactions`` of the filters of ``failures`` over whole documents, for each ``lang`` (null: empty), as ``part``.

    ``good_lost`` and ``toxic_lost`` count documents removed whose label says ``quality`` 1 or ``toxic`` 1. A document without
    a label is neither; of several labels of one document any counts. Documents with one id each count. No documents,
    no rows; other columns are not read.
    """
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"), "text")
    failed = failures(named, ["doc_id", "part"])
    known = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    return interactions(failed.join(known, "doc_id", "left"), "part", {"good_lost": F.col("good"), "toxic_lost": F.col("toxic")})
