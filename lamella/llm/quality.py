"""A quality classifier of supervised subword embeddings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DoubleType, StructType

from lamella.llm.common import mix, words

BUCKETS = 1 << 18
GRAMS = (3, 5)
#: The bucket of a repeated word.
AGAIN = 1


def features(text: str) -> np.ndarray:
    """Buckets of the words and of the character n-grams of the whole text, repeats included.

    A word that only repeats the one before it counts as one fixed word more.
    """
    if not text:
        return np.zeros(0, dtype=np.int64)
    tokens = words(text.encode())[0]
    out = [tokens, np.full(int((tokens[1:] == tokens[:-1]).sum()), AGAIN, dtype=np.uint64)]
    codes = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    for n in GRAMS:
        if len(codes) >= n:
            gram = np.full(len(codes) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                gram = gram * np.uint64(0x100000001B3) ^ codes[i : len(codes) - n + 1 + i]
            out.append(mix(gram))
    return (np.concatenate(out) & np.uint64(BUCKETS - 1)).astype(np.int64)


class SubwordClassifier:
    """Vectors for hashed words and n-grams, averaged over a document, and a softmax over two classes."""

    def __init__(self, size: int = 12, seed: int = 1):
        draw = np.random.default_rng(seed)
        self.vectors = draw.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
        self.weights = np.zeros((size, 2), dtype=np.float32)
        self.bias = np.zeros(2, dtype=np.float32)

    def fit(self, texts: list[str], labels: list[int], epochs: int = 8, rate: float = 1.0, seed: int = 2) -> "SubwordClassifier":
        """Stochastic gradient descent on the log loss, a document at a time, with a rate that falls to zero."""
        # two buffers that grow, as thousands of arrays would leave the driver's memory in pieces
        places, shares, ends = bytearray(), bytearray(), [0]
        for text in texts:
            at, count = np.unique(features(text), return_counts=True)
            places += at.astype(np.int32).tobytes()
            shares += (count / max(1, count.sum())).astype(np.float32).tobytes()
            ends.append(ends[-1] + len(at))
        bags = [(np.frombuffer(places, np.int32)[a:b], np.frombuffer(shares, np.float32)[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
        if labels:
            share = np.clip(np.mean(labels), 1e-3, 1 - 1e-3)
            self.bias[:] = np.log([1 - share, share])
        draw, step, steps = np.random.default_rng(seed), 0, epochs * len(bags)
        for _ in range(epochs):
            for i in draw.permutation(len(bags)):
                at, share = bags[i]
                now = np.float32(rate * (1 - step / steps))
                step += 1
                mean = share @ self.vectors[at]
                logits = mean @ self.weights + self.bias
                error = np.exp(logits - logits.max())
                error /= error.sum()
                error[labels[i]] -= 1
                back = self.weights @ error
                self.weights -= now * np.outer(mean, error)
                self.bias -= now * np.float32(0.01) * error
                # a step along the mean, shared out: each vector moves by its share against the largest
                self.vectors[at] -= now * (share / max(float(share.max(initial=0)), 1e-9))[:, None] * back
        return self

    def evidence(self) -> tuple[np.ndarray, float]:
        """What a document's mean vector adds to the log odds of label 1, bucket by bucket, and the bias.

        The odds are linear in the mean, so the mean of these numbers is the odds of the mean.
        """
        return (self.vectors @ (self.weights[:, 1] - self.weights[:, 0])).astype(np.float32), float(self.bias[1] - self.bias[0])


def score_of(text: str, evidence: np.ndarray, bias: float) -> float:
    at = features(text)
    odds = bias + (float(evidence[at].mean(dtype=np.float64)) if len(at) else 0.0)
    return float(1 / (1 + np.exp(-odds)))


def fold(id_col: Column) -> Column:
    """crc32 of the id as text, modulo 5; a null id is in fold 0."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5, F.lit(0))


def train(docs: DataFrame, labels: DataFrame, max_train: int = 4000, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> SubwordClassifier:
    """Fit on about ``max_train`` labelled documents outside fold 0, chosen by a hash of the id.

    ``max_train`` bounds what the driver and a broadcast of ids hold; texts are used whole. Labels other
    than 0 and 1 and null ids are ignored; of repeated labels the larger counts. Without labels
    every score is one half.
    """
    marked = labels.select(F.col(id_col).alias("_id"), F.col(label).alias("_y")).where("_id is not null and _y in (0, 1)").where(fold(F.col("_id")) != 0)
    marked = marked.groupBy("_id").agg(F.max("_y").alias("_y"))
    total = marked.count()
    limit = 1 << 20
    if total > max_train:
        marked = marked.where(F.pmod(F.xxhash64("_id"), F.lit(limit)) < max_train * limit // total)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text}`").alias("_t")).join(F.broadcast(marked), "_id").collect()
    rows.sort(key=lambda r: (r["_id"], r["_t"] or ""))
    return SubwordClassifier().fit([r["_t"] or "" for r in rows], [int(r["_y"]) for r in rows])


def with_score(docs: DataFrame, model: SubwordClassifier, text: str = "text", score: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 by the whole text; null and empty texts get the bias alone.

    Rows and other columns are kept; a column called ``score`` is replaced. The model is a megabyte of
    numbers, whatever the input. There is no shuffle.
    """
    evidence, bias = model.evidence()
    shared = docs.sparkSession.sparkContext.broadcast((evidence, bias))
    kept = docs.drop(score)
    place = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [score_of(t or "", *shared.value) for t in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, score])

    schema = StructType([*kept.schema.fields]).add(score, DoubleType())
    return kept.mapInArrow(run, schema)
