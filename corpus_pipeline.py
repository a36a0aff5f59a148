"""The corpus pipeline: what is kept of ``documents``, in the order and mix to train on.

Each stage takes what the one before kept, written as Parquet and read again, and calls one operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamella.llm.common import cut, stored, without
from lamella.llm.decontaminate import with_leak_score
from lamella.llm.line_dedup import without_common_blocks
from lamella.llm.mixing import mixed, tempered
from lamella.llm.quality import train, with_score
from lamella.llm.simhash import near_copies, near_links

#: A document is kept at this probability of being good, or more; the limit of the quality query.
KEEP_SCORE = 0.3


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the classifier rejects."""
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_score(docs, model).where(F.col("score") >= KEEP_SCORE).drop("score")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Delete repeated blocks of lines; a wholly repeated document is left empty."""
    left = without_common_blocks(docs).drop("n_lines_removed")
    return left.withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by SimHash, by chains, the one with the smallest id stays.

    Fingerprints link at 4 or fewer differing bits, as in the SimHash query. Documents alike to four fifths of their five-word
    shingles are linked too, as many of these differ in more bits; chains run over links of both kinds.
    """
    copies = near_copies(docs, also=near_links(docs, width=4, max_bits=4))
    return without(docs, cut(copies.select("doc_id"))).select(docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a test item, whole or edited."""
    scored = with_leak_score(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return scored.where("leak_score = 0").drop("leak_score")


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every document its block, slot and place in the mix; sources weigh the root of their size."""
    return mixed(docs, tempered(docs))


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("mixing sources", mixing),
]

#: Training a classifier and drawing cells of a grid are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs, name.replace(" ", "-"))
    return docs
