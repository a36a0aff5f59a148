"""Tables as the volume operators see them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings as depth profiles: a scan for each vector, a slice for each label, intensities around 128."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.transform("embedding", lambda e: 128 + 200 * e.cast("double")).alias("profile"))


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


#: The profiles in SQL, a row for each depth.
POINTS = "pts AS (SELECT vec_id, label, unnest(range(0, len(embedding))) AS z, 128 + 200 * CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
