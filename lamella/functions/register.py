"""Operators as SQL functions of a session, and the depth methods that can be chosen by name."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import IntegerType

from lamella.operators.depth import DEPTH_METHODS, knees  # noqa: F401


@F.pandas_udf(IntegerType())
def knee_of(profiles: pd.Series) -> pd.Series:
    """Knee of each profile; null under three values or with a null in it."""
    out = pd.Series([None] * len(profiles), dtype="Int32")
    lengths = profiles.map(lambda p: -1 if p is None or any(v is None or v != v for v in p) else len(p))
    for n in lengths.unique():
        if n >= 3:
            rows = np.flatnonzero(lengths.to_numpy() == n)
            out.iloc[rows] = knees(np.stack([np.asarray(profiles.iloc[i], dtype=np.float64) for i in rows]))
    return out


def register(spark: SparkSession) -> None:
    """Give a session ``knee(array)``, ``grey(amplitude, low, high)``, ``moving_average(array, span)`` and the table function ``equidistant(first, last, n)``."""
    spark.udf.register("knee", knee_of)
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION grey(amplitude DOUBLE, low DOUBLE, high DOUBLE) RETURNS DOUBLE RETURN least(greatest(255 * (20 * log10(amplitude) - low) / (high - low), 0D), 255D)")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION moving_average(a ARRAY<DOUBLE>, span INT) RETURNS ARRAY<DOUBLE> RETURN
        transform(a, (v, i) -> aggregate(slice(a, i + 1 - least((span - 1) div 2, i, size(a) - 1 - i), CAST(2 * least((span - 1) div 2, i, size(a) - 1 - i) + 1 AS INT)), 0D, (s, x) -> s + x, s -> s / (2 * least((span - 1) div 2, i, size(a) - 1 - i) + 1)))""")
    spark.sql("""CREATE OR REPLACE TEMPORARY FUNCTION equidistant(first INT, last INT, n INT) RETURNS TABLE (k INT) RETURN
        SELECT explode(CASE WHEN n <= 0 THEN array() WHEN n = 1 THEN array(first - 1) ELSE transform(sequence(0, n - 1), i -> CAST(CASE WHEN i = n - 1 THEN last - 1 ELSE first - 1 + i * ((last - first) / (n - 1)) END AS INT)) END)""")
