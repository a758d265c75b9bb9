"""The first rows per group, without sorting a large group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 64


def leading(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], limit: int, spread: Sequence[str]
) -> DataFrame:
    """The first ``limit`` rows of each group in ``order``, with their rank as ``_nth``.

    The limit is first applied to salted parts of each group (a hash of the ``spread``
    columns), which leaves at most ``SALTS * limit`` rows for the last step.
    """

    def cut(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
        window = Window.partitionBy(*keys).orderBy(*order)
        return rows.withColumn("_nth", F.row_number().over(window)).where(F.col("_nth") <= limit)

    salted = df.withColumn("_salt", F.pmod(F.hash(*spread), F.lit(SALTS)))
    return cut(cut(salted, [*group, "_salt"]).drop("_salt", "_nth"), group)
