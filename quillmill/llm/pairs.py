"""Pairs inside groups, with hot groups spread over many tasks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of one group that one task may hold on the probing side; a larger group is split by a salt.
GROUP_SLICE = 2000


def within_groups(rows: DataFrame, key: list[str], size: str, keep: Callable[[DataFrame, DataFrame], Column] | None = None) -> DataFrame:
    """Pairs ``id_a < id_b`` of rows with equal ``key``; ``size`` names the column with the group's row count.

    A group of n rows is cut into ceil(n / GROUP_SLICE) slices on the left, and the right side is repeated once per
    slice, so no task holds more than a slice of a hot group against its rows. Only for results that are pairs by
    definition."""
    slices = F.ceil(F.col(size) / F.lit(GROUP_SLICE)).cast("int")
    a = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), slices).cast("int")).alias("a")
    b = rows.withColumn("_salt", F.explode(F.sequence(F.lit(0), slices - 1))).alias("b")
    on = F.col("a._salt") == F.col("b._salt")
    for k in key:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    on = on & (F.col("a.id") < F.col("b.id"))
    if keep is not None:
        on = on & keep(_Side("a"), _Side("b"))
    pairs = a.join(b, on)
    return pairs.select(F.col("a.id").alias("id_a"), F.col("b.id").alias("id_b"), *[F.col(f"a.{k}").alias(k) for k in key])


class _Side:
    def __init__(self, name: str) -> None:
        self.name = name

    def __getitem__(self, column: str) -> Column:
        return F.col(f"{self.name}.{column}")
