"""Operators of the filter language on tables: keyed firsts, top-k and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def unique_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key; a minimum, so tasks combine before they send."""
    rest = [*order, *(c for c in df.columns if c not in keys and c not in order)]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row")).select(*keys, "_row.*")


def top_k(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each key. Spark's group limit keeps k rows a key and task before the shuffle."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= k).drop("_r")



def as_of(left: DataFrame, right: DataFrame, keys: Sequence[str], at: str, values: Sequence[str]) -> DataFrame:
    """left with the right's values of the last row of its keys not after it: one sort of both, no pairs."""
    both = left.select(*keys, at, F.struct(*left.columns).alias("_l"), F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("_v"), F.lit(1).alias("_o")).unionByName(
        right.select(*keys, at, F.lit(None).cast(left.select(F.struct(*left.columns)).schema[0].dataType).alias("_l"), F.struct(*values).alias("_v"), F.lit(0).alias("_o"))
    )
    w = Window.partitionBy(*keys).orderBy(at, "_o").rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_o = 1").select("_l.*", *(F.col(f"_last.{v}").alias(f"right_{v}") for v in values))
