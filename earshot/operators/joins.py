"""Join helpers that keep NULL keys and stand up to hot keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def group_of(keys: list[str]) -> Column:
    """The keys as one struct.

    Two structs with a NULL in the same field are equal, so joining and
    partitioning on the struct keeps NULL groups and lets the join reuse the
    partitioning of a window or aggregate on the same struct.
    """
    return F.struct(*[F.col(k) for k in keys]) if keys else F.struct(F.lit(0).alias("all"))


def attach(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on ``keys`` with NULL equal to NULL; the right side's key columns are dropped.

    Meant for right sides that are aggregates: whether they are broadcast is left
    to the adaptive planner, which knows their size when it decides.
    """
    r = right.withColumn("_match", group_of(keys)).drop(*keys)
    return left.withColumn("_match", group_of(keys)).join(r, "_match", how).drop("_match")


def lookup(left: DataFrame, right: DataFrame, keys: list[str], salts: int = 16) -> DataFrame:
    """Left join of raw rows to a small per-key table when one key may hold most rows.

    Left rows of a key are spread over ``salts`` partitions and the right side is
    repeated once per salt, so no task receives a whole hot key.
    """
    l = left.withColumn("_match", group_of(keys)).withColumn(
        "_salt", F.pmod(F.xxhash64(*[F.col(c) for c in left.columns]), F.lit(salts))
    )
    r = (
        right.withColumn("_match", group_of(keys)).drop(*keys)
        .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
    )
    return l.join(r, ["_match", "_salt"], "left").drop("_match", "_salt")
