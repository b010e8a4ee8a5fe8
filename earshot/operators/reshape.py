"""Wide and long forms, unions, subset by complete conditions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def wide(df: DataFrame, keys: list[str], names: str, value: str, levels: list, fill=None) -> DataFrame:
    """One column per level of ``names``; several values in a cell are averaged.

    Levels are given, so this is one aggregate without a pass to find them.
    """
    cells = [F.avg(F.when(F.col(names) == v, F.col(value))).alias(str(v)) for v in levels]
    out = df.groupBy(*keys).agg(*cells)
    return out if fill is None else out.na.fill(fill, [str(v) for v in levels])


def long(df: DataFrame, keys: list[str], columns: list[str], name: str, value: str) -> DataFrame:
    """One row per key and column; NULL values are kept."""
    return df.unpivot(keys, columns, name, value)


def stack(*tables: DataFrame) -> DataFrame:
    """Union of all rows by column name; a column a table lacks is NULL there."""
    first, *others = tables
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def in_every_condition(
    df: DataFrame, keys: list[str], conditions: list[str], column: str = "Condition",
) -> DataFrame:
    """Rows of groups that have at least one row in each of the conditions."""
    complete = (
        df.where(F.col(column).isin(conditions)).groupBy(*keys)
        .agg(*[F.max(F.col(column) == c).alias(f"_c{i}") for i, c in enumerate(conditions)])
        .where(" and ".join(f"_c{i}" for i in range(len(conditions))))
        .select(*keys)
    )
    return df.join(complete, keys, "left_semi")
