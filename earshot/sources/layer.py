"""Trials stored once in the order of their recordings, numbered, so that later reads need no shuffle.

Import writes the layer; every report then cuts blocks by a filter on the stored numbers. Folders
per day let a read open the days it wants, and within a day files are sorted by recording and
number, so that the scan skips what a filter on subject, stimulus or number rules out. A hot
recording lies in several files, since ranges go by number as well.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from earshot.operators.blocks import BLOCK_KEYS
from earshot.operators.ranks import numbered

DAY = "layer_day"  # folder name; the date itself stays a column


def store(trials: DataFrame, path: str, order: list[str], slot: Column, files: int | None = None, mode: str = "overwrite") -> None:
    """Write trials with ``row``, their 1-based number in their recording, and ``total``, its trials.

    ``files`` is the number of ranges (the session's shuffle partitions by default). With
    ``mode="append"`` whole recordings can be added later; one that is continued must be stored anew.
    Recordings with a NULL in their keys are kept, those without a date in a folder of their own.
    """
    rows = numbered(trials, BLOCK_KEYS, order, slot)
    keys = [DAY, *BLOCK_KEYS, "row"]
    laid = rows.withColumn(DAY, F.coalesce(F.date_format("Date", "yyyy-MM-dd"), F.lit("none")))
    laid = laid.repartitionByRange(files, *keys) if files else laid.repartitionByRange(*keys)
    laid.sortWithinPartitions(*keys).write.mode(mode).partitionBy(DAY).parquet(path)


def read(
    spark: SparkSession, path: str, first: dt.date | None = None, last: dt.date | None = None,
    schema: StructType | None = None,
) -> DataFrame:
    """Stored trials of the days from ``first`` to ``last``; trials without a date only where neither is given.

    ``schema`` is that of the trials that were stored. With it no file is opened to find the
    columns, and a layer without trials (which has no files) is an empty table.
    """
    reader = spark.read
    if schema is not None:
        reader = reader.schema(StructType([*schema.fields, *[StructField(c, LongType()) for c in ("row", "total")], StructField(DAY, StringType())]))
    rows = reader.parquet(path)
    # "none" sorts after every date, so it takes a bound of its own
    day = F.col(DAY).cast("string")
    if first or last:
        rows = rows.where(day != "none")
    if first:
        rows = rows.where(day >= first.isoformat())
    if last:
        rows = rows.where(day <= last.isoformat())
    return rows.drop(DAY)
