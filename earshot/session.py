"""Session settings the library needs."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def checkpoint_dir(spark: SparkSession) -> str:
    """The checkpoint folder the session names; beside its warehouse where it names none (tests)."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def cut_lineage(df: DataFrame) -> DataFrame:
    """Materialise a table that several jobs will read, in the shared folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def shared_path(spark: SparkSession) -> str:
    """A new path in the shared folder, for a table that several jobs will read with their own filters and columns."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{uuid.uuid4()}"
