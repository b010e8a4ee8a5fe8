"""Reading tables and cutting lineage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame) -> DataFrame:
    """The rows, stored in the shared checkpoint folder and read from there.

    The folder is the session's ``spark.checkpoint.dir``. Only a session that names none
    (a test) gets one, beside its warehouse.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(folder or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints")
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def row_id(df: DataFrame) -> Column:
    """Two independent hashes of the whole row (maps and variants, which have none, left out): equal rows share it."""
    whole = [F.col(f"`{f.name}`") for f in df.schema if not any(t in f.dataType.simpleString() for t in ("map<", "variant"))]
    # a NULL does not change a hash, so which columns are NULL goes in as well
    nulls = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in whole])
    return F.struct(F.xxhash64(nulls, *whole).alias("a"), F.xxhash64(F.lit("second"), nulls, *reversed(whole)).alias("b"))


def salted_join(rows: DataFrame, few: DataFrame, on: list[str], by: str, salts: int = 16, how: str = "inner") -> DataFrame:
    """Join of many rows to one row per key; rows of a hot key are spread by the hash in column ``by``."""
    salt = F.pmod(F.col(by), F.lit(salts)).cast("int")
    copies = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")
