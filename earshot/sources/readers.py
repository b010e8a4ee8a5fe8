"""Reading logs, listings and trial files; writing reports and results.

Spreadsheets are expected as CSV or parquet, one file per subject; raw runs as CSV
in folders per day. Every reader takes a path or list of paths and an explicit
schema, so that no pass over the files is spent on inferring types.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.functions import names
from earshot.operators.sessions import check_names
from earshot.params import SESSION_COLUMNS, SESSION_POSITIONS

# --- fixed values: columns of a raw run, as used; the tenth and eleventh are not read on ---
TRIAL_COLUMNS = {
    "Stim Source": "Stim", "Type": "Type", "Freq (kHz)": "Freq", "Inten (dB)": "Inten", "Dur (ms)": "Dur",
    "Response": "Response", "R Time (ms)": "RTime", "Time (s)": "Time",
}
TRIAL_TYPES = {
    "Stim": "string", "Type": "int", "Freq": "double", "Inten": "double", "Dur": "double",
    "Response": "string", "RTime": "double", "Time": "string",
}
UNREAD_POSITIONS = (9, 10)
# -------------------------------------------------------------------------------------------


def select_positions(df: DataFrame, positions: list[int], new_names: list[str]) -> DataFrame:
    """Columns by place, renamed."""
    return df.select(*[F.col(f"`{df.columns[i]}`").alias(n) for i, n in zip(positions, new_names, strict=True)])


def drop_positions(df: DataFrame, positions: tuple[int, ...]) -> DataFrame:
    return df.select(*[F.col(f"`{c}`") for i, c in enumerate(df.columns) if i not in positions])


def file_stem() -> Column:
    """Name of the file a row came from, without folder and ending."""
    return F.regexp_replace(F.regexp_replace(F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B"))), r"\.[^.]+$", ""), "/$", "")


def read_logs(spark: SparkSession, path: str | list[str], columns: int = 24) -> DataFrame:
    """One log file per subject as one table; the file's name is the subject."""
    schema = ", ".join(f"c{i} string" for i in range(columns))
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path)
    log = select_positions(raw.withColumn("_file", file_stem()), [*SESSION_POSITIONS, columns], [*SESSION_COLUMNS, "ID"])
    return log.withColumns({
        "Date": F.expr("try_cast(Date AS date)"),
        **{c: names.number(F.col(c)) for c in ("Weight", "WeightChange", "Trials", "Hit", "FA")},
    })


def with_genotype(log: DataFrame, subjects: DataFrame) -> DataFrame:
    """Genotype from the subject table (``ID``, ``Genotype``)."""
    return log.join(subjects.select("ID", "Genotype"), "ID", "left")


def read_sheet(spark: SparkSession, path: str | list[str], schema: str, na: str | None = "NA") -> DataFrame:
    """A CSV sheet; ``na`` is the text that means unknown (None keeps it as text)."""
    reader = spark.read.schema(schema).option("header", True)
    return (reader.option("nullValue", na) if na is not None else reader).csv(path)


def list_files(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """Paths below ``folder``; file contents are not read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    )
    return files.select("path")


def read_trials(
    spark: SparkSession, files: DataFrame | None, path: str | list[str], header: list[str],
    session_columns: tuple[str, ...] = ("Date", "ID", "Sex", "Condition", "BG_Type", "BG_Intensity"),
    match: str = "session",
) -> DataFrame:
    """Raw runs as one table, each row with its session's attributes and checks.

    ``files`` gives the sessions of every path: with ``match="session"`` the one whose name
    the file carries (``FileName_expected``), with ``"subject_day"`` every session of that
    subject and day (``FileName_complete``), so that a file is read once for each. ``header``
    the columns of a run in file order. All files are one scan. (``path``, ``block``,
    ``row``) is the order of trials: files by name, pieces of a file by their place, and
    ``row`` grows within a piece, without being dense.
    """
    schema = ", ".join(f"`{c}` string" for c in header)
    raw = spark.read.schema(schema).option("header", True).option("enforceSchema", True).csv(path).withColumns({
        "_path": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"),
        "row": F.monotonically_increasing_id(),
    })
    kept = drop_positions(raw, UNREAD_POSITIONS)
    rows = kept.select("_path", "block", "row", *[
        F.col(f"`{old}`").try_cast(TRIAL_TYPES[new]).alias(new) for old, new in TRIAL_COLUMNS.items()
    ])
    if files is None:
        return rows.withColumnRenamed("_path", "path")
    name = {"session": "FileName_expected", "subject_day": "FileName_complete"}[match]
    sessions = check_names(files.where(F.col(name).isNotNull()), name, missing="NA").select(
        *session_columns, "File_Match", _comparable(F.col(name)).alias("_key")
    ).distinct()
    return rows.withColumn("_key", _comparable(F.col("_path"))).join(sessions, "_key").select(
        *session_columns, "File_Match", F.col("_path").alias("path"), "block", "row", *TRIAL_TYPES
    )


def _comparable(path: Column) -> Column:
    """The part of a path from ``/data/`` on, percent signs decoded."""
    plain = F.url_decode(F.replace(names.single_slashes(path), F.lit("+"), F.lit("%2B")))
    return F.regexp_extract(plain, r"(/data/\d+/export/[^/]+)$", 1)


def write_report(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """A report or result table, replacing an earlier one."""
    writer = df.write.mode("overwrite")
    writer.option("header", True).csv(path) if fmt == "csv" else writer.format(fmt).save(path)


def write_trials(df: DataFrame, path: str) -> None:
    """Trials in folders per day, so that later reads open the days they need."""
    df.write.mode("overwrite").partitionBy("Date").parquet(path)


def save_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """Several result tables side by side."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")
