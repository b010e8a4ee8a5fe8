"""Session log: cleaning, classification, name parsing and checks against raw files."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions import labels, names
from earshot.operators.joins import attach
from earshot.params import DISCRIMINATION_PHASES, EXCLUDED_PHASES


def parse_names(log: DataFrame) -> DataFrame:
    """Frequency, intensity, duration and background out of the session name."""
    file = F.col("File")
    return log.withColumns({
        "Frequency": names.name_part(file, 1),
        "Intensity": names.name_part(file, 2),
        "Duration": names.name_part(file, 3),
        "BG_Type": names.background_part(file, 2),
        "BG_Intensity": names.background_part(file, 3),
    })


def numeric_counts(log: DataFrame, columns=("Trials", "Hit", "FA")) -> DataFrame:
    """Counts typed as text become numbers, NULL where the text is none."""
    return log.withColumns({c: names.number(F.col(c).cast("string")) for c in columns})


def ran(log: DataFrame) -> DataFrame:
    """Sessions known to have run: an unknown name is dropped like ``Did not run``."""
    return log.where(F.col("File") != "Did not run")


def drop_phases(log: DataFrame, phases: list[str] = EXCLUDED_PHASES) -> DataFrame:
    """Sessions with a phase that is not in ``phases``; sessions without one go too."""
    return log.where(F.col("Phase").isNotNull() & ~F.col("Phase").isin(phases))


def drop_phases_older(log: DataFrame) -> DataFrame:
    """The older rule, which keeps discrimination phases and training on noise."""
    return drop_phases(log, [p for p in EXCLUDED_PHASES if p not in DISCRIMINATION_PHASES])


def drop_subjects(df: DataFrame, subjects, column: str = "ID") -> DataFrame:
    """Leave subjects out: a short list, or a DataFrame holding their IDs."""
    if isinstance(subjects, DataFrame):
        return df.join(subjects.select(column).distinct(), column, "left_anti")
    subjects = list(subjects)
    return df.where(~labels.known(F.col(column).isin(subjects))) if subjects else df


def keep_subjects(df: DataFrame, subjects, column: str = "ID") -> DataFrame:
    """Only the given subjects: a short list, or a DataFrame holding their IDs."""
    if isinstance(subjects, DataFrame):
        return df.join(subjects.select(column).distinct(), column, "left_semi")
    return df.where(F.col(column).isin(list(subjects)))


def classify(log: DataFrame) -> DataFrame:
    """Condition, sex and the day's listed thresholds."""
    tone = lambda part: F.when(
        F.col("Frequency") == "4-32kHz", names.listed_threshold(F.col("Thresholds"), part)
    )
    return log.withColumns({
        "Condition": labels.condition_of(F.col("Phase")),
        "Sex": labels.sex_of(F.col("ID")),
        "BBN_TH": F.when(F.col("Frequency") == "BBN", names.whole_number(F.col("Thresholds"))),
        "4_TH": tone(1), "8_TH": tone(2), "16_TH": tone(3), "32_TH": tone(4),
    })


def prepare(log: DataFrame) -> DataFrame:
    """The whole chain: ran, parsed, phases dropped, classified."""
    return classify(drop_phases(parse_names(numeric_counts(ran(log)))))


# Raw files ----------------------------------------------------------------------

SESSION_FIELDS = ["Date", "File", "ID", "Sex", "Condition", "BG_Type", "BG_Intensity"]


def _sessions(log: DataFrame) -> DataFrame:
    return log.select(*SESSION_FIELDS).withColumns({
        "Folder": names.folder_of(F.col("Date")), "_subject": names.squeeze(F.col("ID")),
    })


def _listed(listing: DataFrame) -> DataFrame:
    path = names.single_slashes(F.col("path"))
    return listing.select(path.alias("path")).distinct().withColumns({
        "Folder": F.regexp_extract("path", r"/data/(\d+)/", 1),
        "_file": F.regexp_extract("path", r"([^/]+)$", 1),
    }).withColumn("_subject", F.regexp_extract("_file", r"^([^_]+)_", 1))


def expected_files(log: DataFrame, listing: DataFrame) -> DataFrame:
    """Every session with the files of its day's folder named for its subject and session.

    Matched on folder and subject first, so the name test runs on one subject-day
    only; sessions without a file stay with a NULL.
    """
    files = _listed(listing).withColumnRenamed("path", "FileName_expected")
    named = F.col("_file").contains(F.concat(F.col("_subject"), F.lit("_"), F.col("File"), F.lit("_")))
    s = _sessions(log).withColumn("_id", F.col("_subject"))
    joined = s.join(
        files.withColumnRenamed("_subject", "_fs").withColumnRenamed("Folder", "_ff"),
        (F.col("Folder") == F.col("_ff")) & (F.col("_id") == F.col("_fs")) & named
        & F.col("_file").contains("csv"),
        "left",
    )
    return joined.select(*SESSION_FIELDS, "Folder", "FileName_expected")


def match_files(log: DataFrame, listing: DataFrame) -> DataFrame:
    """:func:`expected_files` with, per session, every file of that subject-day as well."""
    files = _listed(listing).select("Folder", "_subject", F.col("path").alias("FileName_complete"))
    exp = expected_files(log, listing).withColumn("_subject", names.squeeze(F.col("ID")))
    return exp.join(files, ["Folder", "_subject"], "left").select(
        *SESSION_FIELDS, "Folder", "FileName_expected", "FileName_complete"
    )


def file_match(date_check: Column, id_check: Column) -> Column:
    """One check bad is an ISSUE, both good is Good; both bad and both unknown stay NULL."""
    return F.when(date_check != id_check, "ISSUE").when((date_check == id_check) & (date_check == "Good"), "Good")


def check_names(files: DataFrame, path: str = "FileName_complete", missing: str | None = None) -> DataFrame:
    """Date and subject in the path against the session's own.

    ``missing`` is what an unknown check becomes (the trial import writes ``NA``).
    """
    p = names.single_slashes(F.col(path))
    verdict = lambda same: F.when(same, "Good").when(~same, "BAD").otherwise(F.lit(missing).cast("string"))
    return (
        files.withColumns({
            "ActualFile": names.bare_name(p), "Date2": names.path_date(p), "ID2": names.path_subject(p),
        })
        .withColumns({
            "DateCheck": verdict(F.col("Date") == F.col("Date2")),
            "IDCheck": verdict(F.col("ID") == F.col("ID2")),
        })
        .withColumns({
            "File_Match": file_match(F.col("DateCheck"), F.col("IDCheck")),
            "both_bad": labels.known((F.col("DateCheck") == "BAD") & (F.col("IDCheck") == "BAD")),
        })
    )


def file_report(matched: DataFrame) -> DataFrame:
    """Checked sessions for which any file was found."""
    return check_names(matched).where(
        F.col("FileName_complete").isNotNull() | F.col("FileName_expected").isNotNull()
    )


def missing_files(
    log: DataFrame, listing: DataFrame,
    after: dt.date = dt.date(2021, 9, 22), before: dt.date | None = None,
) -> DataFrame:
    """Sessions of the window (open at both ends; up to today by default) with no file."""
    upper = F.lit(before) if before else F.current_date()
    days = _listed(listing).select("Folder", "_subject").distinct()
    return (
        _sessions(log).where((F.col("Date") > F.lit(after)) & (F.col("Date") < upper))
        .join(days, ["Folder", "_subject"], "left_anti")
        .select(*SESSION_FIELDS, "Folder")
        .orderBy("Date", "ID")
    )


def count_mismatches(log: DataFrame, trials: DataFrame) -> DataFrame:
    """Sessions whose logged trial number differs from the imported rows of that subject-day."""
    counts = trials.groupBy("ID", "Date").agg(F.count("*").alias("n"))
    return (
        attach(log.select("ID", "Date", "Trials"), counts, ["ID", "Date"])
        .where(F.col("Trials") != F.col("n"))
    )
