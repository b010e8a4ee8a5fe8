"""Parsing of session names, threshold lists and raw-file paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: name patterns ---
NAME_PATTERN = r"(^.*?)_(.*?dB)_(.*?ms)_.*$"
BACKGROUND_PATTERN = r"(^.*?_BG_)(.*?)_(\d+).*"
FOUR_NUMBERS = r"^(.*?), (.*?), (.*?), (.+?)$"
DATE_FOLDER = r"/data/(\d{8})/"
SUBJECT_IN_PATH = r".*/export/(\D+?)(\d+?)_.*"
BEFORE_NAME = r".?/data/\d+/export/.+?_"
AFTER_NAME = r"_\d{8}-\d+.*_raw_data.csv"
# -----------------------------------


def name_part(file: Column, part: int) -> Column:
    """Frequency (1), intensity (2) or duration (3); a name that does not fit is returned whole."""
    return F.regexp_replace(file, NAME_PATTERN, f"${part}")


def background_part(file: Column, part: int) -> Column:
    """Background type (2) or intensity (3), the text ``NA`` where the name has none."""
    return F.when(
        file.contains("_BG_"), F.regexp_replace(file, BACKGROUND_PATTERN, f"${part}")
    ).when(file.isNotNull(), "NA").otherwise("NA")


def number(text: Column) -> Column:
    """Number in a text, NULL where it is none."""
    return F.trim(text).try_cast("double")


def whole_number(text: Column) -> Column:
    """Number rounded half to even."""
    return F.bround(number(text), 0)


def listed_threshold(thresholds: Column, part: int) -> Column:
    """One of four listed numbers; a lone number does not match and stands for all four."""
    return whole_number(F.regexp_replace(thresholds, FOUR_NUMBERS, f"${part}"))


def single_slashes(path: Column) -> Column:
    return F.regexp_replace(path, "/+", "/")


def path_date(path: Column) -> Column:
    """Date of the ``/data/yyyyMMdd/`` folder, NULL where there is none."""
    digits = F.regexp_extract(path, DATE_FOLDER, 1)
    return F.try_to_date(F.nullif(digits, F.lit("")), "yyyyMMdd")


def path_subject(path: Column) -> Column:
    """``Green1_...`` after ``/export/`` becomes ``Green 1``; else the path unchanged."""
    return F.regexp_replace(path, SUBJECT_IN_PATH, "$1 $2")


def bare_name(path: Column) -> Column:
    """Session name inside a raw-file name: no folder, no subject, no time stamp."""
    inner = F.regexp_replace(path, BEFORE_NAME, "")
    return F.regexp_replace(inner, AFTER_NAME, "")


def folder_of(date: Column) -> Column:
    return F.date_format(date, "yyyyMMdd")


def squeeze(text: Column) -> Column:
    """Text without white space."""
    return F.regexp_replace(text, r"\s", "")
