"""Evoked-response (ABR) amplitudes and thresholds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.functions.labels import recode
from earshot.operators.reshape import stack
from earshot.operators.summaries import distinct_count, distinct_text, strict_mean
from earshot.params import ABR_FREQS


def label_frequencies(sheet: DataFrame) -> DataFrame:
    return sheet.withColumn("Freq", recode(F.col("Freq"), {"0": "BBN"}))


def combine(short: DataFrame, detailed: DataFrame) -> DataFrame:
    """Both sheets on the common frequencies, weeks 4 and 5 taken together."""
    rows = stack(label_frequencies(detailed).where(F.col("Freq").isin(ABR_FREQS)), label_frequencies(short))
    return rows.withColumn("Condition", F.regexp_replace("Condition", "^[45] week$", "4-5 week"))


def cell_means(rows: DataFrame) -> DataFrame:
    """Mean amplitudes per subject, frequency, level and condition; NULL if any value is."""
    return rows.groupBy("ID", "Freq", "Inten", "Condition").agg(
        strict_mean("RMS").alias("RMS"), strict_mean("W1").alias("W1"),
    )


def subjects_per_group(rows: DataFrame, by: list[str]) -> DataFrame:
    return rows.groupBy(*by).agg(distinct_count("ID").alias("n_ID"), distinct_text("ID").alias("ID"))


def threshold_means(rows: DataFrame) -> DataFrame:
    return rows.groupBy("Condition", "Freq").agg(
        distinct_count("ID").alias("n"),
        F.avg("Run_TH").alias("Run_TH"), F.avg("RMS_TH").alias("RMS_TH"), F.avg("Wave_TH").alias("Wave_TH"),
    )
