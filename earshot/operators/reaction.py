"""Reaction times of hits above threshold: selection, description, change, daily means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.labels import recode, stim_kind
from earshot.operators.joins import attach, lookup
from earshot.operators.reshape import long, wide
from earshot.operators.summaries import describe, strict_mean
from earshot.params import RXN_KEYS

NO_THRESHOLD = -99.0
NO_GO_LEVEL = -100.0


def is_go_hit() -> Column:
    return (F.col("Type") == 1) & (F.col("Response") == "Hit") & (F.col("Inten") != NO_GO_LEVEL)


def go_hits(trials: DataFrame) -> DataFrame:
    """Hits on go trials at a real level."""
    return trials.where(is_go_hit())


def _setting(match_background_type: bool) -> list[str]:
    return ["ID", "Condition", "BG_Intensity", "Dur"] + (["BG_Type"] if match_background_type else [])


def known_thresholds(th_long: DataFrame, setting: list[str]) -> DataFrame:
    """All thresholds of a setting in one row, ordered by background type and stimulus.

    As many entries as the setting has backgrounds and stimuli.
    """
    entry = F.struct(F.col("BG_Type").alias("bg"), F.col("Type").alias("kind"), "Sex", "TH")
    return th_long.groupBy(*setting).agg(F.array_sort(F.collect_list(entry)).alias("_known"))


def over_threshold(hits: DataFrame, th_long: DataFrame, match_background_type: bool = False) -> DataFrame:
    """Rows at or above their setting's cutoff.

    A setting without any threshold row keeps everything; one whose threshold for
    the stimulus is NULL or missing keeps nothing. Without ``match_background_type``
    the first background type by name decides. Works on trials and on counted trials.
    """
    setting = _setting(match_background_type)
    own = F.expr("get(filter(_known, e -> e.bg <=> _known[0].bg AND e.kind = _kind), 0).TH")
    cut = F.when(F.col("_known").isNull(), NO_THRESHOLD).otherwise(own)
    return (
        lookup(hits, known_thresholds(th_long, setting), setting)
        .withColumn("_kind", stim_kind(F.col("Freq")))
        .where(F.col("Inten") >= cut).drop("_known", "_kind")
    )


def counted(trials: DataFrame, by: list[str] = RXN_KEYS, extra: list[str] = ()) -> DataFrame:
    """Trials summed up per setting, type and response: trials ``n``, summed and counted times.

    Small, and enough for d', thresholds and mean reaction times, so that a report
    needing all three reads the trials once.
    """
    return trials.groupBy(*by, *extra, "Type", "Response").agg(
        F.count("*").alias("n"), F.sum("RTime").alias("RTime_sum"), F.count("RTime").alias("RTime_n"),
    )


def describe_reaction(hits: DataFrame, keys: list[str] = RXN_KEYS, width: float = 1.0, weight: str | None = None) -> DataFrame:
    """Full description of reaction times; ``width`` is the order step in ms."""
    return describe(hits, keys, "RTime", width=width, weight=weight)


def mean_reaction(cells: DataFrame, keys: list[str] = RXN_KEYS) -> DataFrame:
    """Number and mean from :func:`counted` trials."""
    return cells.groupBy(*keys).agg(
        F.sum("RTime_n").alias("n"), F.try_divide(F.sum("RTime_sum"), F.sum("RTime_n")).alias("mean"),
    )


def reaction_change(rxn: DataFrame, before: str = "Baseline", after: str = "Post HHL") -> DataFrame:
    """Mean reaction time after minus before, NULL where either is missing."""
    keys = [k for k in RXN_KEYS if k != "Condition"]
    both = (
        wide(rxn.where(F.col("Condition").isin(before, after)), keys, "Condition", "mean", [before, after])
        .withColumn("Rxn_change", F.col(after) - F.col(before))
    )
    return long(both, [*keys, before, after], ["Rxn_change"], "Condition", "mean")


DAILY_KEYS = ["ID", "Condition", "BG_Type", "BG_Intensity", "Dur", "Freq", "Inten"]


def daily_reaction(cells: DataFrame) -> DataFrame:
    """Mean over days of each day's mean reaction time, from trials counted per ``Date``."""
    per_day = mean_reaction(cells, ["Date", *DAILY_KEYS, "Stim"])
    return per_day.groupBy(*DAILY_KEYS).agg(strict_mean("mean").alias("mean"))


def overall_and_daily(cells: DataFrame) -> DataFrame:
    """Overall means with the daily-averaged mean beside them."""
    daily = daily_reaction(cells).withColumnRenamed("mean", "mean_daily")
    return attach(mean_reaction(cells), daily, DAILY_KEYS)


# --- fixed values: duration sets by session name ---
DURATION_SETS = {"50ms": "Alone", "100ms": "Alone", "300ms": "Alone", "50-300ms": "Mixed"}
# ---------------------------------------------------


def duration_means(trials: DataFrame, log: DataFrame) -> DataFrame:
    """Mean reaction time to noise at Baseline per subject, duration set, duration and level.

    Each trial takes the duration set of its day's noise session. Trials are summed
    per subject and day before the join, so a day with two sessions counts twice
    without the trials themselves being repeated.
    """
    keys = ["ID", "Sex", "Condition", "Stim", "Dur", "Inten"]
    per_day = (
        go_hits(trials).where((F.col("Stim") == "BBN") & (F.col("Condition") == "Baseline"))
        .groupBy("Date", *keys)
        .agg(F.sum("RTime").alias("_sum"), F.count("RTime").alias("_n"), F.count("*").alias("_rows"))
    )
    sets = log.where((F.col("Frequency") == "BBN") & (F.col("Condition") == "Baseline")).select("Date", "ID", "Duration")
    joined = attach(per_day, sets, ["Date", "ID"])
    return (
        joined.groupBy(*keys, "Duration")
        .agg(F.when(F.sum("_rows") == F.sum("_n"), F.try_divide(F.sum("_sum"), F.sum("_n"))).alias("Rxn"))
        .withColumn("Duration", recode(F.col("Duration"), DURATION_SETS))
    )
