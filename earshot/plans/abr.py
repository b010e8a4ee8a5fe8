"""Evoked-response queries: unions, subjects, growth functions, thresholds."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions.labels import level_rank, stars
from earshot.operators import abr as ops
from earshot.operators.ranktests import adjust_bh, ranksum
from earshot.operators.reshape import long
from earshot.operators.summaries import mean_se
from earshot.params import ABR_CONDITIONS, ABR_FREQS
from earshot.plans import sql as q
from earshot.plans.registry import query
from earshot.plans.sql import statement
from earshot.sources import stand_ins as src

BAND = ["mean", "se", "lower", "upper"]


def combined(spark, sf):
    return ops.combine(*src.abr_sheets(spark, sf))


def detailed(spark, sf):
    return ops.label_frequencies(src.abr_sheets(spark, sf)[1])


@query("abr_union", statement(
    "SELECT ID, Condition, Freq, Inten, RMS, W1, count(*) AS rows FROM abr_all GROUP BY ALL", ["Inten", "RMS", "W1"]))
def abr_union(spark, sf):
    """Both sheets as one, relabelled."""
    return combined(spark, sf).groupBy("ID", "Condition", "Freq", "Inten", "RMS", "W1").agg(F.count("*").alias("rows"))


@query("abr_subjects", statement(
    f"""SELECT Condition, Freq, {q.level_case('Condition', ABR_CONDITIONS)} AS place, count(DISTINCT ID) AS n_ID,
        string_agg(DISTINCT ID, ', ' ORDER BY ID) AS ID FROM abr_all GROUP BY ALL"""))
def abr_subjects(spark, sf):
    """Subjects per condition and frequency."""
    return ops.subjects_per_group(combined(spark, sf), ["Condition", "Freq"]).withColumn(
        "place", level_rank(F.col("Condition"), ABR_CONDITIONS).cast("int"))


@query("abr_cell_means", statement("SELECT * FROM abr_cells", ["Inten", "RMS", "W1"]))
def abr_cell_means(spark, sf):
    """Mean amplitudes per subject, frequency, level and condition."""
    return ops.cell_means(combined(spark, sf))


@query("abr_cell_means_detailed", statement(
    """SELECT ID, Freq, Inten, Condition, CASE WHEN count(RMS) = count(*) THEN avg(RMS) END AS RMS,
       CASE WHEN count(W1) = count(*) THEN avg(W1) END AS W1 FROM abr_detailed GROUP BY ALL""", ["Inten", "RMS", "W1"]))
def abr_cell_means_detailed(spark, sf):
    """The same for the detailed sheet."""
    return ops.cell_means(detailed(spark, sf))


def _growth(name, value, rows, source):
    by = ["Freq", "Inten", "Condition"]

    @query(name, statement(q.mean_se(source, by, value, "Inten BETWEEN 10 AND 100"), ["Inten", *BAND]))
    def run(spark, sf):
        return mean_se(rows(spark, sf), by, value, (10, 100), on="Inten")


_growth("abr_rms_growth", "RMS", combined, "abr_all")
_growth("abr_rms_growth_detailed", "RMS", detailed, "abr_detailed")
_growth("abr_w1_growth", "W1", combined, "abr_all")
_growth("abr_w1_growth_detailed", "W1", detailed, "abr_detailed")


def at_level(df, level):
    """Rows at a level given as text or number."""
    return df.where(F.col("Inten") == float(level))


@query("abr_w1_80", statement(q.mean_se("abr_all", ["Condition", "Freq"], "W1", "Inten = 80"), BAND))
def abr_w1_80(spark, sf):
    """Wave-1 amplitude at 80 dB."""
    return mean_se(at_level(combined(spark, sf), "80"), ["Condition", "Freq"], "W1")


@query("abr_w1_80_detailed", statement(q.mean_se("abr_detailed", ["Condition", "Freq"], "W1", "Inten = 80"), BAND))
def abr_w1_80_detailed(spark, sf):
    """The same for the detailed sheet."""
    return mean_se(at_level(detailed(spark, sf), "80"), ["Condition", "Freq"], "W1")


def weekly_test(rows, week):
    """Is wave 1 larger at Baseline? One test per frequency, adjusted, with stars."""
    tests = ranksum(at_level(rows, "80"), ["Freq"], "W1", "Condition", "Baseline", week)
    tests = tests.withColumn("p", F.bround("p", 3))
    return adjust_bh(tests, "p").withColumn("BH", F.bround("BH", 3)).withColumn("Sig", stars(F.col("BH")))


def _weekly(name, week):
    ranked = q.midranks(f"(SELECT Freq, Condition, W1 FROM abr_all WHERE Inten = 80 AND Condition IN ('Baseline', '{week}')) t", "W1", "Freq")
    body = f"""
SELECT Freq, n1, n2, w, z, p, BH, {q.stars('BH')} AS Sig FROM
 (SELECT *, CAST(round_even(least(1, min(p * m / k) OVER (ORDER BY p DESC)), 3) AS DOUBLE) AS BH FROM
  (SELECT *, count(*) OVER () AS m, count(*) OVER (ORDER BY p) AS k FROM
   (SELECT Freq, n1, n2, w, z, CAST(round_even({q.normal_upper('z')}, 3) AS DOUBLE) AS p FROM
    (SELECT Freq, n1, n2, w, (w - n1 * n2 / 2.0 - 0.5) / sqrt(n1 * n2 / 12.0 * (n + 1 - ties / (n * (n - 1)))) AS z FROM
     (SELECT Freq, count(*) FILTER (Condition = 'Baseline') AS n1, count(*) FILTER (Condition <> 'Baseline') AS n2,
        sum(mr) FILTER (Condition = 'Baseline') - count(*) FILTER (Condition = 'Baseline') * (count(*) FILTER (Condition = 'Baseline') + 1) / 2.0 AS w,
        any_value(big_n)::DOUBLE AS n, sum(tie ** 2 - 1) AS ties FROM ({ranked}) GROUP BY Freq)))))"""

    @query(name, statement(body, ["w", "z", "p", "BH"]))
    def run(spark, sf):
        return weekly_test(combined(spark, sf), week)


_weekly("ranksum_1_week", "1 week")
_weekly("ranksum_2_week", "2 week")
_weekly("ranksum_4_5_week", "4-5 week")


@query("abr_threshold_subjects", statement(
    """SELECT Condition, Ear, Freq, count(DISTINCT ID) + max(CASE WHEN ID IS NULL THEN 1 ELSE 0 END) AS n_ID,
       string_agg(DISTINCT coalesce(ID, 'NA'), ', ' ORDER BY coalesce(ID, 'NA')) AS ID FROM abr_th GROUP BY ALL"""))
def abr_threshold_subjects(spark, sf):
    """Subjects per condition, ear and frequency."""
    return ops.subjects_per_group(src.abr_thresholds(spark, sf), ["Condition", "Ear", "Freq"])


@query("abr_threshold_means", statement(
    """SELECT Condition, Freq, count(DISTINCT ID) + max(CASE WHEN ID IS NULL THEN 1 ELSE 0 END) AS n, avg(Run_TH) AS Run_TH,
       avg(RMS_TH) AS RMS_TH, avg(Wave_TH) AS Wave_TH FROM abr_th GROUP BY ALL""", ["Run_TH", "RMS_TH", "Wave_TH"]))
def abr_threshold_means(spark, sf):
    """Mean thresholds by three criteria."""
    return ops.threshold_means(src.abr_thresholds(spark, sf))


def threshold_rows(spark, sf):
    """Wave thresholds in long form, known ones at the common frequencies."""
    rows = src.abr_thresholds(spark, sf).where(F.col("Freq").isin(ABR_FREQS))
    return long(rows, ["ID", "Condition", "Ear", "Freq"], ["Wave_TH"], "Measure", "TH").where(F.col("TH").isNotNull())


@query("abr_threshold_long", statement(
    "SELECT Condition, Freq, 'Wave_TH' AS Measure, TH, count(*) AS rows FROM abr_th_rows GROUP BY ALL", ["TH"]))
def abr_threshold_long(spark, sf):
    """Counts of wave thresholds."""
    return threshold_rows(spark, sf).groupBy("Condition", "Freq", "Measure", "TH").agg(F.count("*").alias("rows"))
