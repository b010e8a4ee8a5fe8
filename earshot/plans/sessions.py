"""Session-log queries: cleaning, classification, raw-file checks, phase days."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from earshot.functions import labels, names
from earshot.operators import sessions as ops, summaries
from earshot.operators.reshape import long
from earshot.operators.summaries import box, log_summary
from earshot.params import BACKGROUNDS, CONDITIONS, DISCRIMINATION_PHASES, EXCLUDED_PHASES, NOISE_TITLES, Params
from earshot.plans.registry import query
from earshot.plans.sql import BACKGROUND, box as box_sql, level_case, statement
from earshot.sources import stand_ins as src

PARAMS = Params()
LOG_KEYS = ["ID", "Sex", "Condition", "Frequency", "BG_Type", "BG_Intensity"]
TODAY = dt.date(2024, 1, 28)


def sessions(spark, sf):
    return ops.prepare(src.session_log(spark, sf))


@query("session_ran", statement(
    "SELECT ID, Date, File, Trials, Hit, FA FROM raw_log WHERE File <> 'Did not run'", ["Trials", "Hit", "FA"], ["Date"]))
def session_ran(spark, sf):
    """Sessions known to have run, counts as numbers."""
    return ops.numeric_counts(ops.ran(src.session_log(spark, sf))).select("ID", "Date", "File", "Trials", "Hit", "FA")


@query("phase_filter", statement(
    f"SELECT ID, Date, Phase FROM raw_log WHERE Phase IS NOT NULL AND Phase NOT IN ({', '.join(repr(p) for p in EXCLUDED_PHASES)})",
    dates=["Date"]))
def phase_filter(spark, sf):
    """Sessions whose phase is known and analysed."""
    return ops.drop_phases(src.session_log(spark, sf)).select("ID", "Date", "Phase")


@query("phase_filter_older", statement(
    f"SELECT ID, Date, Phase FROM raw_log WHERE Phase IS NOT NULL AND Phase NOT IN ({', '.join(repr(p) for p in EXCLUDED_PHASES if p not in DISCRIMINATION_PHASES)})",
    dates=["Date"]))
def phase_filter_older(spark, sf):
    """Sessions by the older rule, which keeps discrimination phases and training on noise."""
    return ops.drop_phases_older(src.session_log(spark, sf)).select("ID", "Date", "Phase")


@query("noise_titles", statement(
    f"""SELECT BG_Type, CASE {' '.join(f"WHEN BG_Type = '{k}' THEN '{v}'" for k, v in NOISE_TITLES.items())} END AS title,
      count(*) AS sessions FROM sessions GROUP BY ALL"""))
def noise_titles(spark, sf):
    """Titles of the background noises sessions were run in."""
    return sessions(spark, sf).groupBy("BG_Type").agg(F.count("*").alias("sessions")).withColumn("title", labels.noise_title(F.col("BG_Type")))


_LOGGED = """(SELECT ID, Condition, BG_Type, BG_Intensity, Duration, Type, count(*) AS n, round_even(avg(TH), 0) AS mean,
   round_even(quantile_cont(TH, 0.5), 0) AS median, min(TH) AS min, max(TH) AS max FROM
  (SELECT ID, Condition, BG_Type, BG_Intensity, Duration, unnest(['BBN', '4', '8', '16', '32']) AS Type,
    unnest([BBN_TH::DOUBLE, "4_TH", "8_TH", "16_TH", "32_TH"]) AS TH FROM sessions)
  WHERE TH IS NOT NULL AND NOT coalesce(Type = 'BBN' AND BG_Intensity IN ('30', '50'), false) GROUP BY ALL)"""


@query("logged_thresholds", statement(f"SELECT * FROM {_LOGGED}", ["mean", "median", "min", "max"]))
def logged_thresholds(spark, sf):
    """Logged thresholds described per subject, setting and type."""
    return summaries.logged_thresholds(sessions(spark, sf))


@query("logged_thresholds_wide", statement(
    "SELECT ID, Condition, BG_Type, BG_Intensity, Duration, "
    + ", ".join(f"""avg(mean) FILTER (Type = '{t}') AS "{t}" """ for t in ("BBN", "4", "8", "16", "32")) + f" FROM {_LOGGED} GROUP BY ALL",
    ["BBN", "4", "8", "16", "32"]))
def logged_thresholds_wide(spark, sf):
    """Mean logged thresholds, one column per type."""
    return summaries.logged_thresholds_wide(sessions(spark, sf))


@query("session_subjects", statement("SELECT DISTINCT Condition, coalesce(ID, 'NA') AS ID FROM sessions"))
def session_subjects(spark, sf):
    """Subjects of each condition, one row each."""
    return summaries.distinct_values(sessions(spark, sf), ["Condition"], "ID")


@query("filename_parse", statement(
    "SELECT ID, Date, File, Frequency, Intensity, Duration, BG_Type, BG_Intensity FROM parsed_log", dates=["Date"]))
def filename_parse(spark, sf):
    """Session names taken apart."""
    return ops.parse_names(ops.ran(src.session_log(spark, sf))).select(
        "ID", "Date", "File", "Frequency", "Intensity", "Duration", "BG_Type", "BG_Intensity")


@query("session_classify", statement("SELECT ID, Date, Phase, Condition, Sex FROM sessions", dates=["Date"]))
def session_classify(spark, sf):
    """Condition and sex of every analysed session."""
    return sessions(spark, sf).select("ID", "Date", "Phase", "Condition", "Sex")


@query("threshold_split", statement(
    'SELECT ID, Date, Thresholds, BBN_TH, "4_TH", "8_TH", "16_TH", "32_TH" FROM sessions',
    ["BBN_TH", "4_TH", "8_TH", "16_TH", "32_TH"], ["Date"]))
def threshold_split(spark, sf):
    """Listed thresholds as one column per stimulus."""
    return sessions(spark, sf).select("ID", "Date", "Thresholds", "BBN_TH", "4_TH", "8_TH", "16_TH", "32_TH")


@query("subject_exclude", statement(
    "SELECT ID, count(*) AS sessions FROM sessions WHERE ID NOT IN ('Green 2') GROUP BY ID"))
def subject_exclude(spark, sf):
    """Sessions per subject without the excluded ones."""
    return ops.drop_subjects(sessions(spark, sf), PARAMS.excluded_subjects).groupBy("ID").agg(F.count("*").alias("sessions"))


@query("subject_subset", statement("SELECT ID, count(*) AS sessions FROM raw_log WHERE ID IN ('Green 1', 'Orange 1') GROUP BY ID"))
def subject_subset(spark, sf):
    """Sessions of a listed subset of subjects."""
    return ops.keep_subjects(src.session_log(spark, sf), ["Green 1", "Orange 1"]).groupBy("ID").agg(F.count("*").alias("sessions"))


@query("background_labels", statement(
    f"SELECT BG_Type, BG_Intensity, {BACKGROUND} AS BG, count(*) AS sessions FROM sessions GROUP BY ALL"))
def background_labels(spark, sf):
    """Readable background of every session."""
    return sessions(spark, sf).groupBy("BG_Type", "BG_Intensity").agg(F.count("*").alias("sessions")).withColumn(
        "BG", labels.background_label(F.col("BG_Type"), F.col("BG_Intensity")))


@query("level_order", statement(
    f"SELECT Condition, {level_case('Condition', CONDITIONS)} AS place, count(*) AS sessions FROM sessions GROUP BY ALL"))
def level_order(spark, sf):
    """Conditions in their own order."""
    return (
        sessions(spark, sf).groupBy("Condition").agg(F.count("*").alias("sessions"))
        .withColumn("place", labels.level_rank(F.col("Condition"), CONDITIONS).cast("int")).orderBy("place")
    )


@query("recode_levels", statement(
    """SELECT CASE WHEN Duration IN ('50ms', '100ms', '300ms') THEN 'Alone' WHEN Duration = '50-300ms' THEN 'Mixed' ELSE Duration END
       AS Duration, count(*) AS sessions FROM sessions GROUP BY ALL"""))
def recode_levels(spark, sf):
    """Sessions per set of durations."""
    from earshot.operators.reaction import DURATION_SETS
    return sessions(spark, sf).withColumn("Duration", labels.recode(F.col("Duration"), DURATION_SETS)).groupBy(
        "Duration").agg(F.count("*").alias("sessions"))


_EXPECTED = """
SELECT s.Date, s.File, s.ID, s.Sex, s.Condition, s.BG_Type, s.BG_Intensity, strftime(s.Date, '%Y%m%d') AS Folder, f.path AS FileName_expected
FROM sessions s LEFT JOIN listed_files f ON f.folder = strftime(s.Date, '%Y%m%d') AND f.subject = replace(s.ID, ' ', '')
  AND contains(f.name, replace(s.ID, ' ', '') || '_' || s.File || '_')"""


@query("expected_files", statement(_EXPECTED, dates=["Date"]))
def expected_files(spark, sf):
    """Sessions with the raw files named for them."""
    return ops.expected_files(sessions(spark, sf), src.file_listing(spark, sf))


@query("matched_files", statement(
    f"""SELECT e.*, f.path AS FileName_complete FROM ({_EXPECTED}) e LEFT JOIN listed_files f
        ON f.folder = e.Folder AND f.subject = replace(e.ID, ' ', '')""", dates=["Date"]))
def matched_files(spark, sf):
    """Sessions with the files named for them and with all files of the subject's day."""
    return ops.match_files(sessions(spark, sf), src.file_listing(spark, sf))


_CHECK = rf"""
SELECT Date, ID, File, path, ActualFile, CAST(Date2 AS VARCHAR) AS Date2, ID2, DateCheck, IDCheck,
  CASE WHEN DateCheck <> IDCheck THEN 'ISSUE' WHEN DateCheck = 'Good' AND IDCheck = 'Good' THEN 'Good' END AS File_Match,
  DateCheck = 'BAD' AND IDCheck = 'BAD' AS both_bad
FROM (SELECT *, CASE WHEN Date = Date2 THEN 'Good' ELSE 'BAD' END AS DateCheck, CASE WHEN ID = ID2 THEN 'Good' ELSE 'BAD' END AS IDCheck
  FROM (SELECT Date, ID, File, path,
    regexp_replace(regexp_replace(path, '{names.BEFORE_NAME}', ''), '{names.AFTER_NAME}', '') AS ActualFile,
    CAST(strptime(regexp_extract(path, '{names.DATE_FOLDER}', 1), '%Y%m%d') AS DATE) AS Date2,
    regexp_replace(path, '{names.SUBJECT_IN_PATH}', '\1 \2') AS ID2 FROM claimed_files))"""


@query("file_check", statement(_CHECK, dates=["Date"]))
def file_check(spark, sf):
    """Date and subject in every claimed path against its session."""
    return ops.check_names(src.file_listing(spark, sf), "path").select(
        "Date", "ID", "File", "path", "ActualFile", "Date2", "ID2", "DateCheck", "IDCheck", "File_Match", "both_bad")


@query("file_report", statement(
    f"""SELECT ID, count(*) AS files, count(DISTINCT Date) AS days FROM ({_EXPECTED}) e JOIN listed_files f
        ON f.folder = e.Folder AND f.subject = replace(e.ID, ' ', '') GROUP BY ID"""))
def file_report(spark, sf):
    """Files in the check report per subject."""
    return ops.file_report(ops.match_files(sessions(spark, sf), src.file_listing(spark, sf))).groupBy("ID").agg(
        F.count("*").alias("files"), F.count_distinct("Date").alias("days"))


@query("missing_files", statement(
    """SELECT Date, File, ID, Sex, Condition, BG_Type, BG_Intensity, strftime(Date, '%Y%m%d') AS Folder FROM sessions s
       WHERE Date > DATE '2021-09-22' AND Date < DATE '2024-01-28' AND NOT EXISTS (SELECT 1 FROM listed_files f
         WHERE f.folder = strftime(s.Date, '%Y%m%d') AND f.subject = replace(s.ID, ' ', ''))""", dates=["Date"]))
def missing_files(spark, sf):
    """Sessions of the export era without any raw file."""
    return ops.missing_files(sessions(spark, sf), src.file_listing(spark, sf), before=TODAY)


@query("trial_count_check", statement(
    """SELECT s.ID, s.Date, s.Trials, n FROM sessions s JOIN (SELECT ID, Date, count(*) AS n FROM trials GROUP BY ALL) t
       ON s.ID = t.ID AND s.Date = t.Date WHERE s.Trials <> n""", ["Trials"], ["Date"]))
def trial_count_check(spark, sf):
    """Sessions whose logged trial number differs from their trials."""
    return ops.count_mismatches(sessions(spark, sf), src.trials(spark, sf))


@query("phase_days", statement(
    """SELECT ID, Condition, Duration, Frequency, Intensity, replace(BG_Type, 'PNK', 'PKN') AS BG_Type, BG_Intensity,
       count(*) AS Days, sum(Trials) AS Trials FROM sessions WHERE Condition = 'Post HHL' AND Duration = '50ms' GROUP BY ALL""", ["Trials"]))
def phase_days(spark, sf):
    """Days and trials per kind of session after hearing loss."""
    return (
        sessions(spark, sf).where((F.col("Condition") == "Post HHL") & (F.col("Duration") == "50ms"))
        .withColumn("BG_Type", F.regexp_replace("BG_Type", "PNK", "PKN"))
        .groupBy("ID", "Condition", "Duration", "Frequency", "Intensity", "BG_Type", "BG_Intensity")
        .agg(F.count("*").alias("Days"), F.sum("Trials").alias("Trials")).orderBy("Days")
    )


@query("hit_summary_log", statement("SELECT * FROM log_means", ["Trials", "Hit", "FA"]))
def hit_summary_log(spark, sf):
    """Means of logged trials, hits and false alarms per subject and setting."""
    return log_summary(ops.drop_subjects(sessions(spark, sf), PARAMS.excluded_subjects), LOG_KEYS)


_LOG_LONG = """(SELECT Condition, BG_Intensity, unnest(['Trials', 'Hit', 'FA']) AS variable, unnest([Trials, Hit, FA]) AS value
  FROM log_means WHERE Condition NOT IN ({})) t"""
_BOX = ["lower", "middle", "upper", "ymin", "ymax"]


def _log_box(spark, sf, dropped):
    rows = log_summary(ops.drop_subjects(sessions(spark, sf), PARAMS.excluded_subjects), LOG_KEYS)
    rows = long(rows.where(~F.col("Condition").isin(dropped)), LOG_KEYS, ["Trials", "Hit", "FA"], "variable", "value")
    return box(rows, ["variable", "BG_Intensity", "Condition"], "value")


@query("log_box", statement(box_sql(
    _LOG_LONG.format("'Recovery 2', 'Post 2nd Exposure'"), ["variable", "BG_Intensity", "Condition"], "value"), _BOX))
def log_box(spark, sf):
    """Box summaries of logged trials, hits and false alarms."""
    return _log_box(spark, sf, ["Recovery 2", "Post 2nd Exposure"])


@query("log_box_no_recovery", statement(box_sql(
    _LOG_LONG.format("'Recovery', 'Recovery 2', 'Post 2nd Exposure'"), ["variable", "BG_Intensity", "Condition"], "value"), _BOX))
def log_box_no_recovery(spark, sf):
    """The same without the recovery sessions."""
    return _log_box(spark, sf, ["Recovery", "Recovery 2", "Post 2nd Exposure"])


@query("background_order", statement(
    f"SELECT BG_Intensity, {level_case('BG_Intensity', BACKGROUNDS)} AS place, avg(Trials) AS Trials FROM sessions GROUP BY ALL", ["Trials"]))
def background_order(spark, sf):
    """Mean logged trials per background level, in level order."""
    return (
        sessions(spark, sf).groupBy("BG_Intensity").agg(F.avg("Trials").alias("Trials"))
        .withColumn("place", labels.level_rank(F.col("BG_Intensity"), BACKGROUNDS).cast("int")).orderBy("place")
    )
