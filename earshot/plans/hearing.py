"""Trial queries: blocks, rates, detection, thresholds, reaction times and the tables behind graphs."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from earshot.operators import blocks, curves, reaction, sdt
from earshot.operators.reshape import in_every_condition, long
from earshot.operators.sessions import drop_subjects
from earshot.operators.summaries import box, count_labels, daily_rates, describe, hit_summary, mean_se, outliers
from earshot.params import CURVE_KEYS, HIT_KEYS, Params, RXN_KEYS, STIM_TYPES
from earshot.plans import sql as q
from earshot.plans.registry import query
from earshot.plans.sessions import sessions
from earshot.plans.sql import statement
from earshot.session import cut_lineage, shared_path
from earshot.sources import layer, stand_ins as src

PARAMS = Params(min_blocks=src.TEST_MIN_BLOCKS, block_sizes=src.TEST_BLOCK_SIZES)
ORDER = ["ts", "event_id"]
BAND = ["mean", "se", "lower", "upper"]
BOX = ["lower", "middle", "upper", "ymin", "ymax"]
INDICES = ["dB", "Dur", "dprime", "beta", "aprime", "bppd", "c"]


def no_first(spark, sf):
    return blocks.drop_first_block(src.trials(spark, sf), ORDER, src.trial_slot(), PARAMS)


def analysis(spark, sf):
    """Trials without the warm-up block and without excluded subjects, who are left out first: blocks are per subject."""
    kept = drop_subjects(src.trials(spark, sf), PARAMS.excluded_subjects)
    return blocks.drop_first_block(kept, ORDER, src.trial_slot(), PARAMS)


def dprimes(spark, sf):
    return sdt.dprime_table(analysis(spark, sf))


def thresholds(spark, sf):
    return curves.thresholds(dprimes(spark, sf), PARAMS.th_cutoff)


def stored_trials(spark, sf, days=(None, None)):
    """Trials of ``days`` without excluded subjects, numbered, from a layer stored by this call."""
    path = shared_path(spark)
    trials = drop_subjects(src.trials(spark, sf), PARAMS.excluded_subjects)
    layer.store(trials, path, ORDER, src.trial_slot())
    return layer.read(spark, path, *days, schema=trials.schema)


def stored_analysis(spark, sf):
    """:func:`analysis` from a stored layer: trials are ordered once, however often the result is read."""
    return blocks.kept_rows(stored_trials(spark, sf), PARAMS)


def over_threshold(spark, sf):
    """Hits above threshold; the layer is scanned for thresholds and again for hits, the trials once."""
    trials = stored_analysis(spark, sf)
    th = curves.thresholds(sdt.dprime_table(trials), PARAMS.th_cutoff)
    return reaction.over_threshold(reaction.go_hits(trials), th)


def counted_over_threshold(spark, sf, extra=()):
    """Counted hits above threshold, also by ``extra``; trials are read once for thresholds and times."""
    cells = cut_lineage(reaction.counted(analysis(spark, sf), extra=extra))
    th = curves.thresholds(sdt.dprime_table(cells, weight="n"), PARAMS.th_cutoff)
    return reaction.over_threshold(reaction.go_hits(cells), th)


def times_over_threshold(spark, sf):
    """Reaction times of hits above threshold with their counts, from one pass over the trials.

    Only go hits are counted by time, so other trials stay one row per setting and response.
    """
    trials = analysis(spark, sf)
    timed = trials.withColumn("RTime", F.when(reaction.is_go_hit(), F.col("RTime")))
    cells = cut_lineage(reaction.counted(timed, extra=["RTime"]))
    th = curves.thresholds(sdt.dprime_table(cells, weight="n"), PARAMS.th_cutoff)
    return reaction.over_threshold(reaction.go_hits(cells), th)


def rxn_means(spark, sf):
    return reaction.mean_reaction(counted_over_threshold(spark, sf))


# Blocks ---------------------------------------------------------------------------

_KEPT = ["Inten", "Dur", "RTime", "Freq"]


@query("no_first_block", statement(
    "SELECT Date, ID, Sex, Stim, event_id, RTime, Blocks_trimmed, block_row FROM no_first", ["RTime"], ["Date"]))
def no_first_block(spark, sf):
    """Trials from the second to the last whole block of each recording."""
    return no_first(spark, sf).select("Date", "ID", "Sex", "Stim", "event_id", "RTime", "Blocks_trimmed", "block_row")


@query("stored_blocks", statement(
    """SELECT Date, ID, Sex, Stim, Blocks_trimmed, count(*) AS rows, avg(RTime) AS RTime FROM analysis
       WHERE Date BETWEEN (SELECT min(Date) + INTERVAL 2 DAY FROM trials) AND (SELECT min(Date) + INTERVAL 20 DAY FROM trials) GROUP BY ALL""",
    ["RTime"], ["Date"]))
def stored_blocks(spark, sf):
    """Kept trials and mean time per recording of a span of days, read from a stored layer."""
    start = src.trials(spark, sf).agg(F.min("Date")).first()[0]
    span = (start + dt.timedelta(days=2), start + dt.timedelta(days=20)) if start else (None, None)
    return blocks.kept_rows(stored_trials(spark, sf, span), PARAMS).groupBy(
        *blocks.BLOCK_KEYS, "Blocks_trimmed").agg(F.count("*").alias("rows"), F.avg("RTime").alias("RTime"))


@query("block_count", statement("SELECT * FROM blocks_left", dates=["Date"]))
def block_count(spark, sf):
    """Whole blocks per recording after the first."""
    return blocks.block_counts(src.trials(spark, sf), PARAMS)


@query("block_caps", statement("SELECT * FROM caps"))
def block_caps(spark, sf):
    """Blocks that all recordings reach."""
    return blocks.block_caps(src.trials(spark, sf), PARAMS)


@query("trimmed_blocks", statement(
    """SELECT Date, ID, Sex, Stim, event_id, RTime, Blocks_trimmed, block_row FROM no_first, caps WHERE Blocks_trimmed >= tone_cap
       AND block_row <= CASE Stim WHEN 'tone' THEN tone_cap * 10 ELSE bbn_cap * 5 END""", ["RTime"], ["Date"]))
def trimmed_blocks(spark, sf):
    """Recordings cut to the common number of blocks."""
    return blocks.trim_blocks(src.trials(spark, sf), ORDER, src.trial_slot(), PARAMS).select(
        "Date", "ID", "Sex", "Stim", "event_id", "RTime", "Blocks_trimmed", "block_row")


@query("trimmed_blocks_own_cap", statement(
    """SELECT Stim, ID, count(*) AS rows FROM no_first, caps
       WHERE Blocks_trimmed >= CASE Stim WHEN 'tone' THEN tone_cap ELSE bbn_cap END
       AND block_row <= CASE Stim WHEN 'tone' THEN tone_cap * 10 ELSE bbn_cap * 5 END GROUP BY ALL"""))
def trimmed_blocks_own_cap(spark, sf):
    """Trimmed trials per subject when noise is held to its own cap."""
    return blocks.trim_blocks(src.trials(spark, sf), ORDER, src.trial_slot(), PARAMS, cap_by_stim=True).groupBy(
        "Stim", "ID").agg(F.count("*").alias("rows"))


# Rates ----------------------------------------------------------------------------

def rated(spark, sf):
    return analysis(spark, sf).where(F.col("Condition") != "Recovery")


@query("daily_rates", statement("SELECT * FROM hits_by_day", ["HitRate", "FARate"], ["Date"]))
def daily(spark, sf):
    """Responses and rates per subject, day and setting."""
    return daily_rates(rated(spark, sf), HIT_KEYS)


@query("hit_summary", statement("SELECT * FROM hit_means", ["Trials", "Hit", "FA"]))
def hits(spark, sf):
    """Mean daily trials, hit rate and false-alarm rate per subject and setting."""
    return hit_summary(rated(spark, sf), HIT_KEYS)


@query("hit_summary_bbn", statement("SELECT * FROM hit_means WHERE Stim = 'BBN'", ["Trials", "Hit", "FA"]))
def hits_bbn(spark, sf):
    """The same for noise."""
    return hit_summary(rated(spark, sf).where(F.col("Stim") == "BBN"), HIT_KEYS)


@query("hit_summary_tone", statement("SELECT * FROM hit_means WHERE Stim = 'tone'", ["Trials", "Hit", "FA"]))
def hits_tone(spark, sf):
    """The same for tones."""
    return hit_summary(rated(spark, sf).where(F.col("Stim") == "tone"), HIT_KEYS)


_HIT_LONG = """(SELECT Stim, Condition, BG_Intensity, unnest(['Hit', 'FA']) AS variable, unnest([Hit, FA]) AS value FROM hit_means
  WHERE Condition NOT IN ('Recovery', 'Recovery 2')) t"""
_HIT_BY = ["Stim", "Condition", "variable", "BG_Intensity"]


def _hit_long(spark, sf):
    rows = hit_summary(rated(spark, sf), HIT_KEYS).where(~F.col("Condition").isin("Recovery", "Recovery 2"))
    return long(rows, HIT_KEYS, ["Hit", "FA"], "variable", "value")


@query("hit_box", statement(q.box(_HIT_LONG, _HIT_BY, "value"), BOX))
def hit_box(spark, sf):
    """Box summaries of hit and false-alarm rates."""
    return box(_hit_long(spark, sf), _HIT_BY, "value")


@query("rxn_box_outliers", statement(f"""
SELECT Condition, Stim, RTime, count(*) AS count FROM
 (SELECT *, quantile_cont(RTime, 0.25) OVER w AS lo, quantile_cont(RTime, 0.75) OVER w AS hi FROM trials WINDOW w AS (PARTITION BY Condition, Stim))
WHERE NOT RTime BETWEEN lo - 1.5 * (hi - lo) AND hi + 1.5 * (hi - lo) GROUP BY ALL""", ["RTime"]))
def rxn_box_outliers(spark, sf):
    """Reaction times a box plot draws singly."""
    return outliers(src.trials(spark, sf), ["Condition", "Stim"], "RTime", width=1.0)


@query("rxn_box", statement(q.box("trials", ["Condition", "Stim"], "RTime"), BOX))
def rxn_box(spark, sf):
    """Box summaries of all reaction times."""
    return box(src.trials(spark, sf), ["Condition", "Stim"], "RTime", width=1.0)


# Detection ------------------------------------------------------------------------

@query("response_table", statement("SELECT * FROM counts_analysis", ["Dur", "Freq", "Inten"]))
def response_table(spark, sf):
    """Responses per setting, frequency and level."""
    return sdt.response_table(analysis(spark, sf))


@query("go_with_nogo", statement(
    "SELECT * REPLACE (CAST(CR AS BIGINT) AS CR, CAST(FA AS BIGINT) AS FA) FROM go_analysis", ["Dur", "Freq", "Inten"]))
def go_with_nogo(spark, sf):
    """Go rows with their setting's no-go responses."""
    return sdt.attach_nogo(sdt.response_table(analysis(spark, sf)))


@query("dprime", statement("SELECT * FROM dprimes", INDICES))
def dprime(spark, sf):
    """d' and companions per subject, condition, stimulus and level."""
    return dprimes(spark, sf)


@query("dprime_all_trials", statement("SELECT * FROM dprimes_all", INDICES))
def dprime_all_trials(spark, sf):
    """The same over all trials, as the older rule has it."""
    return sdt.dprime_table(src.trials(spark, sf))


_CHANGE = """
SELECT ID, Sex, Type, BG_Type, BG_Intensity, Dur, dB, BG, unnest(['dprime_change', 'Baseline', 'Post HHL']) AS Condition,
  unnest([post - base, base, post]) AS dprime FROM dprime_pairs"""


@query("dprime_change", statement(_CHANGE, ["Dur", "dB", "dprime"]))
def dprime_change(spark, sf):
    """d' before and after hearing loss and its change."""
    return curves.dprime_change(dprimes(spark, sf))


# Thresholds -----------------------------------------------------------------------

@query("loess_fit", statement("SELECT * EXCLUDE (x, y), x AS dB, y AS dprime FROM curve_fitted", ["Dur", "dB", "dprime", "fitted"]))
def loess_fit(spark, sf):
    """d' curves smoothed by local regression."""
    return curves.local_fit(dprimes(spark, sf).select(*CURVE_KEYS, "dB", "dprime"), CURVE_KEYS, "dB", "dprime").select(
        *CURVE_KEYS, "dB", "dprime", "fitted")


@query("threshold_loess", statement("SELECT * FROM thresholds", ["Dur", "TH"]))
def threshold_loess(spark, sf):
    """Threshold of every curve."""
    return thresholds(spark, sf)


@query("threshold_table", statement("SELECT * FROM th_wide", ["Dur", *STIM_TYPES]))
def threshold_table(spark, sf):
    """Thresholds with one column per stimulus."""
    return curves.by_stimulus(thresholds(spark, sf))


@query("threshold_bracket", statement("SELECT * FROM bracket", ["Dur", "TH"]))
def threshold_bracket(spark, sf):
    """Thresholds from the two points nearest the cutoff."""
    return curves.bracket_thresholds(dprimes(spark, sf), PARAMS.th_cutoff)


@query("threshold_bracket_table", statement("SELECT * FROM bracket_wide", ["Dur", *STIM_TYPES]))
def threshold_bracket_table(spark, sf):
    """The same with one column per stimulus."""
    return curves.by_stimulus(curves.bracket_thresholds(dprimes(spark, sf), PARAMS.th_cutoff))


_AVG = lambda source, f: (f"SELECT Condition, BG_Type, BG_Intensity, " + ", ".join(
    f.format(c) + f' AS "{c}_avg"' for c in STIM_TYPES) + f" FROM {source} WHERE Condition IN ('Baseline', 'Post HHL') GROUP BY ALL")


@query("avg_threshold_condition", statement(
    _AVG("th_wide", 'CAST(round_even(avg("{}"), 0) AS DOUBLE)'), [f"{c}_avg" for c in STIM_TYPES]))
def avg_threshold_condition(spark, sf):
    """Mean thresholds per condition and background."""
    return curves.average_by_condition(curves.by_stimulus(thresholds(spark, sf)))


@query("avg_threshold_unrounded", statement(_AVG("bracket_wide", 'avg("{}")'), [f"{c}_avg" for c in STIM_TYPES]))
def avg_threshold_unrounded(spark, sf):
    """Mean bracket thresholds, not rounded, as the older rule has it."""
    return curves.average_by_condition(
        curves.by_stimulus(curves.bracket_thresholds(dprimes(spark, sf), PARAMS.th_cutoff)), digits=None)


@query("avg_threshold", statement("SELECT * FROM avg_th", ["TH"]))
def avg_threshold(spark, sf):
    """Mean thresholds per background in long form."""
    return curves.average_by_background(curves.by_stimulus(thresholds(spark, sf)))


@query("threshold_view", statement(
    "SELECT * FROM th_wide WHERE Dur <> 100 AND Condition = 'Baseline' AND BG_Intensity IN ('NA', '50')", ["Dur", *STIM_TYPES]))
def threshold_view(spark, sf):
    """Baseline thresholds, leaving out 100 ms."""
    return curves.by_stimulus(thresholds(spark, sf)).where(
        (F.col("Dur") != 100) & (F.col("Condition") == "Baseline") & F.col("BG_Intensity").isin("NA", "50"))


_STATS = ["mean", "sd", "median", "trimmed", "mad", "min", "max", "range", "skew", "kurtosis", "se"]


@query("threshold_describe", statement(q.describe("bracket", ["Condition", "Type"], "TH"), _STATS))
def threshold_describe(spark, sf):
    """Description of bracket thresholds per condition and stimulus."""
    return describe(curves.bracket_thresholds(dprimes(spark, sf), PARAMS.th_cutoff), ["Condition", "Type"], "TH", width=1.0)


# Reaction times -------------------------------------------------------------------

@query("over_threshold", statement("SELECT Date, event_id, ID, Condition, Freq, Inten, RTime FROM over_th", ["Freq", "Inten", "RTime"], ["Date"]))
def over(spark, sf):
    """Hits at or above threshold."""
    return over_threshold(spark, sf).select("Date", "event_id", "ID", "Condition", "Freq", "Inten", "RTime")


@query("rxn_describe", statement(q.describe("over_th", RXN_KEYS, "RTime"), ["Dur", "Freq", "Inten", *_STATS]))
def rxn_describe(spark, sf):
    """Full description of reaction times above threshold."""
    return reaction.describe_reaction(times_over_threshold(spark, sf), weight="n")


@query("rxn_change", statement(
    """SELECT *, 'Rxn_change' AS Condition, "Post HHL" - "Baseline" AS mean FROM rxn_pairs""",
    ["Dur", "Freq", "Inten", "Baseline", "Post HHL", "mean"]))
def rxn_change(spark, sf):
    """Change of mean reaction time after hearing loss."""
    return reaction.reaction_change(rxn_means(spark, sf))


_DAILY = """
SELECT ID, Condition, BG_Type, BG_Intensity, Dur, Freq, Inten, avg(mean) AS mean FROM
 (SELECT Date, ID, Condition, BG_Type, BG_Intensity, Stim, Dur, Freq, Inten, avg(RTime) AS mean FROM over_th GROUP BY ALL) GROUP BY ALL"""


@query("rxn_daily", statement(_DAILY, ["Dur", "Freq", "Inten", "mean"]))
def rxn_daily(spark, sf):
    """Mean of daily mean reaction times."""
    return reaction.daily_reaction(counted_over_threshold(spark, sf, extra=["Date"]))


@query("rxn_daily_vs_overall", statement(
    f"""SELECT r.*, d.mean AS mean_daily FROM rxn r LEFT JOIN ({_DAILY}) d USING (ID, Condition, BG_Type, BG_Intensity, Dur, Freq, Inten)""",
    ["Dur", "Freq", "Inten", "mean", "mean_daily"]))
def rxn_daily_vs_overall(spark, sf):
    """Both ways of averaging side by side."""
    return reaction.overall_and_daily(counted_over_threshold(spark, sf, extra=["Date"]))


@query("both_conditions", statement("""
SELECT ID, BG_Type, BG_Intensity, Stim, Dur, count(*) AS rows FROM analysis SEMI JOIN
 (SELECT ID, BG_Type, BG_Intensity, Stim, Dur FROM analysis WHERE Condition IN ('Baseline', 'Post HHL') GROUP BY ALL
  HAVING count(DISTINCT Condition) = 2) USING (ID, BG_Type, BG_Intensity, Stim, Dur) GROUP BY ALL""", ["Dur"]))
def both_conditions(spark, sf):
    """Trials of settings tested both before and after hearing loss."""
    keys = ["ID", "BG_Type", "BG_Intensity", "Stim", "Dur"]
    per = analysis(spark, sf).groupBy(*keys, "Condition").agg(F.count("*").alias("rows"))
    return in_every_condition(per, keys, ["Baseline", "Post HHL"]).groupBy(*keys).agg(F.sum("rows").alias("rows"))


# Tables behind graphs -------------------------------------------------------------

def _dropped(df, *conditions):
    return df.where((F.col("Inten") != -100) & ~F.col("Condition").isin(*conditions))


def _noise(df, kind="NA", level="NA"):
    return df.where((F.col("BG_Type") == kind) & (F.col("BG_Intensity") == level))


_QUIET = "Inten <> -100 AND BG_Type = 'NA' AND BG_Intensity = 'NA'"
_SHORT = "Condition NOT IN ('Recovery', 'Recovery 2', 'Post 2nd Exposure')"


@query("rxn_by_condition", statement(
    q.mean_se("rxn", ["Freq", "Inten", "Condition"], "mean", f"{_QUIET} AND {_SHORT}"), ["Freq", "Inten", *BAND]))
def rxn_by_condition(spark, sf):
    """Reaction time over level per condition, quiet."""
    rows = _noise(_dropped(rxn_means(spark, sf), "Recovery", "Recovery 2", "Post 2nd Exposure"))
    return mean_se(rows, ["Freq", "Inten", "Condition"], "mean")


@query("rxn_by_condition_older", statement(
    q.mean_se("rxn", ["Freq", "Inten", "Condition"], "mean",
              f"{_QUIET} AND Condition NOT IN ('Recovery 2', 'Post 2nd Exposure') AND Freq <> 0"), ["Freq", "Inten", *BAND]))
def rxn_by_condition_older(spark, sf):
    """The older version: recovery kept, noise left out."""
    rows = _noise(_dropped(rxn_means(spark, sf), "Recovery 2", "Post 2nd Exposure")).where(F.col("Freq") != 0)
    return mean_se(rows, ["Freq", "Inten", "Condition"], "mean")


@query("rxn_by_background", statement(
    q.mean_se("rxn", ["Condition", "Inten", "BG_Intensity"], "mean",
              "Inten <> -100 AND Condition NOT IN ('Recovery 2', 'Post 2nd Exposure') AND Freq = 32"), ["Inten", *BAND]))
def rxn_by_background(spark, sf):
    """Reaction time to 32 kHz per background level."""
    rows = _dropped(rxn_means(spark, sf), "Recovery 2", "Post 2nd Exposure").where(F.col("Freq") == 32)
    return mean_se(rows, ["Condition", "Inten", "BG_Intensity"], "mean")


@query("rxn_individuals", statement(
    f"SELECT ID, Condition, Freq, Inten, mean FROM rxn WHERE {_QUIET} AND {_SHORT} AND Freq <> 0", ["Freq", "Inten", "mean"]))
def rxn_individuals(spark, sf):
    """Reaction time of each subject."""
    rows = _noise(_dropped(rxn_means(spark, sf), "Recovery", "Recovery 2", "Post 2nd Exposure"))
    return rows.where(F.col("Freq") != 0).select("ID", "Condition", "Freq", "Inten", "mean")


@query("rxn_change_band", statement(
    q.mean_se("rxn_pairs", ["Freq", "Inten", "Sex", "BG_Intensity"], '("Post HHL" - "Baseline")', "Inten <> -100 AND Freq <> 0"),
    ["Freq", "Inten", *BAND]))
def rxn_change_band(spark, sf):
    """Change of reaction time per sex and background."""
    rows = reaction.reaction_change(rxn_means(spark, sf)).where((F.col("Inten") != -100) & (F.col("Freq") != 0))
    return mean_se(rows, ["Freq", "Inten", "Sex", "BG_Intensity"], "mean")


@query("dprime_change_band", statement(
    f"""SELECT b.*, t.TH FROM ({q.mean_se('dprime_pairs', ['BG', 'BG_Type', 'BG_Intensity', 'Type', 'dB'], '(post - base)', 'dB BETWEEN -1 AND 91')}) b
        LEFT JOIN avg_th t USING (Type, BG_Type, BG_Intensity)""", ["dB", "TH", *BAND]))
def dprime_change_band(spark, sf):
    """Change of d' per background with the average threshold."""
    from earshot.operators.joins import attach
    d = cut_lineage(dprimes(spark, sf))
    change = curves.dprime_change(d).where(F.col("Condition") == "dprime_change")
    band = mean_se(change, ["BG", "BG_Type", "BG_Intensity", "Type", "dB"], "dprime", (-1, 91), on="dB")
    avg = curves.average_by_background(curves.by_stimulus(curves.thresholds(d, PARAMS.th_cutoff)))
    return attach(band, avg, ["Type", "BG_Type", "BG_Intensity"])


@query("dprime_change_one_subject", statement(
    "SELECT BG, Type, dB, post - base AS dprime FROM dprime_pairs WHERE ID = 'Orange 1' AND dB BETWEEN -1 AND 91", ["dB", "dprime"]))
def dprime_change_one_subject(spark, sf):
    """One subject's change of d', drawn over the others."""
    return curves.dprime_change(dprimes(spark, sf)).where(
        (F.col("Condition") == "dprime_change") & (F.col("ID") == "Orange 1") & F.col("dB").between(-1, 91)
    ).select("BG", "Type", "dB", "dprime")


def _band(name, stim, by, dropped, extra=None, limits=None):
    """Register a mean d' table."""
    where = f"Stim = '{stim}' AND Condition NOT IN ({', '.join(repr(c) for c in dropped)})"
    where += f" AND {extra}" if extra else ""
    where += f" AND dB BETWEEN {limits[0]} AND {limits[1]}" if limits else ""

    @query(name, statement(q.mean_se("dprimes", by, "dprime", where), ["dB", *BAND]))
    def run(spark, sf):
        rows = dprimes(spark, sf).where((F.col("Stim") == stim) & ~F.col("Condition").isin(dropped))
        rows = rows.where(extra) if extra else rows
        return mean_se(rows, by, "dprime", limits, on="dB")


_band("dprime_bbn", "BBN", ["Type", "dB", "Condition"], ["Recovery 2"])
_band("dprime_bbn_older", "BBN", ["Type", "dB", "Condition"], ["Recovery 2", "Post 2nd Exposure"])
_band("dprime_bbn_by_sex", "BBN", ["Type", "dB", "Condition", "Sex"], ["Recovery 2", "Post 2nd Exposure"])
_band("dprime_tone_by_background", "tone", ["BG_Intensity", "dB", "Condition"], ["Recovery 2"])
_band("dprime_tone_by_background_older", "tone", ["BG_Intensity", "dB", "Condition"], ["Recovery 2", "Post 2nd Exposure"])
_band("dprime_tone_50dB", "tone", ["Type", "dB", "Condition"], ["Recovery 2", "Post 2nd Exposure"], "BG_Intensity = '50'", (20, 61))
_band("dprime_tone_by_sex", "tone", ["Type", "dB", "Condition", "Sex"], ["Recovery 2", "Post 2nd Exposure"])


@query("dprime_count_labels", statement(
    "SELECT Type, dB, Condition, avg(dprime) AS y, 'n = ' || count(*) AS label FROM dprimes WHERE Stim = 'BBN' GROUP BY ALL", ["dB", "y"]))
def dprime_count_labels(spark, sf):
    """Number of curves behind each mean."""
    return count_labels(dprimes(spark, sf).where(F.col("Stim") == "BBN"), ["Type", "dB", "Condition"], "dprime")


# Durations ------------------------------------------------------------------------

DURATION_LEVELS = [25.0, 30.0, 35.0, 40.0, 45.0, 50.0, 60.0, 70.0, 80.0]
DURATION_SUBJECTS = ["Green 1", "Green 3", "Orange 1", "Orange 2"]
_LEVELS = ", ".join(str(int(v)) for v in DURATION_LEVELS)
_FOUR = ", ".join(repr(s) for s in DURATION_SUBJECTS)


def duration_rows(spark, sf):
    return reaction.duration_means(no_first(spark, sf), sessions(spark, sf)).where(F.col("ID").isin(DURATION_SUBJECTS))


@query("duration_mixed_alone", statement(
    q.mean_se("duration_rows", ["Duration", "Dur", "Inten"], "Rxn", f"ID IN ({_FOUR}) AND Inten IN ({_LEVELS})"), ["Dur", "Inten", *BAND]))
def duration_mixed_alone(spark, sf):
    """Reaction time to noise by duration, mixed and alone."""
    return mean_se(duration_rows(spark, sf).where(F.col("Inten").isin(DURATION_LEVELS)), ["Duration", "Dur", "Inten"], "Rxn")


@query("duration_alone", statement(
    q.mean_se("duration_rows", ["Dur", "Inten"], "Rxn",
              f"ID IN ({_FOUR}) AND Duration = 'Alone' AND Inten IN ({_LEVELS}) AND Rxn BETWEEN 100 AND 450"), ["Dur", "Inten", *BAND]))
def duration_alone(spark, sf):
    """The same for sessions of one duration, within the drawn range."""
    rows = duration_rows(spark, sf).where((F.col("Duration") == "Alone") & F.col("Inten").isin(DURATION_LEVELS))
    return mean_se(rows, ["Dur", "Inten"], "Rxn", (100, 450))


@query("duration_anova_input", statement(
    f"""SELECT ID, Sex, Inten AS Intensity, Dur, Duration, Rxn FROM duration_rows WHERE Inten >= 30 AND Inten <= 80
        AND Inten NOT IN (25, 35, 45) AND ID IN ({_FOUR}) AND Duration = 'Alone'""", ["Intensity", "Dur", "Rxn"]))
def duration_anova_input(spark, sf):
    """Rows the duration tests are made on."""
    return duration_rows(spark, sf).where(
        F.col("Inten").between(30, 80) & ~F.col("Inten").isin(25, 35, 45) & (F.col("Duration") == "Alone")
    ).select("ID", "Sex", F.col("Inten").alias("Intensity"), "Dur", "Duration", "Rxn")
