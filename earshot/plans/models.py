"""Tests and models: analysis of variance, normality, rank tests, Tukey, coefficients."""

from __future__ import annotations

from pyspark.sql import functions as F

from earshot.functions.labels import stars
from earshot.operators import linear, ranktests
from earshot.operators.gaussian import fit_heavy_tail, gaussianize
from earshot.operators.linear import Design, coefficients, crossed, residuals, tukey
from earshot.operators.ranktests import kruskal
from earshot.params import ABR_CONDITIONS, BACKGROUNDS, CONDITIONS
from earshot.plans import abr, hearing
from earshot.plans import sql as q
from earshot.plans.registry import query
from earshot.plans.sql import CTES, f_upper, orthogonal, statement
from earshot.session import cut_lineage

FIT = ["sum_sq", "mean_sq", "f", "p"]
TUKEY = ["estimate", "lower", "upper", "p"]
RATE_TERMS = crossed("Condition", "BG_Intensity")
RATE_LEVELS = {"Condition": CONDITIONS, "BG_Intensity": BACKGROUNDS}


def anova(rows, y, terms, levels):
    """Analysis of variance as the SQL lists it: the residual line stays where no row takes part."""
    found = linear.anova(rows, y, terms, levels)
    values = [c for c in found.columns if c not in ("position", "term")]
    line = rows.sparkSession.range(1).select(
        F.lit(len(terms) + 1).alias("position"), F.lit("Residuals").alias("term"), F.lit(0).cast("long").alias("df"))
    both = found.unionByName(line, allowMissingColumns=True)  # the line has no values, so those found win
    return both.groupBy("position", "term").agg(*[F.max(c).alias(c) for c in values])


def shapiro(rows, value):
    """Normality as the SQL lists it: without a value there is no sample, nor its size."""
    return ranktests.shapiro(rows, value).withColumn("n", F.when(F.col("n") > 0, F.col("n")))


CTES["hit_means_tone"] = "SELECT * FROM hit_means WHERE Stim = 'tone'"


# Rates ----------------------------------------------------------------------------

def _rate(measure: str) -> None:
    name = measure.lower()
    model = f"model_{name}"
    orthogonal(model, "hit_means_tone", measure, RATE_TERMS, RATE_LEVELS)

    @query(f"anova_{name}", statement(q.anova(model), FIT))
    def table(spark, sf):
        return anova(hearing.hits_tone(spark, sf), measure, RATE_TERMS, RATE_LEVELS)

    @query(f"shapiro_{name}", statement(q.shapiro(f"{model}_done", "y"), ["W", "p"]))
    def normal(spark, sf):
        rows = cut_lineage(hearing.hits_tone(spark, sf))
        return shapiro(residuals(rows, measure, RATE_TERMS, RATE_LEVELS), "residual")


for _measure in ("Trials", "Hit", "FA"):
    _rate(_measure)


def _kruskal(name: str, group: str, background: str | None = None) -> None:
    source = "hit_means_tone" if background is None else f"(SELECT * FROM hit_means_tone WHERE BG_Intensity = '{background}') t"

    @query(name, statement(q.kruskal(source, "Hit", group), ["h", "p"]))
    def run(spark, sf):
        rows = hearing.hits_tone(spark, sf)
        rows = rows if background is None else rows.where(F.col("BG_Intensity") == background)
        return kruskal(rows, "Hit", group)


_kruskal("kruskal_background", "BG_Intensity")
_kruskal("kruskal_condition", "Condition")
_kruskal("kruskal_condition_quiet", "Condition", "NA")
_kruskal("kruskal_condition_50dB", "Condition", "50")


@query("kruskal_rxn_all_trials", statement(q.kruskal(
    "(SELECT RTime, CASE WHEN Condition IN ('Baseline', 'Post HHL') THEN Condition ELSE 'Other' END AS Phase FROM trials) t",
    "RTime", "Phase"), ["h", "p"]))
def kruskal_rxn_all_trials(spark, sf):
    """Do reaction times of all trials differ before, after and around hearing loss?"""
    phase = F.when(F.col("Condition").isin("Baseline", "Post HHL"), F.col("Condition")).otherwise("Other")
    rows = hearing.src.trials(spark, sf).withColumn("Phase", phase)
    return kruskal(rows, "RTime", "Phase", width=1.0)


def _spread(df: str) -> str:
    return f"(1 + 10 / sqrt(2.0::DOUBLE * {df}) * (j - 100) / 100.0)"


def _tail_sum(q_value: str, k: str, df: str) -> str:
    """P(studentized range > q) as a sum over rows of a grid (i, j) (trapezoid rule)."""
    z = "(i / 20.0::DOUBLE)"
    phi = lambda x: f"(1 - ({q.normal_upper(x)}))"
    s = _spread(df)
    density = (f"exp(ln(2) + {df} / 2.0 * ln({df} / 2.0) - lgamma({df} / 2.0) + ({df} - 1) * ln({s}) - {df} / 2.0 * {s} * {s})")
    inner = f"exp(-{z} * {z} / 2) / sqrt(2 * pi()) * greatest({phi(z)} - {phi(f'({z} - {q_value} * {s})')}, 0) ** ({k} - 1) / 20.0"
    return f"1 - {k} * sum({density} * {inner}) * 10 / sqrt(2.0::DOUBLE * {df}) / 100.0"


def _range_tail(q_value: str, k: str, df: str) -> str:
    """The same as a subquery."""
    return f"(SELECT {_tail_sum(q_value, k, df)} FROM range(-160, 161) a(i), range(0, 201) b(j) WHERE {_spread(df)} > 0)"


def _tukey_sql(model: str, factor: str, source: str, levels: list[str], ordered: bool) -> str:
    """Differences of raw level means; right where the factor is the model's first term."""
    owners, _ = q._MODELS[model]
    used = " + ".join(f"CASE WHEN any_value(ss{j}) IS NULL THEN 0 ELSE 1 END" for j in range(len(owners)))
    before = "a.place <> b.place AND a.m < b.m" if ordered else "a.place < b.place"
    return f"""
SELECT '{factor}' AS term, b.level || '-' || a.level AS contrast, b.m - a.m AS estimate,
  {_range_tail('(abs(b.m - a.m) / sqrt(rss / rdf / 2 * (1.0 / a.n + 1.0 / b.n)))', 'k', 'rdf')} AS p
FROM (SELECT "{factor}" AS level, {q.level_case(f'"{factor}"', levels)} AS place, avg("{source}") AS m, count(*) AS n FROM {model}_done GROUP BY ALL) a,
  (SELECT "{factor}" AS level, {q.level_case(f'"{factor}"', levels)} AS place, avg("{source}") AS m, count(*) AS n FROM {model}_done GROUP BY ALL) b,
  (SELECT sum(y * y) AS rss, count(*) - ({used}) AS rdf, count(DISTINCT "{factor}") AS k FROM {model}_done)
WHERE {before}"""


def _tukey_intervals(model: str, factor: str, source: str, levels: list[str], ordered: bool) -> str:
    """Differences of any term's level means with 95% intervals.

    A level's mean is the grand mean and the part of the fit that the term's own columns add,
    averaged over the level's rows; the quantile of the range comes from halving an interval.
    """
    owners, terms = q._MODELS[model]
    own = [j for j, o in enumerate(owners) if o == terms.index((factor,))]
    used = " + ".join(f"CASE WHEN any_value(ss{j}) IS NULL THEN 0 ELSE 1 END" for j in range(len(owners)))
    name = f"{model}_{factor.lower()}"
    CTES[f"{name}_left"] = f'SELECT sum(y * y) AS rss, count(*) - ({used}) AS rdf, count(DISTINCT "{factor}") AS k FROM {model}_done'
    shares = ", ".join(f'CASE WHEN any_value(ss{j}) IS NOT NULL THEN sum("{source}" * x{j}) / sum(x{j} * x{j}) ELSE 0 END AS c{j}' for j in own)
    CTES[f"{name}_means"] = f"""
SELECT "{factor}" AS level, {q.level_case(f'"{factor}"', levels)} AS place, count(*) AS n,
  any_value(g) + {' + '.join(f'any_value(c{j}) * avg(x{j})' for j in own)} AS m
FROM {model}_done, (SELECT avg("{source}") AS g, {shares} FROM {model}_done) GROUP BY ALL"""
    s = _spread("rdf")
    CTES[f"{name}_halves"] = f"""
SELECT 0 AS step, 0.0::DOUBLE AS low, 60.0::DOUBLE AS high, k, rdf FROM {name}_left
UNION ALL SELECT step + 1, CASE WHEN tail > 0.05 THEN (low + high) / 2 ELSE low END, CASE WHEN tail > 0.05 THEN high ELSE (low + high) / 2 END, k, rdf
FROM (SELECT step, low, high, k, rdf, {_tail_sum('((low + high) / 2)', 'k', 'rdf')} AS tail
      FROM {name}_halves, range(-160, 161) a(i), range(0, 201) b(j) WHERE step < 45 AND {s} > 0 GROUP BY step, low, high, k, rdf)"""
    before = "a.place <> b.place AND a.m < b.m" if ordered else "a.place < b.place"
    return f"""
SELECT term, contrast, estimate, estimate - reach * se AS lower, estimate + reach * se AS upper, {_range_tail('(abs(estimate) / se)', 'k', 'rdf')} AS p
FROM (SELECT '{factor}' AS term, b.level || '-' || a.level AS contrast, b.m - a.m AS estimate, sqrt(rss / rdf / 2 * (1.0 / a.n + 1.0 / b.n)) AS se,
        k, rdf, (SELECT (low + high) / 2 FROM {name}_halves WHERE step = 45) AS reach
      FROM {name}_means a, {name}_means b, {name}_left WHERE {before})"""


@query("tukey_fa_condition", statement(
    _tukey_sql("model_fa", "Condition", "FA", CONDITIONS, False), ["estimate", "p"]), digits=6)
def tukey_fa_condition(spark, sf):
    """Differences of false-alarm rate between conditions."""
    return tukey(hearing.hits_tone(spark, sf), "FA", RATE_TERMS, RATE_LEVELS, "Condition").drop("lower", "upper")


@query("tukey_fa_background", statement(
    _tukey_intervals("model_fa", "BG_Intensity", "FA", BACKGROUNDS, False), ["estimate", "lower", "upper", "p"], digits=4), digits=4)
def tukey_fa_background(spark, sf):
    """Differences of false-alarm rate between backgrounds, with intervals."""
    return tukey(hearing.hits_tone(spark, sf), "FA", RATE_TERMS, RATE_LEVELS, "BG_Intensity")


# Reaction times -------------------------------------------------------------------

RXN_TERMS = crossed("Condition", "Freq", "Inten", "BG_Intensity")
RXN_LEVELS = {"Condition": CONDITIONS, "BG_Intensity": BACKGROUNDS}
orthogonal("model_rxn", "rxn", "mean", RXN_TERMS, RXN_LEVELS)


@query("anova_rxn", statement(q.anova("model_rxn"), FIT, digits=4), digits=4)
def anova_rxn(spark, sf):
    """Reaction time by condition, frequency, level and background."""
    return anova(hearing.rxn_means(spark, sf), "mean", RXN_TERMS, RXN_LEVELS)


@query("shapiro_rxn", statement(q.shapiro("model_rxn_done", "y"), ["W", "p"]))
def shapiro_rxn(spark, sf):
    """Are what that model leaves normal?"""
    return shapiro(residuals(cut_lineage(hearing.rxn_means(spark, sf)), "mean", RXN_TERMS, RXN_LEVELS), "residual")


BEFORE_AFTER = ["Baseline", "Post HHL"]
LM_KEYS = ["ID", "BG_Type", "BG_Intensity", "Stim", "Dur"]


def _model_rows(spark, sf, stim: str):
    rows = hearing.analysis(spark, sf).where(
        (F.col("Type") == 1) & (F.col("Response") == "Hit") & F.col("Condition").isin(BEFORE_AFTER))
    return rows.where(F.col("Stim") == "BBN") if stim == "BBN" else rows.where(F.col("Stim") != "BBN")


CTES["rxn_hits"] = """
SELECT * FROM analysis WHERE Type = 1 AND Response = 'Hit' AND Condition IN ('Baseline', 'Post HHL')"""


def _model_sql(name: str, stim: str, numbers: list[str]) -> str:
    terms, levels = crossed("Condition", *numbers), {"Condition": BEFORE_AFTER}
    design = Design(terms, levels)
    names = [design.name(j).replace("ConditionPost", "Post") for j in range(len(design))]
    return q.coefficients(name, f"(SELECT * FROM rxn_hits WHERE {stim}) t", "RTime", terms, levels, LM_KEYS, names)


@query("rxn_model_by_subject", statement(
    f"""{_model_sql('lm_noise', "Stim = 'BBN'", ['Inten'])} UNION ALL {_model_sql('lm_tone', "Stim <> 'BBN'", ['Inten', 'Freq'])}""",
    ["Dur", "estimate", "std_error", "t", "p"], digits=4), digits=4)
def rxn_model_by_subject(spark, sf):
    """Reaction time by condition and level (and frequency, for tones), one model per setting."""
    levels = {"Condition": BEFORE_AFTER}
    noise = coefficients(_model_rows(spark, sf, "BBN"), "RTime", crossed("Condition", "Inten"), levels, LM_KEYS)
    tones = coefficients(_model_rows(spark, sf, "tone"), "RTime", crossed("Condition", "Inten", "Freq"), levels, LM_KEYS)
    return noise.unionByName(tones).withColumn("coefficient", F.regexp_replace("coefficient", "ConditionPost", "Post"))


CTES["rxn_hits_bbn"] = """
SELECT * FROM analysis WHERE Type = 1 AND Response = 'Hit' AND Stim = 'BBN' AND Condition IN ('Baseline', 'Post HHL')"""
CTES["rxn_slopes"] = """
SELECT ID, BG_Type, BG_Intensity, Stim, Dur, Condition, regr_slope(RTime, Inten) AS slope, regr_intercept(RTime, Inten) AS base,
  count(*) AS n, regr_sxx(RTime, Inten) AS sxx, avg(Inten) AS mx, regr_syy(RTime, Inten) - regr_sxy(RTime, Inten) ** 2 / regr_sxx(RTime, Inten) AS rss
FROM rxn_hits_bbn GROUP BY ALL"""


@query("rxn_model_noise", statement("""
SELECT ID, BG_Type, BG_Intensity, Stim, Dur, coefficient, estimate, std_error, estimate / std_error AS t FROM
 (SELECT a.ID, a.BG_Type, a.BG_Intensity, a.Stim, a.Dur,
    unnest(['(Intercept)', 'Post HHL', 'Inten', 'Post HHL:Inten']) AS coefficient,
    unnest([a.base, b.base - a.base, a.slope, b.slope - a.slope]) AS estimate,
    unnest([sqrt(s * (1.0 / a.n + a.mx ** 2 / a.sxx)), sqrt(s * (1.0 / a.n + a.mx ** 2 / a.sxx + 1.0 / b.n + b.mx ** 2 / b.sxx)),
            sqrt(s / a.sxx), sqrt(s * (1.0 / a.sxx + 1.0 / b.sxx))]) AS std_error
  FROM (SELECT a.*, (a.rss + b.rss) / (a.n + b.n - 4) AS s FROM rxn_slopes a JOIN rxn_slopes b USING (ID, BG_Type, BG_Intensity, Stim, Dur)
        WHERE a.Condition = 'Baseline' AND b.Condition = 'Post HHL') a
  JOIN rxn_slopes b USING (ID, BG_Type, BG_Intensity, Stim, Dur) WHERE b.Condition = 'Post HHL')""",
    ["Dur", "estimate", "std_error", "t"], digits=5), digits=5)
def rxn_model_noise(spark, sf):
    """The noise models alone: two lines per setting and their difference."""
    from earshot.operators.reshape import in_every_condition
    rows = in_every_condition(_model_rows(spark, sf, "BBN"), LM_KEYS, BEFORE_AFTER)
    return (
        coefficients(rows, "RTime", crossed("Condition", "Inten"), {"Condition": BEFORE_AFTER}, LM_KEYS)
        .withColumn("coefficient", F.regexp_replace("coefficient", "ConditionPost", "Post")).drop("position", "p")
    )


# Durations ------------------------------------------------------------------------

DURATION_TERMS = crossed("Intensity", "Dur")
DURATION_LEVELS = {"Dur": ["50", "100", "300"]}


CTES["duration_alone_rows"] = f"""
SELECT Inten AS Intensity, CAST(CAST(Dur AS INTEGER) AS VARCHAR) AS Dur, Rxn FROM duration_rows WHERE Inten >= 30 AND Inten <= 80
  AND Inten NOT IN (25, 35, 45) AND ID IN ({hearing._FOUR}) AND Duration = 'Alone'"""
q.heavy_tail("duration_drawn", "duration_alone_rows", "Rxn")
orthogonal("model_duration", "duration_drawn", "Rxn", DURATION_TERMS, DURATION_LEVELS)


def _duration(spark, sf):
    return hearing.duration_anova_input(spark, sf).withColumn("Dur", F.col("Dur").cast("int").cast("string"))


@query("anova_duration", statement(q.anova("model_duration"), FIT, digits=4), digits=4)
def anova_duration(spark, sf):
    """Gaussianised reaction time to noise by level and duration."""
    return anova(gaussianize(_duration(spark, sf), "Rxn"), "Rxn", DURATION_TERMS, DURATION_LEVELS)


@query("shapiro_duration", statement(q.shapiro("model_duration_done", "y"), ["W", "p"]))
def shapiro_duration(spark, sf):
    """Are what that model leaves normal?"""
    rows = cut_lineage(gaussianize(_duration(spark, sf), "Rxn"))
    return shapiro(residuals(rows, "Rxn", DURATION_TERMS, DURATION_LEVELS), "residual")


@query("tukey_duration", statement(
    f"""SELECT *, {q.stars('p')} AS sig FROM ({_tukey_intervals('model_duration', 'Dur', 'Rxn', DURATION_LEVELS['Dur'], False)})""",
    ["estimate", "lower", "upper", "p"], digits=4), digits=4)
def tukey_duration(spark, sf):
    """Differences between durations, with stars."""
    rows = gaussianize(_duration(spark, sf), "Rxn")
    return tukey(rows, "Rxn", DURATION_TERMS, DURATION_LEVELS, "Dur").withColumn("sig", stars(F.col("p")))


# Evoked responses -----------------------------------------------------------------

ABR_TERMS = crossed("Condition", "Inten", "Freq")
FREQ_LEVELS = ["16", "32", "4", "8", "BBN"]
ABR_LEVELS = {"Condition": ABR_CONDITIONS, "Freq": FREQ_LEVELS}


def _abr_cells(spark, sf, measure: str):
    rows = cut_lineage(abr.abr_cell_means(spark, sf).where(F.col(measure).isNotNull()))
    return gaussianize(rows, measure)


def _amplitude(measure: str) -> None:
    """Register the tests of one amplitude."""
    model, drawn = f"model_abr_{measure.lower()}", f"abr_drawn_{measure.lower()}"
    q.heavy_tail(drawn, "abr_cells", measure)
    orthogonal(model, drawn, measure, ABR_TERMS, ABR_LEVELS)

    @query(f"abr_anova_{measure.lower()}", statement(q.anova(model), FIT, digits=5), digits=5)
    def table(spark, sf):
        return anova(_abr_cells(spark, sf, measure), measure, ABR_TERMS, ABR_LEVELS)

    @query(f"abr_shapiro_{measure.lower()}", statement(
        f"SELECT *, p > 0.05 AS is_parametric FROM ({q.shapiro(f'{model}_done', 'y')})", ["W", "p"]))
    def normal(spark, sf):
        left = residuals(cut_lineage(_abr_cells(spark, sf, measure)), measure, ABR_TERMS, ABR_LEVELS)
        return shapiro(left, "residual").withColumn("is_parametric", F.col("p") > 0.05)

    @query(f"abr_tukey_{measure.lower()}_condition", statement(
        f"""SELECT term, contrast, estimate, CAST(round_even(p, 4) AS DOUBLE) AS p, {q.stars('round_even(p, 4)')} AS sig
            FROM ({_tukey_sql(model, 'Condition', measure, ABR_CONDITIONS, True)})""", ["estimate", "p"]))
    def differences(spark, sf):
        rows = _abr_cells(spark, sf, measure)
        return (
            tukey(rows, measure, ABR_TERMS, ABR_LEVELS, "Condition", ordered=True).drop("lower", "upper")
            .withColumn("p", F.bround("p", 4)).withColumn("sig", stars(F.col("p")))
        )


_amplitude("RMS")
_amplitude("W1")


@query("abr_tukey_w1_frequency", statement(
    f"""SELECT *, {q.stars('p')} AS sig FROM ({_tukey_intervals('model_abr_w1', 'Freq', 'W1', FREQ_LEVELS, True)})""",
    ["estimate", "lower", "upper", "p"], digits=4), digits=4)
def abr_tukey_w1_frequency(spark, sf):
    """Wave-1 differences between frequencies, with intervals and stars."""
    rows = _abr_cells(spark, sf, "W1")
    return tukey(rows, "W1", ABR_TERMS, ABR_LEVELS, "Freq", ordered=True).withColumn("sig", stars(F.col("p")))


TH_TERMS = crossed("Condition", "Freq")
orthogonal("model_abr_th", "abr_th_rows", "TH", TH_TERMS, ABR_LEVELS)


def _wave_thresholds(spark, sf):
    return gaussianize(abr.threshold_rows(spark, sf), "TH")


@query("abr_anova_threshold", statement(q.anova("model_abr_th"), FIT, digits=4), digits=4)
def abr_anova_threshold(spark, sf):
    """Wave threshold by condition and frequency."""
    return anova(_wave_thresholds(spark, sf), "TH", TH_TERMS, ABR_LEVELS)


@query("abr_shapiro_threshold", statement(q.shapiro("model_abr_th_done", "y"), ["W", "p"]))
def abr_shapiro_threshold(spark, sf):
    """Are the threshold model's residuals normal?"""
    return shapiro(residuals(_wave_thresholds(spark, sf), "TH", TH_TERMS, ABR_LEVELS), "residual")


@query("abr_tukey_threshold", statement(
    f"""SELECT term, contrast, estimate, CAST(round_even(p, 4) AS DOUBLE) AS p, {q.stars('round_even(p, 4)')} AS sig
        FROM ({_tukey_sql('model_abr_th', 'Condition', 'TH', ABR_CONDITIONS, True)})""", ["estimate", "p"]))
def abr_tukey_threshold(spark, sf):
    """Wave-threshold differences between conditions."""
    return (
        tukey(_wave_thresholds(spark, sf), "TH", TH_TERMS, ABR_LEVELS, "Condition", ordered=True).drop("lower", "upper")
        .withColumn("p", F.bround("p", 4)).withColumn("sig", stars(F.col("p")))
    )


CTES["loudest_trials"] = "SELECT * FROM trials WHERE Inten = 90"
q.heavy_tail("loudest_drawn", "loudest_trials", "RTime")


@query("gaussianized_trial_values", statement(
    """SELECT Condition, count(u) AS n, avg(u) AS mean, var_samp(u) AS variance, avg(u ** 4) AS fourth, min(u) AS least, max(u) AS most,
         any_value(mu) AS mu, any_value(sigma) AS sigma, any_value(delta) AS delta
       FROM (SELECT Condition, (RTime - mu) / sigma AS u, mu, sigma, delta FROM loudest_drawn, loudest_drawn_at)
       GROUP BY GROUPING SETS ((Condition), ())""",
    ["mean", "variance", "fourth", "least", "most", "mu", "sigma", "delta"], digits=5), digits=5)
def gaussianized_trial_values(spark, sf):
    """Reaction times at the loudest level as scores without heavy tails: their moments per condition and over all, and the fit."""
    rows = hearing.src.trials(spark, sf).where(F.col("Inten") == 90)
    tail = fit_heavy_tail(rows, "RTime")
    u = F.col("u")
    moments = [
        F.count(u).alias("n"), F.mean(u).alias("mean"), F.var_samp(u).alias("variance"), F.mean(u * u * u * u).alias("fourth"),
        F.min(u).alias("least"), F.max(u).alias("most"),
    ]
    fitted = [F.lit(v).alias(c) for c, v in (("mu", tail.mu), ("sigma", tail.sigma), ("delta", tail.delta))]
    scored = rows.select("Condition", tail.score(F.col("RTime").cast("double")).alias("u"))
    return scored.rollup("Condition").agg(*moments).select("*", *fitted)
