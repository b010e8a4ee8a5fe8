"""Group summaries: counts, means, standard errors, full description, box plots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.labels import known
from earshot.operators.joins import attach, group_of
from earshot.operators.ranks import cumulative, histogram, is_small, quantile_from
from earshot.operators.reshape import long, wide
from earshot.session import cut_lineage


def strict_mean(value: str) -> Column:
    """Mean that is NULL as soon as one value is."""
    return F.when(F.count(value) == F.count("*"), F.avg(value))


def distinct_count(value: str) -> Column:
    """Distinct values, NULL counted as one of them."""
    return F.count_distinct(F.col(value)) + F.max(F.when(F.col(value).isNull(), 1).otherwise(0))


def distinct_values(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """One row per group and distinct value, NULL written NA."""
    return df.select(*by, F.coalesce(F.col(value).cast("string"), F.lit("NA")).alias(value)).distinct()


def distinct_text(value: str) -> Column:
    """Distinct values as sorted text, NULL written NA; for groups of few values (``distinct_values`` for any)."""
    return F.array_join(F.array_sort(F.collect_set(F.coalesce(F.col(value), F.lit("NA")))), ", ")


TH_COLUMNS = ["BBN_TH", "4_TH", "8_TH", "16_TH", "32_TH"]
LOGGED_KEYS = ["ID", "Condition", "BG_Type", "BG_Intensity", "Duration"]


def logged_thresholds(sessions: DataFrame, keys: list[str] = LOGGED_KEYS, columns: list[str] = TH_COLUMNS) -> DataFrame:
    """The logged threshold columns described per subject and setting, whole numbers, one row per type.

    All columns are described in one pass over their long form. Types without a value have no
    row, nor has noise (BBN) in a background of 30 or 50 dB.
    """
    listed = long(sessions.select(*keys, *[F.col(c).cast("double").alias(c) for c in columns]), keys, columns, "Type", "TH")
    listed = listed.withColumn("Type", F.regexp_replace("Type", "_TH$", "")).where(
        ~known((F.col("Type") == "BBN") & F.col("BG_Intensity").isin("30", "50")))
    found = describe(listed.where(F.col("TH").isNotNull()), [*keys, "Type"], "TH")
    return found.select(*keys, "Type", "n", *[F.bround(c, 0).alias(c) for c in ("mean", "median", "min", "max")])


def logged_thresholds_wide(sessions: DataFrame, keys: list[str] = LOGGED_KEYS, columns: list[str] = TH_COLUMNS) -> DataFrame:
    """Mean logged thresholds with one column per type."""
    return wide(logged_thresholds(sessions, keys, columns), keys, "Type", "mean", [c.removesuffix("_TH") for c in columns])


def standard_error(value: str) -> Column:
    """Sample standard deviation over the root of the count; NULL below two values."""
    return F.sqrt(F.var_samp(value) / F.count(value))


def weighted_mean(value: Column, weight: Column) -> Column:
    return F.try_divide(F.sum(value * weight), F.sum(F.when(value.isNotNull(), weight)))


def mean_se(df: DataFrame, by: list[str], value: str, limits: tuple | None = None, on: str | None = None) -> DataFrame:
    """Count, mean, standard error and the band around the mean.

    ``limits`` keeps rows whose ``on`` (the value itself by default) lies inside
    before anything is averaged. NULL values are left out.
    """
    if limits:
        df = df.where(F.col(on or value).between(*limits))
    return (
        df.groupBy(*by).agg(
            F.count(value).alias("n"), F.avg(value).alias("mean"), standard_error(value).alias("se"),
        )
        .where(F.col("n") > 0)
        .withColumns({
            "lower": F.col("mean") - F.col("se"), "upper": F.col("mean") + F.col("se"),
        })
    )


def count_labels(df: DataFrame, by: list[str], value: str) -> DataFrame:
    """``n = <count>`` and the height it is written at."""
    return df.groupBy(*by).agg(
        F.avg(value).alias("y"), F.concat(F.lit("n = "), F.count("*").cast("string")).alias("label"),
    )


def describe(
    df: DataFrame, by: list[str], value: str, width: float | None = None, trim: float = 0.1, weight: str | None = None,
) -> DataFrame:
    """n, mean, sd, median, trimmed mean, MAD, min, max, range, skew, kurtosis and se per group.

    The rows are reduced to (group, value, count) and every later step works on
    that. Moments are taken around the mean, MAD from the distances to the median.
    """
    hist = histogram(df, by, value, weight=weight)
    two_steps = _describe_small if is_small(hist) else _describe_large
    n, sd = F.col("n"), F.col("sd")
    return (
        two_steps(hist, by, value, width, trim)
        .withColumn("sd", F.when(n > 1, F.sqrt(F.col("_m2") / (n - 1))))
        .withColumns({
            "range": F.col("max") - F.col("min"),
            "skew": F.try_divide(F.col("_m3"), n * F.pow(sd, F.lit(3))),
            "kurtosis": F.try_divide(F.col("_m4"), n * F.pow(sd, F.lit(4))) - 3,
            "se": sd / F.sqrt(n),
        })
        .select(*by, "n", "mean", "sd", "median", "trimmed", "mad", "min", "max", "range", "skew", "kurtosis", "se")
    )


MAD_SCALE = 1.4826


def _kept(trim: float) -> Column:
    """How many of an entry's rows the trimmed mean keeps."""
    cut = F.floor(F.col("total") * F.lit(trim))
    return F.greatest(
        F.least(F.col("before") + F.col("t"), F.col("total") - cut) - F.greatest(F.col("before"), cut), F.lit(0)
    )


def _moments(value: str) -> list[Column]:
    d = F.col(value) - F.col("mean")
    return [F.sum(F.col("t") * F.pow(d, F.lit(k))).alias(f"_m{k}") for k in (2, 3, 4)]


def _describe_small(hist: DataFrame, by: list[str], value: str, width: float | None, trim: float) -> DataFrame:
    """Every group fits one task: windows and one aggregate on the same partitioning."""
    group = Window.partitionBy("_g")
    upto = group.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t, v = F.col("t"), F.col(value)
    return (
        hist.withColumn("_g", group_of(by))
        .withColumns({
            "before": F.sum("t").over(upto) - t, "total": F.sum("t").over(group),
            "mean": F.sum(t * v).over(group) / F.sum("t").over(group),
            "median": F.percentile(value, F.lit(0.5), t).over(group),
        })
        .withColumns({"_kept": _kept(trim), "_a": F.abs(v - F.col("median"))})
        .groupBy("_g").agg(
            *[F.first(k).alias(k) for k in by],
            F.first("total").alias("n"), F.first("mean").alias("mean"), F.first("median").alias("median"),
            (F.sum(F.col("_kept") * v) / F.sum("_kept")).alias("trimmed"),
            F.min(value).alias("min"), F.max(value).alias("max"),
            (F.lit(MAD_SCALE) * F.percentile("_a", F.lit(0.5), t)).alias("mad"), *_moments(value),
        )
        .drop("_g")
    )


def _describe_large(hist: DataFrame, by: list[str], value: str, width: float | None, trim: float) -> DataFrame:
    """Any size: places in the order from slots, and only sums and extremes per group."""
    cum = cumulative(hist, by, value, width=width)
    kept = _kept(trim)
    first = cut_lineage(cum.groupBy(*by).agg(
        F.max("total").alias("n"),
        (F.sum(F.col("t") * F.col(value)) / F.sum("t")).alias("mean"),
        quantile_from(0.5, value).alias("median"),
        (F.sum(kept * F.col(value)) / F.sum(kept)).alias("trimmed"),
        F.min(value).alias("min"), F.max(value).alias("max"),
    ))
    around = attach(hist, first.select(*by, "mean", "median"), by)
    distances = histogram(around.withColumn("_a", F.abs(F.col(value) - F.col("median"))), by, "_a", weight="t")
    mad = cumulative(distances, by, "_a", width=width).groupBy(*by).agg(
        (F.lit(MAD_SCALE) * quantile_from(0.5, "_a")).alias("mad")
    )
    return attach(attach(first, around.groupBy(*by).agg(*_moments(value)), by), mad, by)


def box(df: DataFrame, by: list[str], value: str, width: float | None = None) -> DataFrame:
    """Quartiles, whiskers (last value within 1.5 box heights) and number of outliers."""
    return _box(histogram(df, by, value), by, value, width)


def _box(hist: DataFrame, by: list[str], value: str, width: float | None) -> DataFrame:
    t, v = F.col("t"), F.col(value)
    reach = 1.5 * (F.col("upper") - F.col("lower"))
    inside = v.between(F.col("lower") - reach, F.col("upper") + reach)
    whiskers = [
        F.min(F.when(inside, v)).alias("ymin"), F.max(F.when(inside, v)).alias("ymax"),
        F.sum(F.when(inside, 0).otherwise(t)).alias("outliers"),
    ]
    if is_small(hist):
        group = Window.partitionBy("_g")
        at = lambda p: F.percentile(value, F.lit(p), t).over(group)
        return (
            hist.withColumn("_g", group_of(by))
            .withColumns({"n": F.sum("t").over(group), "lower": at(0.25), "middle": at(0.5), "upper": at(0.75)})
            .groupBy("_g").agg(*[F.first(c).alias(c) for c in [*by, "n", "lower", "middle", "upper"]], *whiskers).drop("_g")
        )
    cum = cut_lineage(cumulative(hist, by, value, width=width))
    quartiles = cum.groupBy(*by).agg(
        F.max("total").alias("n"), quantile_from(0.25, value).alias("lower"),
        quantile_from(0.5, value).alias("middle"), quantile_from(0.75, value).alias("upper"),
    )
    return attach(quartiles, attach(cum.select(*by, value, "t"), quartiles, by).groupBy(*by).agg(*whiskers), by)


def outliers(df: DataFrame, by: list[str], value: str, width: float | None = None) -> DataFrame:
    """The points a box plot draws one by one, with how often each occurs."""
    hist = histogram(df, by, value)
    reach = 1.5 * (F.col("upper") - F.col("lower"))
    return (
        attach(hist, _box(hist, by, value, width).select(*by, "lower", "upper"), by)
        .where(~F.col(value).between(F.col("lower") - reach, F.col("upper") + reach))
        .select(*by, value, F.col("t").alias("count"))
    )


def daily_rates(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Responses, trials and rates per subject, day and setting; a rate of no trials is NULL."""
    c = lambda name: F.count_if(F.col("Response") == name)
    return (
        trials.groupBy("Date", *keys)
        .agg(c("C.R.").alias("CR"), c("F.A.").alias("FA"), c("Hit").alias("Hit"), c("Miss").alias("Miss"))
        .withColumns({
            "Trials": F.col("CR") + F.col("FA") + F.col("Hit") + F.col("Miss"),
            "HitRate": F.try_divide(F.col("Hit"), F.col("Hit") + F.col("Miss")),
            "FARate": F.try_divide(F.col("FA"), F.col("CR") + F.col("FA")),
        })
    )


def hit_summary(trials: DataFrame, keys: list[str]) -> DataFrame:
    """Days, and the mean over days of trials, hit rate and false-alarm rate."""
    return daily_rates(trials, keys).groupBy(*keys).agg(
        F.count("Date").alias("count"), F.avg("Trials").alias("Trials"),
        F.avg("HitRate").alias("Hit"), F.avg("FARate").alias("FA"),
    )


def log_summary(log: DataFrame, keys: list[str]) -> DataFrame:
    """The same from logged daily values."""
    return log.groupBy(*keys).agg(
        F.count_distinct("Date").alias("count"), F.avg("Trials").alias("Trials"),
        F.avg("Hit").alias("Hit"), F.avg("FA").alias("FA"),
    )
