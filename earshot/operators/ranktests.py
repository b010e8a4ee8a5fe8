"""Rank tests and normality: Kruskal-Wallis, rank-sum, Benjamini-Hochberg, Shapiro-Wilk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.normal import normal_upper, with_probit
from earshot.functions.tails import chi2_p
from earshot.operators.joins import attach, group_of
from earshot.operators.ranks import cumulative, histogram
from earshot.session import cut_lineage

SLOT_VALUES, MOST_SLOTS = 1_000_000, 256  # of adjusted p values: distinct ones of a slot, and slots of a family


def _group_ranks(
    df: DataFrame, keys: list[str], value: str, group: str, width: float | None,
) -> tuple[DataFrame, DataFrame]:
    """Per key and group: count and rank sum (ties averaged); per key: N and the tie sum."""
    hist = cut_lineage(
        df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
        .groupBy(*keys, value, group).agg(F.count("*").alias("_c"))
    )
    cum = cut_lineage(cumulative(histogram(hist, keys, value, weight="_c"), keys, value, width=width))
    ranks = cum.select(*keys, value, (F.col("before") + (F.col("t") + 1) / F.lit(2.0)).alias("_rank"))
    groups = attach(hist, ranks, [*keys, value]).groupBy(*keys, group).agg(
        F.sum("_c").alias("_ng"), F.sum(F.col("_c") * F.col("_rank")).alias("_rg"),
    )
    t = F.col("t").cast("double")
    ties = cum.groupBy(*keys).agg(
        F.max("total").cast("double").alias("_N"), F.sum(t * t * t - t).alias("_ties"),
    )
    return groups, ties


def kruskal(df: DataFrame, value: str, group: str, keys: list[str] = (), width: float | None = None) -> DataFrame:
    """Kruskal-Wallis statistic with tie correction, degrees of freedom and p."""
    keys = list(keys)
    groups, ties = _group_ranks(df, keys, value, group, width)
    spread = groups.groupBy(*keys).agg(
        F.sum(F.col("_rg") * F.col("_rg") / F.col("_ng")).alias("_s"), (F.count("*") - 1).alias("df"),
    )
    n = F.col("_N")
    raw = 12.0 * F.col("_s") / (n * (n + 1)) - 3.0 * (n + 1)
    h = F.try_divide(raw, 1.0 - F.try_divide(F.col("_ties"), n * n * n - n))
    return (
        attach(spread, ties, keys).withColumn("n", n.cast("long")).withColumn("h", h)
        .withColumn("p", chi2_p("h", "df")).select(*keys, "n", "df", "h", "p")
    )


def ranksum(
    df: DataFrame, keys: list[str], value: str, group: str, first: str, second: str,
    width: float | None = None,
) -> DataFrame:
    """Is ``first`` larger? Rank-sum W, and p by the normal approximation.

    With continuity and tie correction, one-sided.
    """
    groups, ties = _group_ranks(df.where(F.col(group).isin(first, second)), keys, value, group, width)
    part = lambda name, col: F.coalesce(F.sum(F.when(F.col(group) == name, F.col(col))), F.lit(0)).cast("double")
    n1, n2, n = F.col("n1"), F.col("n2"), F.col("_N")
    variance = n1 * n2 / 12.0 * (n + 1 - F.try_divide(F.col("_ties"), n * (n - 1)))
    return (
        attach(groups.groupBy(*keys).agg(
            part(first, "_ng").alias("n1"), part(second, "_ng").alias("n2"), part(first, "_rg").alias("_r1"),
        ), ties, keys)
        .withColumn("w", F.col("_r1") - n1 * (n1 + 1) / 2.0)
        .withColumn("z", F.when((n1 > 0) & (n2 > 0), F.try_divide(F.col("w") - n1 * n2 / 2.0 - 0.5, F.sqrt(variance))))
        .withColumn("p", normal_upper(F.col("z")))
        .select(*keys, n1.cast("long").alias("n1"), n2.cast("long").alias("n2"), "w", "z", "p")
    )


def adjust_bh(df: DataFrame, p: str, family: list[str] = (), out: str = "BH", slot_values: int = SLOT_VALUES) -> DataFrame:
    """Benjamini-Hochberg adjusted p within a family of tests; NULL p stays out.

    Distinct values of a family are counted and cut into slots of about ``slot_values`` along
    their order. Ranks are counts within a slot and totals of the slots before it, minima from
    above those within a slot and of the slots after it. So no window holds more than a slot
    of one family, or its slots.
    """
    match = group_of(list(family))
    counts = df.where(F.col(p).isNotNull()).groupBy(match.alias("_family"), F.col(p).alias("_p")).agg(F.count("*").alias("_t"))
    slots = min(MOST_SLOTS, -(-counts.count() // slot_values))
    borders = []
    if slots > 1:  # a sketch of bounded size
        borders = counts.agg(F.percentile_approx("_p", [i / slots for i in range(1, slots)], 10 * slots)).first()[0]
    slot = F.size(F.filter(F.array(*map(F.lit, sorted(set(borders)))), lambda b: b <= F.col("_p"))) if borders else F.lit(0)
    placed = counts.withColumn("_slot", slot)
    own = Window.partitionBy("_family", "_slot").orderBy("_p")
    over = Window.partitionBy("_family").orderBy("_slot")
    sums = placed.groupBy("_family", "_slot").agg(F.sum("_t").alias("_n")).withColumns({
        "_before": F.coalesce(F.sum("_n").over(over.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "_all": F.sum("_n").over(Window.partitionBy("_family")),
    }).drop("_n")
    rank = F.col("_before") + F.sum("_t").over(own.rowsBetween(Window.unboundedPreceding, 0))
    scaled = placed.join(sums, ["_family", "_slot"]).withColumn("_scaled", F.col("_p") * F.col("_all") / rank)
    above = scaled.groupBy("_family", "_slot").agg(F.min("_scaled").alias("_least")).withColumn(
        "_after", F.min("_least").over(over.rowsBetween(1, Window.unboundedFollowing))).drop("_least")
    best = F.least(F.lit(1.0), F.min("_scaled").over(own.rowsBetween(0, Window.unboundedFollowing)), F.col("_after"))
    found = scaled.join(above, ["_family", "_slot"]).select(F.struct("_family", "_p").alias("_match"), best.alias(out))
    return df.withColumn("_match", F.struct(match.alias("_family"), F.col(p).alias("_p"))).join(found, "_match", "left").drop("_match")


# --- fixed values: Royston (1995), algorithm AS R94, constant term first ---
OUTER = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
NEXT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_GAMMA = [-2.273, 0.459]
SMALL_MEAN = [0.544, -0.39978, 0.025054, -6.714e-4]
SMALL_SD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_SD = [-0.4803, -0.082676, 0.0030302]
# ----------------------------------------------------------------------------
FEWEST = 3
SLICE = 10_000  # ranks of one value that are written out together


def _poly(coefs: list[float], x: Column) -> Column:
    out = F.lit(coefs[-1])
    for c in reversed(coefs[:-1]):
        out = out * x + c
    return out


def shapiro(df: DataFrame, value: str, keys: list[str] = ()) -> DataFrame:
    """Shapiro-Wilk W and p per group of at least 3 values.

    The published polynomials were fitted for up to 5000 values; above, p extrapolates them
    and W is exact. Ranks come from counts of distinct values, so that no group is sorted in
    one task; values that occur often give their ranks by their count, in slices of ``SLICE``
    that are dealt to tasks.
    """
    keys = list(keys)
    rows = df.where(F.col(value).isNotNull())
    ranks = cumulative(cut_lineage(histogram(rows, keys, value)), keys, value)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    each = ranks.where(F.col("total") >= FEWEST).withColumn("_i", F.explode(
        F.sequence(F.col("before") + 1, F.col("before") + F.col("t"), F.lit(SLICE).cast("long")))).repartition(*keys, value, "_i")
    each = each.withColumn("_i", F.explode(F.sequence(F.col("_i"), F.least(F.col("_i") + (SLICE - 1), F.col("before") + F.col("t")))))
    each = each.withColumnRenamed("total", "n").drop("before", "t")
    ranked = with_probit(each, {"_m": (F.col("_i") - 0.375) / (F.col("n") + 0.25)})
    i, n, x, m = F.col("_i"), F.col("n"), F.col(value), F.col("_m")
    at = lambda rank, col: F.max(F.when(i == rank, col))
    edge = F.when(n > 5, 2).otherwise(1)
    sums = ranked.groupBy(*keys, "n").agg(
        F.sum(m * m).alias("_mm"), at(n, m).alias("_m1"), at(n - 1, m).alias("_m2"),
        (F.max(x) - F.min(x)).alias("_d1"), (at(n - 1, x) - at(F.lit(2), x)).alias("_d2"),
        F.sum(F.when((i > edge) & (i <= n - edge), m * x)).alias("_mid"),
        (F.var_samp(x) * (F.max(n) - 1)).alias("_ss"),
    )
    root, rsn = F.sqrt("_mm"), 1.0 / F.sqrt(n)
    m1, m2, a1, a2 = F.col("_m1"), F.col("_m2"), F.col("_a1"), F.col("_a2")
    scale = F.when(n > 5, (F.col("_mm") - 2 * m1 * m1 - 2 * m2 * m2) / (1 - 2 * a1 * a1 - 2 * a2 * a2)).otherwise(
        F.try_divide(F.col("_mm") - 2 * m1 * m1, 1 - 2 * a1 * a1)
    )
    contrast = (
        F.when(n == 3, F.sqrt(F.lit(0.5)) * F.col("_d1"))
        .when(n > 5, a1 * F.col("_d1") + a2 * F.col("_d2") + F.col("_mid") / F.sqrt(F.col("_scale")))
        .otherwise(a1 * F.col("_d1") + F.col("_mid") / F.sqrt(F.col("_scale")))
    )
    tested = (
        sums.withColumns({"_a1": _poly(OUTER, rsn) + m1 / root, "_a2": _poly(NEXT, rsn) + m2 / root})
        .withColumn("_scale", scale)
        .withColumn("W", F.when(F.col("_ss") > 0, F.least(contrast * contrast / F.col("_ss"), F.lit(1.0))))
    )
    w, ln, y = F.col("W"), F.log(n), F.col("_y")
    gamma = _poly(SMALL_GAMMA, n)
    z = F.when(n <= 11, (-F.log(gamma - y) - _poly(SMALL_MEAN, n)) / F.exp(_poly(SMALL_SD, n))).otherwise(
        (y - _poly(LARGE_MEAN, ln)) / F.exp(_poly(LARGE_SD, ln))
    )
    exact3 = F.greatest(F.lit(1.90985931710274) * (F.asin(F.sqrt(w)) - F.asin(F.sqrt(F.lit(0.75)))), F.lit(0.0))
    done = (
        tested.withColumn("_y", F.log(1 - w))
        .withColumn("_z", z)
        .withColumn("p", F.when(w >= 1.0, 1.0).when(n == 3, exact3).when((n <= 11) & (y >= gamma), 1e-99)
                    .otherwise(normal_upper(F.col("_z"))))
        .select(*keys, "W", "p")
    )
    return attach(sizes, done, keys).select(*keys, "n", "W", "p")
