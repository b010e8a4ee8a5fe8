"""Row numbers, ranks and exact quantiles that never sort a whole group in one task.

A group may hold a third of all rows, so a window over a whole group is used only
where its size was checked. Otherwise a group is cut into slots that follow its
order; slots are counted (partial aggregation), the short list of slot counts is
summed up per group, and rows are numbered inside their slot only. Everything is
a deterministic function of the data, so a task that is run again after a lost
executor gives the same answer.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from earshot.operators.joins import attach, group_of
from earshot.session import cut_lineage


ONE_TASK = 2_000_000  # rows of a group that one task may sort
SMALL = 100_000       # histogram entries that one task may hold


def numbered(
    df: DataFrame, keys: list[str], order: list[str], slot: Column,
    row: str = "row", total: str = "total", largest: int | None = None,
) -> DataFrame:
    """Add the 1-based row number in the group's ``order`` and the group's row count.

    ``largest`` is a bound on the rows of a group; without one, groups are counted
    first. Up to :data:`ONE_TASK` a window per group does both in one shuffle. Beyond,
    groups are cut by ``slot``, any column that never decreases along ``order`` (for
    trials: the minute they happened in), and rows are shuffled on (group, slot).
    """
    slotted = df.withColumn("_g", group_of(keys))
    if largest is None:
        largest = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    if largest <= ONE_TASK:
        group = Window.partitionBy("_g")
        return slotted.withColumns({
            row: F.row_number().over(group.orderBy(*order)).cast("long"), total: F.count("*").over(group),
        }).drop("_g")
    slotted = slotted.withColumn("_slot", slot)
    along = Window.partitionBy("_g").orderBy("_slot")
    offsets = (
        slotted.groupBy("_g", "_slot").agg(F.count("*").alias("_n"))
        .select(
            "_g", "_slot",
            (F.sum("_n").over(along) - F.col("_n")).alias("_off"),
            F.sum("_n").over(Window.partitionBy("_g")).alias(total),
        )
    )
    inside = Window.partitionBy("_g", "_slot").orderBy(*order)
    return (
        slotted.withColumn("_r", F.row_number().over(inside))
        .join(offsets, ["_g", "_slot"])
        .withColumn(row, F.col("_off") + F.col("_r"))
        .drop("_g", "_slot", "_off", "_r")
    )


def is_small(hist: DataFrame, entries: int = SMALL) -> bool:
    """Does a materialised histogram have at most ``entries`` rows in all?"""
    return hist.count() <= entries


def histogram(df: DataFrame, keys: list[str], value: str, count: str = "t", weight: str | None = None) -> DataFrame:
    """Rows reduced to (keys, value) with their count; NULL values are left out.

    ``weight`` names a column of counts where the rows are counted already. The
    table is checkpointed: whoever asks for it reads it several times.
    """
    n = F.sum(weight) if weight else F.count("*")
    return cut_lineage(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias(count)))


def _slotted(
    df: DataFrame, keys: list[str], value: str, width: float | None,
    rows: int, most: int, rounds: int,
) -> tuple[DataFrame, list[str]]:
    if width:
        return df.withColumn("_s1", F.floor(F.col(value) / F.lit(float(width)))), ["_s1"]
    slots: list[str] = []
    for i in range(1, rounds + 1):
        name = f"_s{i}"
        spread = df.groupBy(*keys, *slots).agg(
            F.min(value).cast("double").alias("_lo"),
            F.max(value).cast("double").alias("_hi"),
            F.count("*").alias("_n"),
        )
        parts = F.least(F.ceil(F.col("_n") / F.lit(rows)), F.lit(most))
        share = (F.col(value) - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))
        df = (
            attach(df, spread, keys + slots)
            .withColumn(
                name,
                F.when((F.col("_n") <= rows) | (F.col("_hi") <= F.col("_lo")), F.lit(0).cast("long"))
                .otherwise(F.least(F.floor(share * parts), parts - 1)),
            )
            .drop("_lo", "_hi", "_n")
        )
        slots.append(name)
    return df, slots


def cumulative(
    hist: DataFrame, keys: list[str], value: str, count: str = "t",
    width: float | None = None, rows: int = 20_000, most: int = 4_000, rounds: int = 2, small: int = SMALL,
) -> DataFrame:
    """Add ``before`` (rows with a smaller value in the group) and ``total`` to a histogram.

    ``hist`` should be materialised; up to ``small`` entries in all are summed by a
    plain window. Above that groups are cut into slots: ``width`` wide when the
    measurement has a natural step (1 ms for reaction times), else groups of more
    than ``rows`` entries evenly between their extremes, crowded slots once more.
    """
    small_enough = is_small(hist, small)
    hist = hist.withColumn("_g", group_of(keys))
    if small_enough:
        upto = Window.partitionBy("_g").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return hist.withColumns({
            "before": F.sum(count).over(upto) - F.col(count),
            "total": F.sum(count).over(Window.partitionBy("_g")),
        }).drop("_g")
    hist, slots = _slotted(hist, keys, value, width, rows, most, rounds)
    along = Window.partitionBy("_g").orderBy(*slots)
    offsets = (
        hist.groupBy("_g", *slots).agg(F.sum(count).alias("_n"))
        .select(
            "_g", *slots,
            (F.sum("_n").over(along) - F.col("_n")).alias("_off"),
            F.sum("_n").over(Window.partitionBy("_g")).alias("total"),
        )
    )
    upto = Window.partitionBy("_g", *slots).orderBy(value).rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return (
        hist.withColumn("_in", F.sum(count).over(upto) - F.col(count))
        .join(offsets, ["_g", *slots])
        .withColumn("before", F.col("_off") + F.col("_in"))
        .drop("_g", "_off", "_in", *slots)
    )


def quantile_from(prob: float, value: str, count: str = "t") -> Column:
    """Aggregate over a :func:`cumulative` table: the interpolated quantile (R's type 7)."""
    place = (F.col("total") - 1) * F.lit(prob)
    low, high = F.floor(place), F.ceil(place)

    def at(k: Column) -> Column:
        return F.max(F.when((F.col("before") <= k) & (k < F.col("before") + F.col(count)), F.col(value)))

    share = F.max(place - low)
    return at(low) + share * (at(high) - at(low))


def midranks(
    df: DataFrame, keys: list[str], value: str, rank: str = "rank", width: float | None = None,
) -> DataFrame:
    """Rank of every row's value in its group, ties averaged; adds ``t``, the tie count.

    Rows with a NULL value keep a NULL rank.
    """
    cum = cumulative(histogram(df, keys, value), keys, value, width=width)
    ranks = cum.select(
        *keys, value, "t", (F.col("before") + (F.col("t") + 1) / F.lit(2.0)).alias(rank)
    )
    return attach(df, ranks, keys + [value])
