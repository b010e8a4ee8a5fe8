"""Signal detection: response table, no-go counts, d' and its companions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from earshot.functions.labels import stim_kind
from earshot.functions.normal import with_probit
from earshot.params import DPRIME_KEYS


def response_table(trials: DataFrame, keys: list[str] = DPRIME_KEYS, weight: str | None = None) -> DataFrame:
    """Counts of each response per setting, trial type, frequency and level; NULL for none.

    ``weight`` names a column of counts where the trials are counted already.
    """
    one = F.col(weight) if weight else F.lit(1)
    c = lambda name, out: F.sum(F.when(F.col("Response") == name, one)).alias(out)
    return trials.groupBy(*keys, "Type", "Freq", "Inten").agg(
        c("C.R.", "CR"), c("F.A.", "FA"), c("Hit", "Hit"), c("Miss", "Miss"),
    )


def attach_nogo(table: DataFrame, keys: list[str] = DPRIME_KEYS, nogo: str = "sum") -> DataFrame:
    """Go rows with the correct rejections and false alarms of their setting's no-go trials.

    ``nogo="sum"`` adds up the setting's no-go rows (none counts as zero);
    ``nogo="row_count"`` uses the number of those rows wherever it is not one.
    The window runs over the response table, which has one row per stimulus of a
    setting however many trials there were, so trials are read once only.
    """
    setting = Window.partitionBy(*keys)
    none = F.col("Type") == 0
    zero = F.lit(0).cast("long")
    over = lambda col: F.coalesce(F.sum(F.when(none, F.col(col))).over(setting), zero)
    cr, fa = F.col("_cr"), F.col("_fa")
    if nogo == "row_count":
        cr, fa = (F.when(F.col("_rows") == 1, c).otherwise(F.col("_rows")) for c in (cr, fa))
    return (
        table.withColumns({"_cr": over("CR"), "_fa": over("FA"), "_rows": F.count_if(none).over(setting)})
        .where(F.col("Type") == 1)
        .withColumns({
            "CR": F.coalesce("CR", cr), "FA": F.coalesce("FA", fa),
            "Hit": F.coalesce("Hit", zero), "Miss": F.coalesce("Miss", zero),
        })
        .drop("_cr", "_fa", "_rows")
    )


def dprime_indices(table: DataFrame) -> DataFrame:
    """d', beta and c from adjusted rates (Hautus 1995); A' and B''D from raw rates.

    A' follows Stanislaw & Todorov (1999), B''D Donaldson (1992).
    """
    hit, miss, fa, cr = F.col("Hit"), F.col("Miss"), F.col("FA"), F.col("CR")
    h, f = F.col("_h"), F.col("_f")
    above = 0.5 + F.try_divide((h - f) * (1 + h - f), 4 * h * (1 - f))
    below = 0.5 - F.try_divide((f - h) * (1 + f - h), 4 * f * (1 - h))
    both_no, both_yes = (1 - h) * (1 - f), h * f
    return (
        with_probit(table, {"_zh": (hit + 0.5) / (hit + miss + 1), "_zf": (fa + 0.5) / (fa + cr + 1)})
        .withColumns({"_h": F.try_divide(hit, hit + miss), "_f": F.try_divide(fa, fa + cr)})
        .withColumns({
            "dprime": F.col("_zh") - F.col("_zf"),
            "beta": F.exp((F.col("_zf") * F.col("_zf") - F.col("_zh") * F.col("_zh")) / 2),
            "aprime": F.when(h == f, 0.5).when(f > h, below).otherwise(above),
            "bppd": F.try_divide(both_no - both_yes, both_no + both_yes),
            "c": -(F.col("_zh") + F.col("_zf")) / 2,
            "dB": F.col("Inten"),
            "Type": stim_kind(F.col("Freq")),
        })
        .drop("_zh", "_zf", "_h", "_f")
    )


def dprime_table(
    trials: DataFrame, keys: list[str] = DPRIME_KEYS, nogo: str = "sum", weight: str | None = None,
) -> DataFrame:
    """d' per setting, stimulus and level, straight from trials (or counted trials)."""
    return dprime_indices(attach_nogo(response_table(trials, keys, weight), keys, nogo)).select(
        *keys, "Type", "dB", "Hit", "Miss", "FA", "CR", "dprime", "beta", "aprime", "bppd", "c",
    )
