"""Cutting trials into blocks: drop the warm-up block, count blocks, trim to a common cap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.ranks import ONE_TASK, numbered
from earshot.params import Params

BLOCK_KEYS = ["Date", "ID", "Sex", "Stim"]


def block_size(sizes: dict[str, int], stim: str = "Stim") -> Column:
    """Trials per block of a stimulus; NULL where the stimulus is not listed."""
    out = None
    for name, size in sizes.items():
        test = F.col(stim) == name
        out = F.when(test, size) if out is None else out.when(test, size)
    return out


def unknown_stimuli(trials: DataFrame, sizes: dict[str, int]) -> DataFrame:
    """How many trials per group have a stimulus without a block size (blocks leave them out)."""
    return trials.where(block_size(sizes).isNull()).groupBy(*BLOCK_KEYS).agg(F.count("*").alias("n"))


def drop_first_block(
    trials: DataFrame, order: list[str], slot: Column, params: Params = Params(),
) -> DataFrame:
    """Keep rows from the second block to the last whole block of each recording.

    Adds ``Blocks_trimmed``, the whole blocks kept, and ``block_row``, the row's
    place among the kept rows. Recordings under two blocks, and those of a stimulus
    without a block size, keep nothing.
    """
    rows = trials.count()  # for stored trials a look at the file footers; bounds every group
    largest = rows if rows <= ONE_TASK else None
    return kept_rows(numbered(trials, BLOCK_KEYS, order, slot, largest=largest), params)


def kept_rows(trials: DataFrame, params: Params = Params()) -> DataFrame:
    """:func:`drop_first_block` of trials that have their number ``row`` and the recording's ``total``.

    A filter alone. Its first part compares stored columns with constants, so that a scan
    of :mod:`earshot.sources.layer` can skip warm-up blocks by the files' statistics.
    """
    sized = trials.withColumn("_m", block_size(params.block_sizes))
    blocks = F.floor(F.col("total") / F.col("_m"))
    later = F.lit(False)
    for name, size in params.block_sizes.items():
        later = later | ((F.col("Stim") == name) & (F.col("row") > size))
    return (
        sized.where(later).where(F.col("row") <= blocks * F.col("_m"))
        .withColumn("Blocks_trimmed", blocks - 1)
        .withColumn("block_row", F.col("row") - F.col("_m"))
        .drop("_m", "row", "total")
    )


def block_counts(trials: DataFrame, params: Params = Params()) -> DataFrame:
    """Whole blocks left per recording once the first is dropped (none below two)."""
    m = block_size(params.block_sizes)
    return (
        trials.where(m.isNotNull()).groupBy(*BLOCK_KEYS).agg(F.count("*").alias("n"))
        .withColumn("Blocks_trimmed", F.greatest(F.floor(F.col("n") / m) - 1, F.lit(0)))
        .drop("n")
    )


def block_caps(trials: DataFrame, params: Params = Params()) -> DataFrame:
    """One row: blocks that every recording reaches; for tones never under ``min_blocks``."""
    least = lambda stim: F.min(F.when(F.col("Stim") == stim, F.col("Blocks_trimmed")))
    return block_counts(trials, params).agg(
        least("BBN").alias("bbn_cap"),
        F.greatest(least("tone"), F.lit(params.min_blocks).cast("long")).alias("tone_cap"),
    )


def trim_blocks(
    trials: DataFrame, order: list[str], slot: Column, params: Params = Params(),
    cap_by_stim: bool = False,
) -> DataFrame:
    """Recordings that reach the cap, cut to it.

    The tone cap decides which recordings stay, also for noise; ``cap_by_stim``
    holds each stimulus to its own.
    """
    caps = block_caps(trials, params)  # a global aggregate: always one row
    own = F.when(F.col("Stim") == "tone", F.col("tone_cap")).otherwise(F.col("bbn_cap"))
    floor = own if cap_by_stim else F.col("tone_cap")
    return (
        drop_first_block(trials, order, slot, params)
        .crossJoin(F.broadcast(caps))
        .where((F.col("Blocks_trimmed") >= floor)
               & (F.col("block_row") <= own * block_size(params.block_sizes)))
        .drop("bbn_cap", "tone_cap")
    )
