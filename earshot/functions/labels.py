"""Text labels: condition, sex, background, stimulus kind, significance stars."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from earshot.params import BACKGROUND_LABELS, NOISE_TITLES, PHASE_ENDINGS, NOISE_TITLES


def condition_of(phase: Column) -> Column:
    """Condition from the first phase ending that matches, else Baseline."""
    (first, label), *others = PHASE_ENDINGS
    out = F.when(phase.rlike(first), label)
    for pattern, label in others:
        out = out.when(phase.rlike(pattern), label)
    return out.otherwise("Baseline")


def sex_of(subject: Column) -> Column:
    return F.when(subject.contains("Green"), "Male").otherwise("Female")


def background_label(bg_type: Column, bg_intensity: Column) -> Column:
    """Readable background; a pair that is not listed becomes ISSUE."""
    out = None
    for (kind, level), label in BACKGROUND_LABELS.items():
        test = (bg_type == kind) & (bg_intensity == level)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("ISSUE")


def noise_title(bg_type: Column) -> Column:
    """Title of a background noise by its type; NULL for types that are not listed."""
    out = None
    for kind, title in NOISE_TITLES.items():
        out = F.when(bg_type == kind, title) if out is None else out.when(bg_type == kind, title)
    return out


def stim_kind(freq: Column) -> Column:
    """0 becomes BBN, any other frequency ``<f>kHz`` without trailing zeros."""
    whole = freq == F.floor(freq)
    number = F.when(whole, freq.cast("long").cast("string")).otherwise(freq.cast("string"))
    return F.when(freq == 0, "BBN").otherwise(F.concat(number, F.lit("kHz")))


def stars(p: Column) -> Column:
    """Significance mark of a p-value."""
    return (
        F.when(p <= 0.001, "***").when(p <= 0.01, "**").when(p <= 0.05, "*")
        .when(p <= 0.1, ".").when(p.isNotNull(), " ")
    )


def level_rank(col: Column, levels: list) -> Column:
    """Position of a value in a level order; values not listed sort last."""
    pos = F.array_position(F.array(*[F.lit(v) for v in levels]), col)
    return F.when(pos > 0, pos).otherwise(F.lit(len(levels) + 1))


def recode(col: Column, mapping: dict) -> Column:
    """Many-to-one renaming of levels; values not listed are kept."""
    out = None
    for old, new in mapping.items():
        out = F.when(col == old, new) if out is None else out.when(col == old, new)
    return out.otherwise(col)


def known(flag: Column) -> Column:
    """A predicate with NULL taken as false, as set membership treats it."""
    return F.coalesce(flag, F.lit(False))
