"""Quality rules: base counts of a text, and the share of it that is repeated.

Repetition is read off a suffix array over the text's words. Each interval of suffixes
with a common prefix stands for a repeated substring; the deepest interval of each suffix
gives the maximal one from there on. The union of all repeats of at least ``LEAST_REPEAT``
words is the covered part; the longest one counts by itself. A text fails where the
covered part or the longest repeat is too large a share of it, or the longest repeat too long
for any text. The base rule counts words; the covered share counts their characters, and has
the lower limit.

One pass over the texts where they lie, nothing is shuffled; memory follows the batch or
the longest text. NULL, empty and blank texts have no words and fail the base rule. Each
row is judged by its own text, so repeated rows get the same answer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.llm import bytewords, suffixes

LEAST_WORDS = 10
WINDOW = 5  # words of the base rule's repeated windows
MOST_REPEATED = 0.20  # share of words in repeated windows
LEAST_REPEAT = 10  # words of a repeat that counts for the verdict
MOST_COVERED = 0.15  # share of the words' characters that repeats cover
MOST_LONGEST = 0.30  # share of words in the longest repeat
LONGEST_WORDS = 200  # a repeat of more words fails in a text of any length
CHUNK = 250_000  # bytes of texts, or one text, that a worker measures at once: its arrays take nearly a hundred times that
SYMBOLS = b"#*$%&|<>"  # fixed values
MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_chars", "longest_repeat"]
SHAPE = T.StructType([T.StructField(m, T.LongType()) for m in MEASURES])

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(SYMBOLS)] = True


def measures(raws: list[bytes]) -> pd.DataFrame:
    """The ``MEASURES`` for each text, given as UTF-8."""
    w = bytewords.Words(raws)
    leads = (w.bytes & 0xC0) != 0x80
    counted = leads & ~w.blank
    text = w.text_of_words()
    ids = w.hashes(w.start, w.end)
    ids = bytewords.mixed(ids + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order, levels = suffixes.word_suffixes(ids, text)
    repeat = suffixes.longest_repeats(order, suffixes.neighbour_prefixes(order, levels))
    chars = np.concatenate([[0], np.cumsum(counted)])
    word_chars = chars[w.end] - chars[w.start]

    def summed(values: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(values)])
        return sums[w.bound[1:]] - sums[w.bound[:-1]]

    longest = np.zeros(len(raws), np.int64)
    np.maximum.at(longest, text, repeat)
    return pd.DataFrame({
        "n_words": w.counts,
        "word_chars": w.per_text(counted),
        "n_symbols": w.per_text(_SYMBOL[w.bytes]),
        "n_dup_lines": repeated_lines(w),
        "n_repeat_words": summed(covered(np.where(repeat >= WINDOW, WINDOW, 0))),
        "covered_chars": summed(np.where(covered(np.where(repeat >= LEAST_REPEAT, repeat, 0)), word_chars, 0)),
        "longest_repeat": longest,
    })


def covered(length: np.ndarray) -> np.ndarray:
    """Which positions lie in the union of spans ``length`` long that start at each position."""
    n = len(length)
    reach = np.maximum.accumulate(np.arange(n) + length) if n else length
    return reach > np.arange(n)


def repeated_lines(w: bytewords.Words) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text."""
    ends = np.flatnonzero(w.bytes == 10)
    starts = np.concatenate([[0], ends[:-1] + 1])
    some = np.searchsorted(w.start, ends) > np.searchsorted(w.start, starts)
    starts, ends = starts[some], ends[some]
    text = np.searchsorted(w.first, starts, side="right") - 1
    key = bytewords.mixed(w.hashes(starts, ends) + text.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, firsts = np.unique(key, return_index=True)
    n = len(w.sizes)
    return np.bincount(text, minlength=n) - np.bincount(text[firsts], minlength=n)


@F.pandas_udf(SHAPE)
def _measured(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        parts = [measures(raws) for _, raws in bytewords.chunks(texts.tolist(), CHUNK)]
        yield pd.concat(parts) if parts else pd.DataFrame(columns=MEASURES, dtype="int64")


def assess(docs: DataFrame, text: str = "text", out: str = "quality") -> DataFrame:
    """The table with a struct ``out``: the measures, ``base_failed`` and ``kept``."""
    m = _measured(F.col(f"`{text}`").cast("string"))
    q = docs.withColumn(out, m)
    c = lambda name: F.col(out)[name]
    failed = (c("n_words") < LEAST_WORDS) | (100 * c("n_repeat_words") > int(100 * MOST_REPEATED) * c("n_words"))
    return q.withColumn(out, F.col(out).withField("base_failed", failed)).withColumn(
        out, F.col(out).withField("kept", ~F.col(out)["base_failed"] & ~_too_repetitive(F.col(out)))
    )


def _too_repetitive(q: Column) -> Column:
    return (q["covered_chars"] > MOST_COVERED * q["word_chars"]) | (
        q["longest_repeat"] > MOST_LONGEST * q["n_words"]) | (q["longest_repeat"] > LONGEST_WORDS)
