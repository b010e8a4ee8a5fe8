"""Runs of words of a text."""

from __future__ import annotations

import numpy as np

SEED = 42


def shingles(text: str | None, shingle: int) -> list[bytes]:
    """The text's runs of ``shingle`` words in order; fewer words are one run."""
    words = text.encode().lower().split() if text else []  # bytes split at ASCII white space only
    joined = b" ".join(words)
    if len(words) <= shingle:
        return [joined] if words else []
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-shingle] + 1).tolist()
    return [joined[a:b] for a, b in zip(starts, ends[shingle - 1:].tolist())]
