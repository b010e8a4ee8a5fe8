"""Exact substring dedup over bytes, by a distributed merge sort of suffixes.

Sorting every suffix of a corpus moves many times its size, so the suffixes that are sorted
start at anchors. A window of ``window`` bytes chooses as its anchor the ``PREFIX`` bytes in
it that have the least hash, the leftmost of equal ones; equal windows choose alike. The
windows that share an anchor form one stretch of the text.

Each chunk of texts sorts its distinct anchored suffixes, cut after ``PREFIX`` bytes, and
front-codes them. Runs are exchanged by ranges of the order, and each range merges its runs
with a loser tree that never compares known prefixes again (lcpmerge.py). Suffixes with the
whole prefix in common stand together:

* an anchor that occurs once has no repeated window around it;
* where all stretches around an anchor are equal, all their windows are repeated;
* elsewhere, at the ends of repeats, the stretches' windows are compared one by one: they
  meet by their 64-bit hashes, as do whole stretches.

A passage costs one entry per chunk (exchange.py), however many copies of it there are. Range
borders come from a sample of whole chunks, they only balance the work. Windows are judged on the input;
NULL, empty and short texts keep all their bytes.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm import bytewords, exchange, lcpmerge

PREFIX = 48  # bytes of a suffix that are sorted
CHUNK_BYTES = 2_000_000
SAMPLED_CHUNKS, SAMPLED_SUFFIXES = 8, 512  # for the borders of ranges: chunks, and suffixes of each
RUNS = "part int, chunk long, first long, prefixes binary, rests binary, stretches binary, flags binary"
GIVEN = "chunk long, first long, packed binary"
SEVERAL, MIXED = 1, 2
ONCE, ALL, SOME = 0, 1, 2  # verdicts on an anchor


class Chunk:
    """Bytes of some texts with their anchors; stretch i covers window starts low[i] to high[i]."""

    def __init__(self, texts: pd.Series, window: int) -> None:
        self.raws = [t.encode() for t in texts]
        self.w = w = bytewords.Words(self.raws)
        n = len(w.bytes)
        self.low = self.high = self.anchor = np.zeros(0, np.int64)
        self.valid = np.zeros(n, bool)
        if n < window:
            return
        long = w.sizes >= window
        steps = np.zeros(n + 1, np.int32)
        np.add.at(steps, w.first[long], 1)
        np.add.at(steps, (w.first + w.sizes)[long] - window + 1, -1)
        self.valid = np.cumsum(steps[:-1]) > 0
        key = w.marks_along(PREFIX)
        key &= np.uint64(0xFFFFFFFF00000000)
        key |= np.arange(len(key), dtype=np.uint64)
        at = np.flatnonzero(self.valid)
        if not len(at):
            return
        chosen = (sliding_min(key, window - PREFIX + 1)[at] & np.uint64(0xFFFFFFFF)).astype(np.int64)
        new = np.flatnonzero(np.concatenate([[True], (np.diff(chosen) != 0) | (np.diff(at) != 1)]))
        self.low, self.high, self.anchor = at[new], at[np.append(new[1:], len(at)) - 1], chosen[new]

    def suffixes(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted distinct suffixes, for each stretch the number of its suffix, and per suffix a stretch's hash and flags."""
        hashed = self.w.hashes(self.anchor, self.anchor + PREFIX)
        _, one, which = np.unique(hashed, return_index=True, return_inverse=True)
        strings = self.w.bytes[self.anchor[one][:, None] + np.arange(PREFIX)]
        order = lcpmerge.sort_order(strings)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        which = place[which]
        stretch = self.w.hashes(self.low, self.high + window)
        example = np.zeros(len(order), np.uint64)
        example[which] = stretch
        flags = np.where(np.bincount(which, minlength=len(order)) > 1, SEVERAL, 0).astype(np.uint8)
        flags[which[example[which] != stretch]] |= MIXED
        return strings[order], which, example, flags


def sliding_min(key: np.ndarray, width: int) -> np.ndarray:
    """Least key of each ``width`` consecutive ones."""
    n = len(key) - width + 1
    rows = np.append(key, np.full(-len(key) % width, ~np.uint64(0))).reshape(-1, width)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1:width - 1 + n])


def merge_range(pdf: pd.DataFrame) -> pd.DataFrame:
    """Runs of one range to verdicts on their anchors, as rows of ``GIVEN`` with one byte each."""
    prefixes, flags = pdf["prefixes"].tolist(), [f for f in pdf["flags"]]
    stretches = [np.frombuffer(s, np.uint64).tolist() for s in pdf["stretches"]]
    verdicts = [bytearray(len(p)) for p in prefixes]
    place = [0] * len(prefixes)
    group: list[tuple[int, int]] = []
    first_stretch, mixed, several = 0, False, False

    def settle() -> None:
        if several or len(group) > 1:
            verdict = SOME if mixed else ALL
            for run, i in group:
                verdicts[run][i] = verdict

    for run, shared in lcpmerge.merged(prefixes, pdf["rests"].tolist(), PREFIX):
        i = place[run]
        place[run] = i + 1
        flag, stretch = flags[run][i], stretches[run][i]
        if shared < PREFIX:
            settle()
            group, first_stretch, mixed, several = [(run, i)], stretch, flag & MIXED > 0, flag & SEVERAL > 0
        else:
            group.append((run, i))
            mixed = mixed or flag & MIXED > 0 or stretch != first_stretch
    settle()
    rows = [(c, f, bytes(v)) for c, f, v in zip(pdf["chunk"], pdf["first"], verdicts) if any(v)]
    return pd.DataFrame(rows, columns=["chunk", "first", "packed"])


def _borders(texts: DataFrame, parts: int, window: int) -> list[bytes]:
    """Strings that divide the order of suffixes into about equal parts."""
    chunks = max(SAMPLED_CHUNKS, parts // 512)

    def sample(chunk: int, pdf: pd.DataFrame) -> pd.DataFrame:
        strings = Chunk(pdf["text"], window).suffixes(window)[0]
        some = np.linspace(0, len(strings) - 1, min(len(strings), SAMPLED_SUFFIXES)).astype(int)
        return pd.DataFrame({"s": [strings[i].tobytes() for i in some]}, dtype=object)

    if parts == 1:
        return []
    rows = exchange.per_chunk(texts.where(F.col("chunk") < chunks), sample, "s binary").collect()
    found = sorted(bytes(r.s) for r in rows)
    return [found[len(found) * i // parts] for i in range(1, parts)] if found else []


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 200, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """One row per input row: ``key``, n_bytes, n_removed, n_spans, kept (binary, the bytes that stay)."""
    texts, chunks = exchange.chunked(docs, key, text, chunk_bytes)
    parts = buckets = exchange.buckets_for(chunks)
    borders = _borders(texts, parts, window)

    def runs(chunk: int, pdf: pd.DataFrame) -> pd.DataFrame:
        strings, _, stretch, flags = Chunk(pdf["text"], window).suffixes(window)
        whole = [s.tobytes() for s in strings]
        ends = [0, *(bisect_left(whole, b) for b in borders), len(whole)]
        rows = [
            (p, chunk, i, *lcpmerge.front_coded(strings[i:j]), stretch[i:j].tobytes(), flags[i:j].tobytes())
            for p, (i, j) in enumerate(zip(ends, ends[1:])) if j > i
        ]
        return pd.DataFrame(rows, columns=[c.split()[0] for c in RUNS.split(", ")])

    def verdicts(back: pd.DataFrame, n: int) -> np.ndarray:
        out = np.zeros(n, np.uint8)
        for first, given in zip(back["first"], back["packed"]):
            out[first:first + len(given)] = np.frombuffer(given, np.uint8)
        return out

    def windows(chunk: int, pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(pdf["text"], window)
        strings, which, _, _ = c.suffixes(window)
        some = verdicts(back, len(strings))[which] == SOME
        at = _spread(c.low[some], c.high[some])
        return exchange.entries(chunk, *exchange.distinct(c.w.hashes(at, at + window)), buckets, 64)

    def cut(chunk: int, pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(pdf["text"], window)
        strings, which, _, _ = c.suffixes(window)
        verdict = verdicts(back[back["first"] >= 0], len(strings))[which]
        repeated = np.zeros(len(c.w.bytes) + 1, bool)
        repeated[_spread(c.low[verdict == ALL], c.high[verdict == ALL])] = True
        at = _spread(c.low[verdict == SOME], c.high[verdict == SOME])
        repeated[at] = exchange.contains(exchange.hits_of(back[back["first"] < 0]), c.w.hashes(at, at + window))
        here = np.arange(len(c.w.bytes))
        gone = np.maximum.accumulate(np.where(repeated[:-1], here + window, 0)) > here
        fresh = gone & ~np.append(False, gone[:-1])
        first, last = c.w.first, c.w.first + c.w.sizes
        lost, spans = np.append(0, np.cumsum(gone)), np.append(0, np.cumsum(fresh))
        removed = lost[last] - lost[first]
        kept = [raw if not r else c.w.bytes[i:j][~gone[i:j]].tobytes() for raw, r, i, j in zip(c.raws, removed, first, last)]
        return pd.DataFrame({"key": pdf["key"].array, "n_bytes": c.w.sizes, "n_removed": removed, "n_spans": spans[last] - spans[first], "kept": kept})

    kind = texts.schema["key"].dataType.simpleString()
    judged = exchange.per_chunk(texts, runs, RUNS).groupBy("part").applyInPandas(merge_range, GIVEN)
    again = exchange.shared(exchange.per_chunk_with(texts, judged, windows, exchange.ENTRIES), anchored=False)
    given = judged.unionByName(again.withColumn("first", F.lit(-1).cast("long")))
    out = exchange.per_chunk_with(texts, given, cut, f"key {kind}, n_bytes long, n_removed long, n_spans long, kept binary")
    return out.withColumnRenamed("key", key)


def _spread(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All positions of the ranges, ends included."""
    sizes = high - low + 1
    total = int(sizes.sum())
    return np.repeat(low - np.append(0, np.cumsum(sizes)[:-1]) if len(low) else low, sizes) + np.arange(total)
