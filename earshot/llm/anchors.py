"""Substring dedup over words, by fixed-block anchors.

Every text is cut into blocks of ``block`` words, one after the other, which are the index.
All rolling windows of that many words probe it. A window of ``window`` >= 2 * block - 1
words holds a whole block, and if it is repeated, a rolling window elsewhere equals that
block; so where a block is hit by nothing, no window around it is repeated. Hits are extended
to the windows around them, windows that occur again anywhere are kept, and runs of these are
the maximal exact repeats, whose words are removed.

Probes are compared by 44 bits of their hash, which only decides what is looked at again;
windows by 64 bits. A repeated passage costs one entry per chunk of texts (see exchange.py).
Windows are judged on the input. NULL, empty and short texts keep all their words.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from earshot.llm import bytewords, exchange

PROBE_BITS = 44


class Chunk:
    """Hashes of runs of words in some texts."""

    def __init__(self, texts: pd.Series) -> None:
        self.raws = [t.encode() for t in texts]
        self.w = w = bytewords.Words(self.raws)
        self.n = len(w.start)
        self.hashes = bytewords.Rolling(w.hashes(w.start, w.end))
        self.begin = np.repeat(w.bound[:-1], w.counts)  # first word of each word's text, and the one after its last
        self.stop = np.repeat(w.bound[1:], w.counts)

    def runs(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Where runs of ``size`` words start, and their hashes."""
        at = np.flatnonzero(np.arange(self.n) + size <= self.stop)
        return at, self.hashes(at, at + size)


def remove_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = 35, chunk_bytes: int = exchange.CHUNK_BYTES) -> DataFrame:
    """One row per input row: ``key``, n_words, n_removed, n_repeats (maximal), kept (words joined by a space)."""
    block = (window + 1) // 2
    texts, chunks = exchange.chunked(docs, key, text, chunk_bytes)
    buckets = exchange.buckets_for(chunks)

    def probes(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
        at, h = c.runs(block)
        return at, h >> np.uint64(64 - PROBE_BITS)

    def probe(chunk: int, pdf: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(pdf["text"])
        at, values = probes(c)
        return exchange.entries(chunk, *exchange.distinct(values, (at - c.begin[at]) % block == 0), buckets, PROBE_BITS)

    def windows(chunk: int, pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(pdf["text"])
        at, values = probes(c)
        hit = np.zeros(c.n + 1, bool)
        hit[at] = exchange.contains(exchange.hits_of(back), values)
        at, h = c.runs(window)
        anchor = at + (c.begin[at] - at) % block  # the first block that starts in the window
        return exchange.entries(chunk, *exchange.distinct(h[hit[anchor]]), buckets, 64)

    def cut(chunk: int, pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(pdf["text"])
        at, h = c.runs(window)
        repeated = np.zeros(c.n + 1, bool)
        repeated[at] = exchange.contains(exchange.hits_of(back), h)
        reach = np.maximum.accumulate(np.where(repeated[:-1], np.arange(c.n) + window, 0)) if c.n else np.zeros(0, np.int64)
        gone = reach > np.arange(c.n)
        # a new maximal repeat starts where the window before is not repeated
        fresh = np.append(0, np.cumsum(repeated[:-1] & ~np.append(False, repeated[:-2] & (c.begin[1:] == c.begin[:-1])))) if c.n else np.zeros(1, np.int64)
        lost = np.append(0, np.cumsum(gone))
        b = c.w.bound
        removed = lost[b[1:]] - lost[b[:-1]]
        kept = []
        for i, raw in enumerate(c.raws):
            words = raw.split()
            if removed[i]:
                words = [w for w, g in zip(words, gone[b[i]:b[i + 1]].tolist()) if not g]
            kept.append(b" ".join(words).decode())
        return pd.DataFrame({"key": pdf["key"].array, "n_words": c.w.counts, "n_removed": removed, "n_repeats": fresh[b[1:]] - fresh[b[:-1]], "kept": kept})

    kind = texts.schema["key"].dataType.simpleString()
    hits = exchange.shared(exchange.per_chunk(texts, probe, exchange.ENTRIES), anchored=True)
    again = exchange.shared(exchange.per_chunk_with(texts, hits, windows, exchange.ENTRIES), anchored=False)
    out = exchange.per_chunk_with(texts, again, cut, f"key {kind}, n_words long, n_removed long, n_repeats long, kept string")
    return out.withColumnRenamed("key", key)
