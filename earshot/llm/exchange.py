"""Chunks of texts, and finding values that several chunks share.

Texts are dealt to chunks of a few megabytes by the hash of their key and text; the number of
chunks follows the size of the input. A key that a third of the rows share is spread by its
texts. Rows equal in both go to one chunk, as nothing in them could tell them apart again when
a lost task is repeated. A chunk reduces what it found to sorted distinct values, so a
value costs one entry per chunk however often it occurs there. The entries go to buckets by
value, where equal ones meet, and each chunk gets back those of its values that count.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CHUNK_BYTES = 4_000_000
CHUNKS_PER_BUCKET = 8  # bounds what meets in a bucket to about this many chunks' entries
ENTRIES = "bucket int, chunk long, packed binary, flags binary"
HITS = "chunk long, packed binary"
ANCHOR, SEVERAL = 1, 2  # flags of an entry


def chunked(docs: DataFrame, key: str, text: str, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """(key, text, chunk), dealt by chunk, and the number of chunks. NULL texts are empty."""
    texts = docs.select(F.col(f"`{key}`").alias("key"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"))
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(1, math.ceil(total / chunk_bytes))
    return texts.withColumn("chunk", F.pmod(F.xxhash64("key", "text"), F.lit(n))).repartition("chunk"), n


def buckets_for(chunks: int) -> int:
    return max(1, math.ceil(chunks / CHUNKS_PER_BUCKET))


def packed(values: np.ndarray) -> bytes:
    """Ascending 64-bit values as differences, byte by byte, so that the zeros compress away."""
    steps = np.diff(values, prepend=np.uint64(0)).astype("<u8")
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.frombuffer(data, np.uint8).reshape(8, -1).T
    return np.cumsum(np.ascontiguousarray(steps).view("<u8").ravel(), dtype=np.uint64)


def distinct(values: np.ndarray, anchor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values, ascending, with flags: seen at an anchor, seen several times."""
    if not len(values):
        return values, np.zeros(0, np.uint8)
    order = np.argsort(values, kind="stable")
    v = values[order]
    at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    flags = np.where(np.diff(np.append(at, len(v))) > 1, SEVERAL, 0).astype(np.uint8)
    if anchor is not None:
        flags |= np.bitwise_or.reduceat(anchor[order].astype(np.uint8), at) * np.uint8(ANCHOR)
    return v[at], flags


def entries(chunk: int, values: np.ndarray, flags: np.ndarray, buckets: int, bits: int) -> pd.DataFrame:
    """Rows of ``ENTRIES`` for distinct values below 2**bits."""
    cuts = np.array([-(-(i << bits) // buckets) for i in range(1, buckets)], np.uint64)
    ends = [0, *np.searchsorted(values, cuts).tolist(), len(values)]
    rows = [(b, chunk, packed(values[i:j]), flags[i:j].tobytes()) for b, (i, j) in enumerate(zip(ends, ends[1:])) if j > i]
    return pd.DataFrame(rows, columns=["bucket", "chunk", "packed", "flags"])


def shared(rows: DataFrame, anchored: bool) -> DataFrame:
    """For each chunk, its values that occur more than once in all chunks (``HITS``).

    With ``anchored``, at least one of the occurrences must be at an anchor.
    """
    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [unpacked(p) for p in pdf["packed"]]
        values = np.concatenate(parts)
        flags = np.frombuffer(b"".join(pdf["flags"]), np.uint8)
        order = np.argsort(values, kind="stable")
        v, f = values[order], flags[order]
        at = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
        sizes = np.diff(np.append(at, len(v)))
        any_flag = np.bitwise_or.reduceat(f, at)
        good = (sizes > 1) | (any_flag & SEVERAL > 0)
        if anchored:
            good &= any_flag & ANCHOR > 0
        hit = np.zeros(len(v), bool)
        hit[order] = np.repeat(good, sizes)
        bounds = np.cumsum([0, *map(len, parts)])
        out = [(c, packed(p[hit[i:j]])) for c, p, i, j in zip(pdf["chunk"], parts, bounds, bounds[1:]) if hit[i:j].any()]
        return pd.DataFrame(out, columns=["chunk", "packed"])

    return rows.groupBy("bucket").applyInPandas(meet, HITS)


def hits_of(rows: pd.DataFrame) -> np.ndarray:
    """The values given back to a chunk, ascending."""
    return np.sort(np.concatenate([unpacked(p) for p in rows["packed"]])) if len(rows) else np.zeros(0, np.uint64)


def contains(hits: np.ndarray, values: np.ndarray) -> np.ndarray:
    if not len(hits):
        return np.zeros(len(values), bool)
    return hits[np.minimum(np.searchsorted(hits, values), len(hits) - 1)] == values


def per_chunk(texts: DataFrame, work, schema: str) -> DataFrame:
    """``work(chunk, its rows)`` for each chunk."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return work(int(pdf["chunk"].iloc[0]), pdf)

    return texts.groupBy("chunk").applyInPandas(run, schema)


def per_chunk_with(texts: DataFrame, given: DataFrame, work, schema: str) -> DataFrame:
    """``work(chunk, its rows, the rows given back to it)`` for each chunk."""
    empty = [f.split()[0] for f in schema.split(", ")]

    def run(pdf: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        return work(int(pdf["chunk"].iloc[0]), pdf, back) if len(pdf) else pd.DataFrame(columns=empty)

    return texts.groupBy("chunk").cogroup(given.groupBy("chunk")).applyInPandas(run, schema)
