"""SimHash near-duplicates: one fingerprint a text, blocks for close pairs, components.

A fingerprint bit is set where more than half of the text's shingle hashes have it; a
shingle is ``shingle`` words (fewer words: all of them), lower-cased A-Z, joined by
spaces, hashed by XXH64 with seed 42. NULL and wordless texts have fingerprint zero.

Fingerprints that differ in at most two bits agree in three of five blocks, so each goes
to the ten buckets named by three of its blocks. A bucket's members agree but for the
bits outside its blocks; two of them are close where both are at most one bit from the
same value. Members are therefore grouped by these values, which costs a fixed number of
rows each however many share the bucket, and each one is linked to the least of its
group once the Hamming distance is verified. These links connect exactly what all close
pairs connect. Copies share a fingerprint and are only counted in once.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.components import components
from earshot.llm.shingles import SEED, shingles
from earshot.llm.tables import fresh, row_id, salted_join, written

BLOCKS = [(0, 13), (13, 26), (26, 39), (39, 52), (52, 64)]  # bit ranges
DISTANCE = 2  # bits; five blocks are made for it


def fingerprints(texts: list, shingle: int) -> np.ndarray:
    """Fingerprints of some texts as signed 64-bit integers."""
    counts = np.zeros(len(texts), np.int64)
    hashes: list[int] = []
    for i, text in enumerate(texts):
        parts = shingles(text, shingle)
        hashes.extend(map(xxhash.xxh64_intdigest, parts, repeat(SEED)))
        counts[i] = len(parts)
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        first = np.concatenate([[0], np.cumsum(counts[some])[:-1]])
        h = np.array(hashes, np.uint64)
        for bit in range(64):
            ones = np.add.reduceat((h >> np.uint64(bit)) & np.uint64(1), first, dtype=np.int64)
            out[some] |= (2 * ones > counts[some]).astype(np.uint64) << np.uint64(bit)
    return out.view(np.int64)


def fingerprint_column(shingle: int):
    """A column function: text to fingerprint (long)."""
    def of_texts(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            rows, parts = texts.tolist(), []
            for i in range(0, len(rows), 500):
                parts.append(fingerprints(rows[i:i + 500], shingle))
            yield pd.Series(np.concatenate(parts) if parts else np.zeros(0, np.int64))

    of_texts.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(of_texts, "long")


def close_links(fps: DataFrame) -> DataFrame:
    """Edges (a, b) between distinct fingerprints of column ``fp`` that connect all close ones."""
    masks = [sum((1 << hi) - (1 << lo) for lo, hi in kept) for kept in combinations(BLOCKS, len(BLOCKS) - DISTANCE)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    keys = fps.select("fp", F.explode(F.array(*[
        F.struct(F.lit(i).alias("table"), F.col("fp").bitwiseAND(F.lit(m)).alias("block")) for i, m in enumerate(signed)
    ])).alias("k")).select("fp", "k.table", "k.block")
    shared = keys.groupBy("table", "block").agg(F.count("*").alias("n")).where("n > 1").drop("n")
    free = F.array(*[F.array(*[F.lit(1 << b if b < 63 else -(1 << 63)) for b in range(64) if not m >> b & 1]) for m in masks])
    near = keys.join(shared, ["table", "block"]).select(
        "fp", "table",
        F.explode(F.concat(F.array("fp"), F.transform(free[F.col("table")], lambda bit: F.col("fp").bitwiseXOR(bit)))).alias("value"),
    )
    least = near.groupBy("table", "value").agg(F.min("fp").alias("b"), F.count("*").alias("n")).where("n > 1").drop("n")
    return near.join(least, ["table", "value"]).where(
        (F.col("fp") != F.col("b")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("b"))) <= DISTANCE)
    ).select(F.col("fp").alias("a"), "b").distinct()


def _named(fps: DataFrame) -> DataFrame:
    """One row per distinct fingerprint of column ``fp`` with its component."""
    found = components(close_links(fps))
    return fps.join(found, fps["fp"] == found["node"], "left").select("fp", F.coalesce("component", "fp").alias("component"))


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row per input row: ``key``, fp and component_id, the least key reachable by links."""
    rows = written(docs.select(F.col(key).alias("key"), fingerprint_column(shingle)(F.col(f"`{text}`").cast("string")).alias("fp")))
    reps = rows.groupBy("fp").agg(F.min("key").alias("least"))
    named = reps.join(_named(reps.select("fp")), "fp")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    labels = written(named.join(least, "component").select("fp", "component_id"))
    # copies share a fingerprint, and a third of all rows may be copies of one text
    spread = rows.withColumn("by", F.monotonically_increasing_id())
    return salted_join(spread, labels, ["fp"], "by").select(F.col("key").alias(key), "fp", "component_id")


def first_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """One row of each group, the first by key (NULL last) and hash of the row, all columns as they are.

    Groups are the components of the links of ``groups``, whatever their keys: rows with a NULL
    key or the key of another group stay apart.
    """
    mark = fresh(docs, "row")
    keyed = docs.withColumn(mark, row_id(docs))
    rows = written(keyed.select(
        F.col(f"`{key}`").alias("key"), F.col(mark).alias("row"), fingerprint_column(shingle)(F.col(f"`{text}`").cast("string")).alias("fp")))
    place = F.struct(F.col("key").isNull().alias("last"), "key", "row")
    first = rows.groupBy("fp").agg(F.min(place).alias("p")).join(_named(rows.select("fp").distinct()), "fp").groupBy("component").agg(
        F.min("p").alias("p"))
    keep = first.select(F.col("p.row").alias(mark))
    # what is kept twice is the same row
    return keyed.join(keep, mark, "left_semi").dropDuplicates([mark]).select(*docs.columns)
