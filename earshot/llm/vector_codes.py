"""Vector code compression: each vector becomes one byte per part, its nearest codebook entry.

Components are scaled by ``SCALE`` and floored, and everything after that is exact integer
arithmetic. Each of ``PARTS`` parts of a vector has its own codebook, which starts as that part
of the first vectors by key. A round assigns every part to its nearest entry (the lower index
of equal ones), found through a GNAT over the entries (gnat.py), and replaces each entry by
the floored mean of what was assigned to it; entries nothing was assigned to stay.

A round is one job: tasks add up what they assigned per part and entry, and only those sums,
at most PARTS * ENTRIES rows a task, are shuffled. The codebooks that go to the tasks
have PARTS * ENTRIES entries whatever the number of vectors.

Left out are vectors that are NULL, hold NULL or non-finite components, have another length
than the first one left in by key (NULL keys come last, equal ones by their vectors), or a
component beyond ``reach``, whose error no long could hold. A length that parts do not divide
is an error. Repeated rows are coded one by one. Fewer vectors than entries make shorter
codebooks; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.llm.gnat import Tree
from earshot.llm.tables import salted_join, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
BATCH = 4096  # vectors searched together


def reach(dims: int) -> int:
    """Least scaled component that is too large: below it, sums of squared differences stay within 2**62."""
    return math.isqrt((1 << 62) // dims) // 2


def usable(vector: Column, dims: int | None = None) -> Column:
    """Whether a vector is whole, finite and, with ``dims``, of that length and within reach."""
    x = vector.cast("array<double>")
    finite = F.forall(x, lambda v: F.coalesce(~F.isnan(v) & (F.abs(v) < float("inf")), F.lit(False)))
    ok = x.isNotNull() & (F.size(x) > 0) & finite
    if dims is not None:
        ok &= (F.size(x) == dims) & F.forall(x, lambda v: F.abs(v) * SCALE < reach(dims))
    return F.coalesce(ok, F.lit(False))


def scaled(vectors: list | pd.Series) -> np.ndarray:
    """Floored integer components, one row a vector."""
    return np.floor(np.stack([np.asarray(v, float) for v in vectors]) * SCALE).astype(np.int64)


def parted(rows: np.ndarray) -> list[np.ndarray]:
    return np.split(rows, PARTS, axis=1)


def first_codebooks(vectors: DataFrame, key: str, vector: str) -> list[np.ndarray]:
    """The parts of the first vectors by key; an empty list where there are none."""
    kept = vectors.where(usable(F.col(f"`{vector}`"))).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    by = [F.col("key").asc_nulls_last(), F.col("v")]
    head = kept.orderBy(*by).limit(1).collect()
    if not head:
        return []
    dims = len(head[0].v)
    if dims % PARTS:
        raise ValueError(f"vectors of {dims} components can't be cut into {PARTS} equal parts")
    rows = kept.where(usable(F.col("v"), dims)).orderBy(*by).limit(ENTRIES).collect()  # ENTRIES rows at most
    return parted(scaled([r.v for r in rows])) if rows else []


def next_codebooks(rows: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """One round: assign all vectors of column ``v`` and take floored means."""
    width = books[0].shape[1]
    sums = [f"s{i}" for i in range(width)]

    def add_up(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Tree(b) for b in books]
        totals = [np.zeros((len(b), width), object) for b in books]  # whole numbers of any size
        counts = [np.zeros(len(b), np.int64) for b in books]
        for pdf in batches:
            for i in range(0, len(pdf), BATCH):
                for part, x in enumerate(parted(scaled(pdf["v"].iloc[i:i + BATCH]))):
                    index, _, _ = trees[part].nearest(x)
                    counts[part] += np.bincount(index, minlength=len(books[part]))
                    order = np.argsort(index, kind="stable")
                    used, at = np.unique(index[order], return_index=True)
                    totals[part][used] += np.add.reduceat(x[order], at, axis=0).astype(object)
        for part, (total, count) in enumerate(zip(totals, counts)):
            some = np.flatnonzero(count)
            if len(some):
                yield pd.DataFrame({"part": part, "entry": some, "n": count[some]} | {s: [str(t) for t in total[some, i]] for i, s in enumerate(sums)})

    schema = "part int, entry int, n long, " + ", ".join(f"{s} string" for s in sums)
    found = rows.select("v").mapInPandas(add_up, schema).groupBy("part", "entry").agg(
        F.sum("n").alias("n"), *[F.sum(F.col(s).cast("decimal(38,0)")).alias(s) for s in sums]).collect()  # PARTS * ENTRIES rows at most
    out = [b.copy() for b in books]
    for r in found:
        out[r.part][r.entry] = [int(r[s]) // r.n for s in sums]
    return out


def assigned(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """The rows with ``code`` (hex, two digits a part) and ``error`` in place of their vector ``v``."""
    others = [f for f in rows.schema.fields if f.name != "v"]

    def code(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = [Tree(b) for b in books]
        for pdf in batches:
            for i in range(0, len(pdf), BATCH):
                some = pdf.iloc[i:i + BATCH]
                found = [trees[part].nearest(x) for part, x in enumerate(parted(scaled(some["v"])))]
                codes = np.stack([index for index, _, _ in found], axis=1).astype(np.uint8)
                yield some.drop(columns="v").assign(
                    code=[c.tobytes().hex() for c in codes], error=np.sum([best for _, best, _ in found], axis=0))

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in others] + ["code string", "error long"])
    return rows.mapInPandas(code, schema)


def fingerprint(books: list[np.ndarray]) -> str:
    """SHA-256 of all entries' components in decimal by part, entry and place."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> tuple[DataFrame, list[np.ndarray]]:
    """One row per vector left in (``key``, ``label``, code, error), and the codebooks."""
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in (key, label)}
    books = first_codebooks(vectors, key, vector)
    if not books:
        return vectors.sparkSession.createDataFrame([], f"`{key}` {kinds[key]}, `{label}` {kinds[label]}, code string, error long"), books
    dims = PARTS * books[0].shape[1]
    rows = vectors.where(usable(F.col(f"`{vector}`"), dims)).select(
        F.col(f"`{key}`").alias("key"), F.col(f"`{label}`").alias("label"), F.col(f"`{vector}`").cast("array<double>").alias("v"))
    for _ in range(ROUNDS):
        books = next_codebooks(rows, books)
    return assigned(rows, books).withColumnsRenamed({"key": key, "label": label}), books


def with_group_error(coded: DataFrame, label: str = "label", out: str = "label_error") -> DataFrame:
    """The rows with the errors of their label added up (NULL labels together).

    Errors are added before they are shuffled, and rows of one label are spread over salts.
    A sum that no long holds is NULL.
    """
    named = written(coded.withColumn("_group", F.struct(F.col(f"`{label}`"))))
    total = named.groupBy("_group").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("_sum")).select(
        "_group", F.expr("try_cast(_sum AS long)").alias(out))
    return salted_join(named.withColumn("_by", F.monotonically_increasing_id()), total, ["_group"], "_by").drop("_group", "_by")
