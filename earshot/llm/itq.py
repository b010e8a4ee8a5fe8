"""Embedding near-duplicates: binary codes by iterative quantisation, Hamming tables, rerank.

A rotation of the leading principal directions is learned so that signs lose as little as
possible (iterative quantisation), on at most ``SAMPLE`` vectors: the index is fitted on a
bounded sample, every vector is indexed. A code is cut into substrings of ``SUB_BITS``; each
is a table. A vector is entered in a table under its substring and under the ``FLIPS``
variants with one of its least certain bits turned, so that pairs also meet that differ there.
Members of a bucket are reranked by the cosine of the original vectors in double precision.

Equal vectors form one class with a count. A bucket of more than ``BLOCK`` classes is cut
into blocks by hash, and every two blocks are compared in a place of their own, so no task
holds a whole hot bucket. A pair that meets in several places counts in the first of its
common keys only. Places give back sums and a spanning forest of their links, not pairs.

Vectors that are NULL, empty, zero, or hold NULL or non-finite components link with nothing;
vectors of different lengths do not link. Rows without a key (NULL) count as other vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from earshot.llm.components import components
from earshot.llm.tables import salted_join, written

SAMPLE = 20_000  # vectors that the rotation is fitted on
MOST_BITS = 64
SUB_BITS = 16
FLIPS = 3
ROUNDS = 50
BLOCK = 512
SEED = 11


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, without overflow on the way."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def fit_rotation(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and projection to code dimensions, from unit vectors."""
    rng = np.random.default_rng(SEED)
    dim = x.shape[1]
    bits = min(MOST_BITS, dim)
    mean = x.mean(0)
    _, vectors = np.linalg.eigh((x - mean).T @ (x - mean))
    top = vectors[:, ::-1][:, :bits]
    v = (x - mean) @ top
    turn = np.linalg.qr(rng.normal(size=(bits, bits)))[0]
    for _ in range(ROUNDS):
        codes = np.where(v @ turn > 0, 1.0, -1.0)
        left, _, right = np.linalg.svd(codes.T @ v)
        turn = right.T @ left.T
    return mean, top @ turn


def keys_of(z: np.ndarray) -> np.ndarray:
    """Table keys from code dimensions: for each substring its value and ``FLIPS`` variants; the table is in the upper bits."""
    out = []
    for t in range(math.ceil(z.shape[1] / SUB_BITS)):
        part = z[:, t * SUB_BITS:(t + 1) * SUB_BITS]
        weight = 1 << np.arange(part.shape[1], dtype=np.int64)
        own = (part > 0) @ weight
        turned = np.argsort(np.abs(part), axis=1, kind="stable")[:, :FLIPS]
        out.append(np.concatenate([own[:, None], own[:, None] ^ weight[turned]], axis=1) | t << SUB_BITS)
    return np.concatenate(out, axis=1)


def first_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least key that the rows of both matrices share (rows that share one)."""
    same = a[:, :, None] == b[:, None, :]
    return np.where(same.any(2), a, np.iinfo(a.dtype).max).min(1)


def links_in_places(g: np.ndarray, key: np.ndarray, node: np.ndarray, n: np.ndarray, x: np.ndarray, keys: np.ndarray, block: np.ndarray, crossing: np.ndarray, least: float):
    """Links of one batch of sorted places: (node, copies linked to it, least node linked through the batch)."""
    m = len(g)
    degree, label = np.zeros(m, np.int64), node.copy()
    left, right = [], []
    d = 1
    while d < m:
        a = np.flatnonzero(g[:-d] == g[d:])
        if not len(a):
            break
        b = a + d
        ok = ~crossing[a] | (block[a] != block[b])
        a, b = a[ok], b[ok]
        for i in range(0, len(a), 50_000):
            p, q = a[i:i + 50_000], b[i:i + 50_000]
            near = np.einsum("ij,ij->i", x[p], x[q]) >= least
            p, q = p[near], q[near]
            mine = first_common(keys[p], keys[q]) == key[p] if len(p) else np.zeros(0, bool)
            left.append(p[mine])
            right.append(q[mine])
        d += 1
    a, b = (np.concatenate(side) if side else np.zeros(0, np.int64) for side in (left, right))
    np.add.at(degree, a, n[b])
    np.add.at(degree, b, n[a])
    while True:  # labels spread along the links until they are the least of their part
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        if (label == before).all():
            break
    some = degree > 0
    return node[some], degree[some], label[some]


def near_duplicates(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", least: float = 0.95) -> DataFrame:
    """One row per input row: ``key``, n_links, component_id (least key reachable, itself included), kept."""
    v = F.col(f"`{vector}`").cast("array<double>")
    good = F.coalesce(~F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))) & F.exists(v, lambda c: c != 0), F.lit(False))
    vectors = rows.select(F.col(f"`{key}`").alias("key"), F.when(good, v).alias("v"))
    vectors = vectors.withColumn("same", F.when(F.col("v").isNotNull(), F.md5(F.to_json(F.struct(F.transform("v", lambda c: c + 0.0).alias("v"))))))
    classes = vectors.where("same IS NOT NULL").groupBy("same").agg(F.first("v").alias("v"), F.count("*").alias("n"))
    classes = written(classes.select(F.xxhash64("same").alias("node"), "same", "v", "n", F.size("v").alias("dim")))
    models = _fitted(classes)

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for dim, part in pdf.groupby("dim"):
                x = unit(np.stack(part["v"].to_numpy()).astype(float))
                mean, projection = models[dim] if dim in models else (0.0, np.random.default_rng(SEED).normal(size=(dim, min(MOST_BITS, dim))))
                yield pd.DataFrame({
                    "node": part["node"].array, "n": part["n"].array, "dim": part["dim"].array,
                    "x": [r.tobytes() for r in x], "keys": list(keys_of((x - mean) @ projection)),
                })

    entered = classes.select("node", "n", "dim", "v").mapInPandas(coded, "node long, n long, dim int, x binary, keys array<long>")
    entered = written(entered)
    placed = entered.select("node", "dim", F.explode("keys").alias("at"))
    full = written(placed.groupBy("dim", "at").agg(F.count("*").alias("size")).where(F.col("size") > BLOCK).select(
        "dim", "at", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")))
    each = entered.withColumn("at", F.explode("keys")).join(full, ["dim", "at"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    each = each.withColumn("block", F.pmod(F.xxhash64("node", F.lit(SEED)), F.col("blocks")).cast("int"))
    each = each.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = ["dim", "at", "i", "j"]
    each = each.select("node", "n", "x", "keys", "block", "dim", "at", F.least("block", "other").cast("int").alias("i"), F.greatest("block", "other").cast("int").alias("j"))

    def compared(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in frames:
            if held is not None:
                pdf = pd.concat([held, pdf], ignore_index=True)
            new = (pdf[place].diff().fillna(1) != 0).any(axis=1).to_numpy()
            last = int(np.flatnonzero(new)[-1])
            held = pdf.iloc[last:].reset_index(drop=True)
            if last:
                yield found(pdf.iloc[:last], new[:last])
        if held is not None:
            yield found(held, np.arange(len(held)) == 0)

    def found(pdf: pd.DataFrame, new: np.ndarray) -> pd.DataFrame:
        g = np.cumsum(new)
        alone = np.bincount(g)[g] == 1
        pdf, g = pdf[~alone], g[~alone]
        parts = []
        for dim, idx in pdf.reset_index(drop=True).groupby("dim").groups.items():
            p, gg = pdf.iloc[idx], g[idx]
            x = np.frombuffer(b"".join(p["x"]), float).reshape(-1, dim)
            parts.append(links_in_places(gg, p["at"].to_numpy(), p["node"].to_numpy(), p["n"].to_numpy(), x, np.stack(p["keys"].to_numpy()), p["block"].to_numpy(), (p["i"] != p["j"]).to_numpy(), least))
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * 3
        return pd.DataFrame(dict(zip(["node", "links", "label"], cols)))

    linked = written(each.repartition(*place).sortWithinPartitions(*place).mapInPandas(compared, "node long, links long, label long"))
    counts = linked.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(linked.where("node <> label").select(F.col("node").alias("a"), F.col("label").alias("b")).distinct())
    of_class = classes.select("node", "same", "n").join(counts, "node", "left").join(parts, "node", "left").select(
        "same", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    of_class = written(of_class)
    turn = F.xxhash64("key")
    named = written(salted_join(vectors.where("same IS NOT NULL").select("key", "same", turn.alias("turn")), of_class, ["same"], "turn"))
    least_key = written(named.groupBy("component").agg(F.min("key").alias("component_id")))
    out = salted_join(named, least_key, ["component"], "turn").select("key", "n_links", "component_id")
    rest = vectors.where("same IS NULL").select("key", F.lit(0).cast("long").alias("n_links"), F.col("key").alias("component_id"))
    out = out.unionByName(rest)
    return out.select(F.col("key").alias(key), "n_links", "component_id", F.col("key").eqNullSafe(F.col("component_id")).alias("kept"))


def _fitted(classes: DataFrame) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """The rotation for the most frequent length, from the ``SAMPLE`` vectors with the least hashes."""
    dims = classes.groupBy("dim").count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return {}
    dim = dims[0]["dim"]
    sample = classes.where(F.col("dim") == dim).orderBy("node").limit(SAMPLE).select("v").toPandas()
    x = unit(np.stack(sample["v"].to_numpy()).astype(float))
    return {dim: fit_rotation(x)}
