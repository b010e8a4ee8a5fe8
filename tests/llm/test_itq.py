import numpy as np
import pytest
from pyspark.sql import types as T

from earshot.llm import itq
from earshot.llm.q_itq import op4_itq
from graphs import least_reachable


def exact(rows, least=0.95):
    """Links and components by comparing all pairs."""
    good = {}
    for i, (_, v) in enumerate(rows):
        if v and all(c is not None and np.isfinite(c) for c in v) and any(v):
            x = np.array(v, float) / max(map(abs, v))
            good[i] = x / np.sqrt((x * x).sum())
    pairs = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= least]
    return pairs, good


def check(spark, rows, recall=1.0):
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("n", T.StringType())])
    df = spark.createDataFrame([(k, v, "clash") for k, v in rows], schema)
    out = sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in itq.near_duplicates(df).collect())
    pairs, _ = exact(rows)
    degree = np.zeros(len(rows), int)
    for a, b in pairs:
        degree[a] += 1
        degree[b] += 1
    if recall == 1.0:
        root = least_reachable([k for k, _ in rows], [(rows[a][0], rows[b][0]) for a, b in pairs])
        assert out == sorted((k, degree[i], root[k], root[k] == k) for i, (k, _) in enumerate(rows))
    assert sum(o[1] for o in out) >= recall * degree.sum()
    return out


def test_clusters_copies_and_odd_vectors(spark):
    rng = np.random.default_rng(5)
    rows = []
    for c in range(6):
        base = rng.normal(size=32)
        rows += [(len(rows) + i, (base + 0.02 * rng.normal(size=32)).tolist()) for i in range(12)]
    rows += [(len(rows) + i, rng.normal(size=32).tolist()) for i in range(100)]
    rows += [(1000 + i, rows[3][1]) for i in range(5)] + [(1010, [5 * c for c in rows[3][1]])]
    rows += [(2000, None), (2001, []), (2002, [0.0] * 32), (2003, [1.0, None] * 16), (2004, [float("nan")] * 32), (2005, [float("inf")] * 32), (2006, [1.0, 2.0]), (2007, [2.0, 4.0]), (2008, [1e200] * 32), (2009, [1e-200] * 32)]
    check(spark, rows)


def test_hot_bucket_is_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(itq, "BLOCK", 16)
    rng = np.random.default_rng(6)
    base = rng.normal(size=24)
    rows = [(i, (base + 0.01 * rng.normal(size=24)).tolist()) for i in range(150)] + [(200 + i, rng.normal(size=24).tolist()) for i in range(100)]
    check(spark, rows)


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(7)
    rows = []
    for c in range(150):
        base = itq.unit(rng.normal(size=(1, 64)))[0]
        side = rng.normal(size=64)
        side -= side @ base * base
        side /= np.linalg.norm(side)
        cos = rng.uniform(0.951, 0.99)
        rows += [(2 * c, base.tolist()), (2 * c + 1, (cos * base + np.sqrt(1 - cos * cos) * side).tolist())]
    check(spark, rows, recall=0.9)


def test_empty(spark):
    assert itq.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    pairs, _ = exact(rows)
    out = op4_itq(spark, sf).collect()
    assert len(out) == len(rows) and sum(r.n_links for r in out) == pytest.approx(2 * len(pairs), rel=0.02)
