import hashlib
import math
import random

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.llm import vector_codes
from earshot.llm.gnat import Tree, squared


@settings(max_examples=120, deadline=None)
@given(st.integers(1, 80), st.integers(1, 5), st.integers(0, 3), st.integers(0, 10 ** 6))
def test_tree_is_exact(entries, width, spread, seed):
    """Few values, so that equal entries and equal distances are common."""
    rnd = np.random.default_rng(seed)
    table, queries = rnd.integers(-spread, spread + 1, (entries, width)), rnd.integers(-spread - 1, spread + 2, (50, width))
    index, best, _ = Tree(table).nearest(queries)
    gaps = squared(queries, table)
    assert index.tolist() == gaps.argmin(axis=1).tolist() and best.tolist() == gaps.min(axis=1).tolist()


def test_tree_leaves_out_subtrees_and_holds_large_numbers():
    rnd = np.random.default_rng(3)
    centres = rnd.integers(-(1 << 27), 1 << 27, (16, 4))
    table = centres.repeat(16, axis=0) + rnd.integers(-1000, 1000, (256, 4))
    queries = table[rnd.integers(0, 256, 2000)] + rnd.integers(-3, 4, (2000, 4))
    index, best, measured = Tree(table).nearest(queries)
    gaps = squared(queries, table)
    assert (index == gaps.argmin(axis=1)).all() and (best == gaps.min(axis=1)).all()
    assert measured < 0.4 * gaps.size


def brute(rows):
    """Plain Python rounds over (vec_id, vector, label)."""
    kept = sorted(((k, [math.floor(1024 * x) for x in v], l) for k, v, l in rows
                   if v is not None and all(x is not None and math.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    width = len(kept[0][1]) // 4
    part = lambda v, p: v[p * width:(p + 1) * width]
    books = [[part(v, p) for _, v, _ in kept[:256]] for p in range(4)]
    near = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))
    for _ in range(4):
        for p in range(4):
            groups = {}
            for _, v, _ in kept:
                groups.setdefault(near(part(v, p), books[p])[1], []).append(part(v, p))
            for i, g in groups.items():
                books[p][i] = [sum(c) // len(g) for c in zip(*g)]
    found = [(k, [near(part(v, p), books[p]) for p in range(4)], l) for k, v, l in kept]
    errors = {}
    for _, f, l in found:
        errors[l] = errors.get(l, 0) + sum(d for d, _ in f)
    digest = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    order = lambda r: (r[0] is None, r[0] or 0, r[1:3], r[3])
    return sorted(((k, "".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f), errors[l]) for k, f, l in found), key=order), digest


def coded(df):
    found, books = vector_codes.compress(df)
    rows = [(r.vec_id, r.code, r.error, r.label_error) for r in vector_codes.with_group_error(found).collect()]
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1:3], r[3])), vector_codes.fingerprint(books)


def test_equals_plain_rounds(spark):
    rnd = random.Random(4)
    rows = [(i, [rnd.choice([0.0, 0.001, -0.001, 0.5, rnd.uniform(-1, 1)]) for _ in range(8)], rnd.choice([None, 1, 2])) for i in range(700)]
    rows += [(None, rows[3][1], 1), (5, rows[9][1], None), (5, rows[5][1], 2)] + [rows[8]] * 200
    bad = [(-1, None, 1), (-2, [], 1), (-3, [0.1] * 7 + [None], 1), (-4, [0.1] * 7 + [math.nan], 1), (-5, [math.inf] * 8, 1)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>, label int").withColumn("code", F.lit("own")).repartition(6)
    assert coded(df) == brute(rows)


def test_few_and_none(spark):
    schema = "vec_id long, embedding array<float>, label int"
    rows = [(2, [0.5, 0.25, -0.5, 1.0], None), (9, [0.5, 0.25, -0.25, 1.0], None), (9, [1.0] * 8, None), (9, [3e38] * 4, 1)]
    assert coded(spark.createDataFrame(rows, schema))[0] == [(2, "00000000", 0, 0), (9, "00000100", 0, 0)]
    found, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert books == [] and vector_codes.with_group_error(found).count() == 0
