import random
import re
from collections import defaultdict

import numpy as np
import pytest

from earshot.llm import mixing
from earshot.llm.q_mixing import op2_mixing


def by_hand(sizes):
    """Targets by sharing again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    left, open_, goal = sum(sizes.values()), list(names), {}
    while open_:
        share = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if share * weight[s] > 3 * sizes[s]]
        if not full:
            return goal | {s: share * weight[s] for s in open_}
        for s in full:
            goal[s] = 3.0 * sizes[s]
            left -= goal[s]
        open_ = [s for s in open_ if s not in full]
    return goal


@pytest.mark.parametrize("sizes", [{"a": 100}, {"b": 10, "a": 1000, None: 5, "é": 70, "z": 400}, {"a": 0, "b": 0}, {f"s{i}": 3 ** i for i in range(9)}])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(k, v) for k, v in sizes.items()], "source string, source_size long")
    got = {r.source: r.target for r in mixing.targets(rows).collect()}
    assert got == pytest.approx(by_hand(sizes))


def mixed(spark, rows, documents):
    docs = documents(rows).withColumnRenamed("lang", "size").withColumnRenamed("n_chars", "rate")
    return mixing.mix(docs).collect()


def test_mix_meets_targets_and_tilts(spark, documents):
    rnd = random.Random(9)
    rows = [(i, "w " * int(rnd.paretovariate(1.2) * 5), "en", s, 1) for i, s in enumerate(rnd.choices(["a", "b", "c", None], [60, 25, 14, 1], k=1500))]
    rows += [(5000, None, "en", "a", 1), (5001, " \n", "en", None, 1), (None, "some words", "en", "b", 1), (5, rows[5][1], *rows[5][2:])]
    out = mixed(spark, rows, documents)
    assert len(out) == len(rows)
    have, goal, longest = defaultdict(int), {}, defaultdict(int)
    for r in out:
        assert r.taken == r.copies * r.size <= 3 * r.size
        have[r.source] += r.taken
        goal[r.source] = r.target
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(re.findall(r"\S+", r[1] or ""))
    assert goal == pytest.approx(by_hand(sizes))
    for s in goal:
        assert abs(have[s] - goal[s]) <= 10, (s, have[s], goal[s])
    # rates solve the dual: log rate is proportional to size where it is below the most
    for s in "ab":
        x = np.array([(r.size, r.rate) for r in out if r.source == s and 0 < r.rate < 3 and r.size > 0])
        t = np.log(x[:, 1]) / x[:, 0]
        assert np.ptp(t) <= 1e-9 * abs(t).max()
        assert sum(r.rate * r.size for r in out if r.source == s) == pytest.approx(goal[s], rel=1e-6)
    again = mixed(spark, list(reversed(rows)), documents)
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_hot_class_is_shared_exactly(spark, documents, monkeypatch):
    monkeypatch.setattr(mixing, "SLOT_ROWS", 50)
    rows = [(i, "same words here now", "en", "a", 1) for i in range(1000)] + [(i + 2000, "x y", "en", "b", 1) for i in range(100)]
    out = mixed(spark, rows, documents)
    have = sum(r.taken for r in out if r.source == "a")
    assert abs(have - out[0].target if out[0].source == "a" else 0) <= 4
    assert {r.copies for r in out if r.source == "b"} == {3} and len(out) == 1100


def test_empty(spark, documents):
    docs = documents([(1, "a b", "en", "s", 3)])
    assert mixing.mix(docs.limit(0)).count() == 0
    assert [(r.target, r.taken) for r in mixing.mix(documents([(1, None), (2, "")])).collect()] == [(0.0, 0), (0.0, 0)]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: (r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sizes = defaultdict(int)
    for s, n in texts.values():
        sizes[s] += n
    goal, have = by_hand(sizes), defaultdict(int)
    out = op2_mixing(spark, sf).collect()
    assert len(out) == len(texts)
    for r in out:
        s, n = texts[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[s]) and r.target == pytest.approx(goal[s]) and 0 <= r.taken <= 3 * n
        have[s] += r.taken
    print({s: (have[s], goal[s]) for s in goal})
    assert all(abs(have[s] - goal[s]) <= 0.05 * goal[s] for s in goal)
