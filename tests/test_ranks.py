import random
from statistics import quantiles

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import blocks, ranks, summaries
from earshot.params import Params
from earshot.session import cut_lineage


@pytest.fixture(scope="module")
def skewed(spark):
    """One group holds most rows; values tie and reach from 0 to 1e9."""
    rng = random.Random(3)
    rows = [("hot", float(int(rng.lognormvariate(3, 3)))) for _ in range(3000)]
    rows += [("cold", float(rng.randint(0, 5))) for _ in range(40)] + [(None, 1.0), (None, 2.0), ("hot", None)]
    return cut_lineage(spark.createDataFrame(rows, "k string, v double").repartition(4))


def expected_before(pdf):
    out = {}
    for k, g in pdf.dropna(subset=["v"]).groupby("k", dropna=False):
        values = np.sort(g.v.to_numpy())
        for v in np.unique(values):
            out[(k if isinstance(k, str) else None, v)] = int((values < v).sum())
    return out


@pytest.mark.parametrize("width", [None, 7.0])
def test_slotted_cumulative_is_exact(skewed, width):
    hist = ranks.histogram(skewed, ["k"], "v")
    got = ranks.cumulative(hist, ["k"], "v", width=width, rows=20, most=8, small=0).collect()
    plain = ranks.cumulative(hist, ["k"], "v").collect()
    want = expected_before(skewed.toPandas())
    assert {(r.k, r.v): r.before for r in got} == want
    assert {(r.k, r.v): (r.before, r.total) for r in got} == {(r.k, r.v): (r.before, r.total) for r in plain}


def test_slots_stay_small(skewed):
    hist = ranks.histogram(skewed, ["k"], "v")
    cut, slots = ranks._slotted(hist, ["k"], "v", None, 20, 50, 3)
    most = cut.groupBy("k", *slots).count().agg(F.max("count")).first()[0]
    assert most < hist.where("k = 'hot'").count() / 4


def test_quantiles_match_interpolation(skewed):
    got = ranks.cumulative(ranks.histogram(skewed, ["k"], "v"), ["k"], "v").groupBy("k").agg(
        *[ranks.quantile_from(p, "v").alias(f"q{i}") for i, p in enumerate((0.25, 0.5, 0.75))]).collect()
    pdf = skewed.toPandas()
    for r in got:
        values = pdf[pdf.k == r.k].v.dropna() if r.k else pdf[pdf.k.isna()].v
        assert [r.q0, r.q1, r.q2] == pytest.approx(list(np.quantile(values, [0.25, 0.5, 0.75])))


def test_midranks_average_ties(spark):
    df = cut_lineage(spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 3.0), ("a", None), ("b", 2.0)], "k string, v double"))
    got = {(r.k, r.v, r["rank"]) for r in ranks.midranks(df, ["k"], "v").collect()}
    assert got == {("a", 1.0, 1.5), ("a", 3.0, 3.0), ("a", None, None), ("b", 2.0, 1.0)}


@pytest.mark.parametrize("largest", [None, 10**9])
def test_numbered_both_ways(spark, largest):
    rows = [(k, i // 3, i) for k in ("x", None) for i in range(50)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "k string, t int, i int")
    got = ranks.numbered(df, ["k"], ["t", "i"], F.col("t").cast("long"), largest=largest).collect()
    assert len(got) == 100 and all(r.row == r.i + 1 and r.total == 50 for r in got)


def trial_rows(n, stim="BBN", day="2022-01-01", subject="Green 1"):
    return [(day, subject, "Male", stim, i) for i in range(n)]


@pytest.mark.parametrize("n,kept", [(0, 0), (9, 0), (10, 0), (19, 0), (20, 10), (21, 10), (45, 30)])
def test_first_and_partial_blocks_go(spark, n, kept):
    rows = trial_rows(n) + trial_rows(3, "noise?", subject="Green 9")
    df = spark.createDataFrame(rows, "Date string, ID string, Sex string, Stim string, i int")
    out = blocks.drop_first_block(df, ["i"], F.col("i")).collect()
    assert len(out) == kept
    assert sorted(r.i for r in out) == list(range(10, 10 + kept))
    assert {r.Blocks_trimmed for r in out} <= {kept // 10}
    assert blocks.unknown_stimuli(df, Params().block_sizes).first().n == 3


def test_trimmed_is_part_of_no_first_and_whole_blocks(spark):
    rows = trial_rows(65) + trial_rows(95, subject="Green 2") + trial_rows(300, "tone") + trial_rows(430, "tone", subject="Green 2")
    df = spark.createDataFrame(rows, "Date string, ID string, Sex string, Stim string, i int")
    first = {tuple(r)[:5] for r in blocks.drop_first_block(df, ["i"], F.col("i")).collect()}
    trimmed = blocks.trim_blocks(df, ["i"], F.col("i"), Params(min_blocks=5)).collect()
    assert {tuple(r)[:5] for r in trimmed} <= first
    sizes = {}
    for r in trimmed:
        sizes[(r.ID, r.Stim)] = sizes.get((r.ID, r.Stim), 0) + 1
    # Caps: noise 5 blocks, tones 6; noise recordings need 6 blocks as well, so only Green 2 stays.
    assert sizes == {("Green 2", "BBN"): 50, ("Green 1", "tone"): 240, ("Green 2", "tone"): 240}
    caps = blocks.block_caps(df).first()
    assert (caps.bbn_cap, caps.tone_cap) == (5, 6)


def test_describe_both_ways(spark, monkeypatch):
    rng = np.random.default_rng(5)
    values = np.round(rng.gamma(2.0, 50.0, 400), 1).tolist()
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 5.0), ("b", None)], "k string, v double")
    small = {r.k: r for r in summaries.describe(df, ["k"], "v").collect()}
    monkeypatch.setattr(summaries, "is_small", lambda hist: False)
    large = {r.k: r for r in summaries.describe(df, ["k"], "v", width=1.0).collect()}
    a, x = small["a"], np.sort(np.array(values))
    n, sd = len(x), x.std(ddof=1)
    assert a.n == n and a["mean"] == pytest.approx(x.mean()) and a.sd == pytest.approx(sd)
    assert a["median"] == pytest.approx(np.median(x)) and a.trimmed == pytest.approx(x[40:-40].mean())
    assert a.mad == pytest.approx(1.4826 * np.median(np.abs(x - np.median(x))))
    assert a["skew"] == pytest.approx(((x - x.mean()) ** 3).sum() / n / sd**3)
    assert a["kurtosis"] == pytest.approx(((x - x.mean()) ** 4).sum() / n / sd**4 - 3)
    assert small["b"].n == 1 and small["b"].sd is None and small["b"].se is None
    for k in small:
        for c in small[k].asDict():
            assert large[k][c] == pytest.approx(small[k][c]) if isinstance(small[k][c], float) else large[k][c] == small[k][c]


def test_box_and_outliers(spark):
    values = [1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 50.0, 50.0]
    df = spark.createDataFrame([("a", v) for v in values], "k string, v double")
    b = summaries.box(df, ["k"], "v").first()
    q1, q2, q3 = quantiles(values, n=4, method="inclusive")
    assert (b.lower, b.middle, b.upper) == pytest.approx((q1, q2, q3))
    assert (b.ymin, b.ymax, b.outliers) == (1.0, 6.0 if 50 > q3 + 1.5 * (q3 - q1) else 50.0, 2 if 50 > q3 + 1.5 * (q3 - q1) else 0)
    assert [(r.v, r["count"]) for r in summaries.outliers(df, ["k"], "v").collect()] == [(50.0, 2)]


def test_null_rules(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 2.0)], "k string, v double")
    got = {r.k: r.m for r in df.groupBy("k").agg(summaries.strict_mean("v").alias("m")).collect()}
    assert got == {"a": None, "b": 2.0}
    ids = spark.createDataFrame([("x",), (None,), ("x",), ("w",)], "ID string")
    r = ids.agg(summaries.distinct_count("ID").alias("n"), summaries.distinct_text("ID").alias("t")).first()
    assert (r.n, r.t) == (3, "NA, w, x")
    band = summaries.mean_se(df, ["k"], "v", limits=(0, 1.5)).collect()
    assert [(r.k, r.n, r.se) for r in band] == [("a", 1, None)]
