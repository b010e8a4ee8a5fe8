import math
from statistics import NormalDist

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from earshot.functions import tails
from earshot.operators import gaussian, linear, ranktests


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(1)
    n = 240
    pdf = pd.DataFrame({
        "a": rng.choice(list("xyz"), n, p=[0.5, 0.3, 0.2]), "b": rng.choice(list("pq"), n, p=[0.7, 0.3]),
        "z": rng.normal(size=n).round(1), "g": rng.choice(["u", "v"], n),
    })
    pdf["y"] = pdf.z * 2 + (pdf.a == "x") * 1.5 + (pdf.b == "p") * pdf.z + rng.standard_t(3, size=n)
    return pdf


@pytest.fixture(scope="module")
def table(spark, frame):
    return spark.createDataFrame(frame).repartition(5).cache()


TERMS = linear.crossed("a", "b", "z")


def rss(x, y):
    return ((y - x @ np.linalg.lstsq(x, y, rcond=None)[0]) ** 2).sum()


def test_sequential_anova(table, frame):
    design = linear.Design(TERMS, {"a": list("xyz"), "b": list("pq")})
    x, y = design.matrix(frame), frame.y.to_numpy()
    owner = np.array([i for i, _ in design.columns])
    got = linear.anova(table, "y", TERMS, ["a", "b"]).orderBy("position").collect()
    before = rss(x[:, owner < 0], y)
    for i, r in enumerate(got[:-1]):
        after = rss(x[:, owner <= i], y)
        assert r.sum_sq == pytest.approx(before - after, rel=1e-8) and r.df == (owner == i).sum()
        before = after
    assert got[-1].term == "Residuals" and got[-1].df == len(y) - len(design) and got[-1].sum_sq == pytest.approx(before)
    assert got[0].p == pytest.approx(tails.f_upper(got[0].f, got[0].df, got[-1].df))


def test_empty_cells_lose_degrees_of_freedom(spark):
    rows = [("x", "p", 1.0), ("x", "p", 2.0), ("x", "q", 4.0), ("x", "q", 3.0), ("y", "p", 5.0), ("y", "p", 7.0)]
    got = linear.anova(spark.createDataFrame(rows, "a string, b string, y double"), "y", linear.crossed("a", "b"), ["a", "b"]).collect()
    assert [(r.term, r.df) for r in sorted(got, key=lambda r: r.position)] == [("a", 1), ("b", 1), ("Residuals", 3)]


def test_coefficients_and_residuals(spark, table, frame):
    design = linear.Design(TERMS, {"a": list("xyz"), "b": list("pq")})
    x, y = design.matrix(frame), frame.y.to_numpy()
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    got = linear.coefficients(table, "y", TERMS, ["a", "b"]).orderBy("position").collect()
    assert [r.estimate for r in got] == pytest.approx(list(beta))
    ms = rss(x, y) / (len(y) - x.shape[1])
    assert [r.std_error for r in got] == pytest.approx(list(np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * ms)))
    left = linear.residuals(table, "y", TERMS, ["a", "b"]).toPandas().residual
    assert np.sort(left) == pytest.approx(np.sort(y - x @ beta))
    assert got[1].coefficient == "ay" and got[-1].coefficient == "az:bq:z"


def test_models_per_key(table, frame):
    got = linear.coefficients(table, "y", [("z",)], {}, ["g"]).collect()
    for g, part in frame.groupby("g"):
        slope, base = np.polyfit(part.z, part.y, 1)
        values = {r.coefficient: r.estimate for r in got if r.g == g}
        assert values == pytest.approx({"(Intercept)": base, "z": slope})


def test_tukey_first_term_uses_level_means(table, frame):
    got = linear.tukey(table, "y", TERMS, ["a", "b"], "a", ordered=True).collect()
    means = frame.groupby("a").y.mean()
    assert len(got) == 3 and all(r.estimate > 0 for r in got)
    for r in got:
        high, low = r.contrast.split("-")
        assert r.estimate == pytest.approx(means[high] - means[low])
        assert (r.lower > 0) == (r.p < 0.05)


def test_tukey_second_term_uses_what_the_term_adds(table, frame):
    """Unbalanced: means of the fitted part of b beyond a, around the grand mean."""
    terms = linear.crossed("a", "b")
    r = linear.tukey(table, "y", terms, ["a", "b"], "b").first()
    xa = np.column_stack([np.ones(len(frame))] + [(frame.a == l).astype(float) for l in "yz"])
    xb = np.column_stack([xa, (frame.b == "q").astype(float)])
    fit = lambda x: x @ np.linalg.lstsq(x, frame.y.to_numpy(), rcond=None)[0]
    part = pd.Series(fit(xb) - fit(xa)).groupby(frame.b.to_numpy()).mean()
    assert r.estimate == pytest.approx(part["q"] - part["p"])


def test_levels_and_rows_of_a_model(spark):
    many = spark.range(500).select(F.col("id").cast("string").alias("k"))
    assert len(linear.levels_of(many, "k")) == 500
    # rows of a level that is not listed take no part
    rows = [("a", 1.0), ("a", 3.0), ("b", 5.0), ("b", 9.0), ("c", 100.0), ("c", 130.0)]
    df = spark.createDataFrame(rows, "g string, y double")
    listed = linear.anova(df, "y", [("g",)], {"g": ["a", "b"]}).collect()
    assert [(r.df, r.sum_sq) for r in listed] == [(1, pytest.approx(25.0)), (2, pytest.approx(10.0))]
    left = linear.residuals(df, "y", [("g",)], {"g": ["a", "b"]}).collect()
    assert sorted((r.g, round(r.residual, 9)) for r in left) == [("a", -1.0), ("a", 1.0), ("b", -2.0), ("b", 2.0)]


def test_kruskal_and_ranksum_with_ties(spark, frame):
    pdf = frame.assign(v=frame.y.round(0))
    df = spark.createDataFrame(pdf)
    ranks, n = pdf.v.rank(), len(pdf)
    t = pdf.v.value_counts()
    h = 12 / (n * (n + 1)) * sum(ranks[pdf.a == l].sum() ** 2 / (pdf.a == l).sum() for l in "xyz") - 3 * (n + 1)
    h /= 1 - (t**3 - t).sum() / (n**3 - n)
    got = ranktests.kruskal(df, "v", "a").first()
    assert (got.n, got.df) == (n, 2) and got.h == pytest.approx(h) and got.p == pytest.approx(math.exp(-h / 2))
    for r in ranktests.ranksum(df, ["a"], "v", "b", "p", "q").collect():
        part = pdf[pdf.a == r.a]
        rk, n1, n2 = part.v.rank(), (part.b == "p").sum(), (part.b == "q").sum()
        w = rk[part.b == "p"].sum() - n1 * (n1 + 1) / 2
        m, c = n1 + n2, part.v.value_counts()
        z = (w - n1 * n2 / 2 - 0.5) / math.sqrt(n1 * n2 / 12 * (m + 1 - (c**3 - c).sum() / (m * (m - 1))))
        assert (r.n1, r.n2, r.w) == (n1, n2, w) and r.p == pytest.approx(0.5 * math.erfc(z / math.sqrt(2)))


def test_rank_tests_with_slots(spark, frame, monkeypatch):
    from earshot.operators import ranks
    df = spark.createDataFrame(frame)
    plain = ranktests.kruskal(df, "y", "a").first()
    monkeypatch.setattr(ranks, "is_small", lambda hist, entries=0: False)
    assert tuple(ranktests.kruskal(df, "y", "a", width=0.5).first()) == pytest.approx(tuple(plain))
    assert tuple(ranktests.kruskal(df, "y", "a").first()) == pytest.approx(tuple(plain))


def test_bh(spark):
    ps = [0.01, 0.02, 0.02, 0.9, 0.04, None]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    got = {r.i: r.BH for r in ranktests.adjust_bh(df, "p").collect()}
    m = 5
    want = {0: 0.1 / 3, 1: 0.1 / 3, 2: 0.1 / 3, 4: 0.04 * m / 4, 3: 0.9}
    assert got.pop(5) is None
    assert got == pytest.approx(want | {0: min(0.01 * m, 0.02 * m / 3)})
    assert all(got[i] >= ps[i] for i in got)


def test_bh_in_slots_equals_one_window(spark):
    rng = np.random.default_rng(6)
    rows = [(i, int(f), None if u < 0.02 else float(round(p, 3))) for i, (f, p, u) in enumerate(zip(
        rng.integers(0, 3, 900), rng.beta(0.4, 2, 900), rng.random(900)))]
    df = spark.createDataFrame(rows, "i int, f int, p double")
    whole = {r.i: r.BH for r in ranktests.adjust_bh(df, "p", ["f"]).collect()}
    cut = ranktests.adjust_bh(df, "p", ["f"], slot_values=40)
    assert {r.i: r.BH for r in cut.collect()} == pytest.approx(whole)
    for f in range(3):
        own = sorted((p, i) for i, g, p in rows if g == f and p is not None)
        least = 1.0
        for rank in range(len(own), 0, -1):
            p, i = own[rank - 1]
            least = min(least, p * len(own) / rank)
            assert whole[i] == pytest.approx(least)
    assert all((whole[i] is None) == (p is None) for i, _, p in rows)


def test_shapiro_of_sliced_ties(spark, monkeypatch):
    rng = np.random.default_rng(7)
    df = spark.createDataFrame([(float(v),) for v in np.append(rng.integers(0, 30, 200), np.full(150, 12))], "y double")
    plain = tuple(ranktests.shapiro(df, "y").first())
    monkeypatch.setattr(ranktests, "SLICE", 7)
    assert tuple(ranktests.shapiro(df, "y").first()) == pytest.approx(plain)


def test_shapiro(spark):
    # Values with published W = 0.79 and p about 0.0067 (Royston's example of men's weights).
    weights = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    df = spark.createDataFrame([("w", float(v)) for v in weights] + [("two", 1.0), ("two", 2.0)], "k string, v double")
    got = {r.k: r for r in ranktests.shapiro(df, "v", ["k"]).collect()}
    assert got["w"].W == pytest.approx(0.79, abs=0.005) and got["w"].p == pytest.approx(0.0067, abs=5e-4)
    assert got["two"].n == 2 and got["two"].W is None and got["two"].p is None
    # W of any size, ties included, by its definition
    n = 6001
    x = np.sort(np.floor(np.random.default_rng(4).normal(size=n) * 50))
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    a = m / np.sqrt(m @ m)
    ends = [np.polyval(c[::-1], 1 / np.sqrt(n)) + e for c, e in ((ranktests.OUTER, a[-1]), (ranktests.NEXT, a[-2]))]
    phi = (m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * ends[0] ** 2 - 2 * ends[1] ** 2)
    a = m / np.sqrt(phi)
    a[-1], a[-2], a[0], a[1] = ends[0], ends[1], -ends[0], -ends[1]
    big = ranktests.shapiro(spark.createDataFrame([(v,) for v in x.tolist()], "v double"), "v").first()
    assert big.n == n and big.W == pytest.approx((a @ x) ** 2 / ((x - x.mean()) ** 2).sum(), abs=1e-9) and 0 <= big.p <= 1
    three = spark.createDataFrame([(1.0,), (2.0,), (3.0,)], "v double")
    assert ranktests.shapiro(three, "v").first().W == pytest.approx(1.0)


def test_heavy_tails_are_drawn_in(spark):
    rng = np.random.default_rng(2)
    u = rng.normal(size=3000)
    y = 5 + 2 * u * np.exp(0.1 * u * u)
    df = spark.createDataFrame(pd.DataFrame({"y": y}))
    tail = gaussian.fit_heavy_tail(df, "y")
    assert tail.delta == pytest.approx(0.2, abs=0.04) and tail.mu == pytest.approx(5, abs=0.2)
    x = gaussian.gaussianize(df, "y").toPandas().y.to_numpy()
    z = (x - x.mean()) / x.std()
    assert (z**4).mean() == pytest.approx(3.0, abs=1e-6)
    assert x.mean() == pytest.approx(tail.mu, abs=1e-8) and x.std(ddof=1) == pytest.approx(tail.sigma, abs=1e-8)
    score = (x - tail.mu) / tail.sigma
    assert np.sort(tail.mu + tail.sigma * score * np.exp(tail.delta / 2 * score**2)) == pytest.approx(np.sort(y))
    even = spark.createDataFrame(pd.DataFrame({"y": rng.uniform(size=500)}))
    assert gaussian.fit_heavy_tail(even, "y").delta == 0.0


def test_cutting_the_interval_finds_what_newton_finds(spark):
    rng = np.random.default_rng(7)
    u = rng.normal(size=800)
    df = spark.createDataFrame(pd.DataFrame({"y": 1 + 3 * u * np.exp(0.15 * u * u)}))
    newton = gaussian.fit_heavy_tail(df, "y")
    assert newton.converged
    y = df.toPandas().y
    cut = gaussian._cut(gaussian.histogram(df, [], "y"), "y", len(y), y.mean(), y.std())
    assert cut.converged and (cut.mu, cut.sigma, cut.delta) == pytest.approx((newton.mu, newton.sigma, newton.delta), abs=1e-4)


def test_tails_without_an_answer(spark):
    # most values are one value: no tail weight brings kurtosis down to 3
    df = spark.createDataFrame([(0.0,)] * 97 + [(1.0,), (-1.0,), (5.0,)] + [(None,), (float("inf"),), (float("nan"),)], "y double")
    tail = gaussian.fit_heavy_tail(df, "y")
    assert not tail.converged and tail.delta == gaussian.HEAVIEST and tail.sigma > 0
    rows = gaussian.gaussianize(df, "y", "x").toPandas()
    assert rows.x.iloc[0] == pytest.approx(rows.x.iloc[1]) and rows.x.iloc[98] < rows.x.iloc[0] < rows.x.iloc[97] < rows.x.iloc[99]
    assert pd.isna(rows.x.iloc[100]) and rows.x.iloc[101] == float("inf") and pd.isna(rows.x.iloc[102])
    none = gaussian.fit_heavy_tail(df.where("y > 9e9 and y < 9e8"), "y")
    assert none == gaussian.HeavyTail(0.0, 1.0, 0.0)
