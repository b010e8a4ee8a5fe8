import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.functions import labels, names, normal, tails
from earshot.operators.gaussian import lambert_w


def column(spark, values, kind="double"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def test_probit_against_standard_library(spark):
    ps = [1e-12, 1e-6, 0.001, 0.07, 0.3, 0.5, 0.7, 0.93, 0.999, 1 - 1e-9, 0.0, 1.0]
    rows = normal.with_probit(column(spark, ps), {"z": F.col("v")}).orderBy("i").collect()
    for p, r in zip(ps, rows):
        if 0 < p < 1:
            assert r.z == pytest.approx(NormalDist().inv_cdf(p), abs=1e-9)
        else:
            assert r.z is None
    assert set(rows[0].asDict()) == {"i", "v", "z"}
    assert rows[5].z == 0.0 and rows[4].z == pytest.approx(-rows[6].z)


def test_normal_upper(spark):
    xs = [-9.0, -3.0, 0.0, 0.5, 2.0, 7.5, 12.0]
    got = [r.p for r in column(spark, xs).withColumn("p", normal.normal_upper(F.col("v"))).orderBy("i").collect()]
    assert got == pytest.approx([0.5 * math.erfc(x / math.sqrt(2)) for x in xs], rel=1e-7)


def test_lambert_w_inverts(spark):
    ws = [0.0, 1e-6, 0.2, 1.0, 3.0, 8.0]
    df = column(spark, [w * math.exp(w) for w in ws]).withColumn("w", lambert_w(F.col("v"))).orderBy("i")
    assert [r.w for r in df.collect()] == pytest.approx(ws, abs=1e-12)


def numeric_integral(f, low, high, n=200_000):
    x = np.linspace(low, high, n)
    return np.trapezoid(f(x), x)


def test_tails_against_integration():
    t_density = lambda x: math.gamma(5.5) / math.sqrt(10 * math.pi) / math.gamma(5) * (1 + x * x / 10) ** -5.5
    assert tails.t_two_sided(2.0, 10) == pytest.approx(2 * numeric_integral(t_density, 2, 400), rel=1e-6)
    f_density = lambda x: 1 / (math.gamma(1) * math.gamma(10) / math.gamma(11)) * (2 / 20) * (1 + 2 * x / 20) ** -11
    assert tails.f_upper(3.0, 2, 20) == pytest.approx(numeric_integral(f_density, 3, 2000), rel=1e-5)
    chi = lambda x: x ** 1.5 * np.exp(-x / 2) / (2 ** 2.5 * math.gamma(2.5))
    assert tails.chi2_upper(7.0, 5) == pytest.approx(numeric_integral(chi, 7, 200), rel=1e-6)
    assert tails.chi2_upper(4.0, 2) == pytest.approx(math.exp(-2))
    # the limit for many degrees of freedom
    for df in (1e6, 1e9, 1e12, 1e15):
        assert tails.f_upper(3.84, 1, df) == pytest.approx(tails.chi2_upper(3.84, 1), rel=20 / df + 1e-9)
        assert tails.f_upper(7.0 / 5, 5, df) == pytest.approx(tails.chi2_upper(7.0, 5), rel=20 / df + 1e-9)


def test_studentized_range():
    # Published 5 % points of the studentized range.
    for t in (0.5, 2.0, 5.0, 10.0, 20.0):  # far out too
        assert tails.t_two_sided(t, 1e8) == pytest.approx(math.erfc(t / math.sqrt(2)), rel=1e-3)
        assert tails.t_two_sided(t, 1) == pytest.approx(1 - 2 / math.pi * math.atan(t), rel=1e-9)
        assert tails.t_two_sided(t, 2) == pytest.approx(1 - t / math.sqrt(2 + t * t), rel=1e-9)
    assert 0 < tails.t_two_sided(-10.1358, 200) < tails.t_two_sided(-10.1358, 100) < 1e-16
    assert tails.f_upper(60 / 5, 5, 1e8) == pytest.approx(tails.chi2_upper(60, 5), rel=1e-3)
    assert tails.tukey_quantile(0.95, 3, 20) == pytest.approx(3.578, abs=2e-3)
    assert tails.tukey_quantile(0.95, 5, 10) == pytest.approx(4.654, abs=2e-3)
    assert tails.tukey_quantile(0.95, 2, 1e6) == pytest.approx(math.sqrt(2) * 1.959964, abs=1e-4)
    assert tails.tukey_upper(3.3, 3, 24_999) == pytest.approx(tails.tukey_upper(3.3, 3, 25_001), rel=1e-6)
    assert tails.tukey_upper(3.3, 3, 1e12) == pytest.approx(1 - tails._range_lower(np.array([3.3]), 3)[0], rel=1e-9)
    # Two means: the same as a t test.
    assert tails.tukey_upper(3.0, 2, 12) == pytest.approx(tails.t_two_sided(3.0 / math.sqrt(2), 12), abs=1e-8)


def test_name_parts(spark):
    files = ["4-32kHz_MIXdB_50ms_4s", "BBN_30-90dB_50ms_BG_PNK_50dB_4s", "odd name"]
    f = F.col("v")
    rows = column(spark, files, "string").select(
        names.name_part(f, 1), names.name_part(f, 2), names.name_part(f, 3), names.background_part(f, 2), names.background_part(f, 3),
    ).collect()
    assert sorted(tuple(r) for r in rows) == sorted([
        ("4-32kHz", "MIXdB", "50ms", "NA", "NA"), ("BBN", "30-90dB", "50ms", "PNK", "50"),
        ("odd name", "odd name", "odd name", "NA", "NA"),
    ])


def test_threshold_lists(spark):
    texts = ["12, 15.5, 20, 22", "25", "n/a", "2.5", None]
    df = column(spark, texts, "string").select("i", *[names.listed_threshold(F.col("v"), k).alias(f"t{k}") for k in range(1, 5)])
    rows = [tuple(r)[1:] for r in df.orderBy("i").collect()]
    assert rows == [(12.0, 16.0, 20.0, 22.0), (25.0,) * 4, (None,) * 4, (2.0,) * 4, (None,) * 4]


def test_labels(spark):
    df = column(spark, [0.0, 4.0, 0.5], "double").select(labels.stim_kind(F.col("v")).alias("k"))
    assert [r.k for r in df.collect()] == ["BBN", "4kHz", "0.5kHz"]
    phases = ["BBN, recovery", "BBN, post-HL", "BBN, recovery2", "BBN, post-HL2", "BBN"]
    got = column(spark, phases, "string").select("i", labels.condition_of(F.col("v")).alias("c")).orderBy("i").collect()
    assert [r.c for r in got] == ["Recovery", "Post HHL", "Recovery 2", "Post 2nd Exposure", "Baseline"]
    ps = column(spark, [0.001, 0.01, 0.05, 0.1, 0.2, None]).select("i", labels.stars(F.col("v")).alias("s")).orderBy("i")
    assert [r.s for r in ps.collect()] == ["***", "**", "*", ".", " ", None]
    bg = spark.createDataFrame([("NA", "NA"), ("PKN", "30"), ("WN", "30")], "a string, b string")
    assert [r[0] for r in bg.select(labels.background_label(F.col("a"), F.col("b"))).collect()] == [
        "Quiet", "30dB Pink Noise Background", "ISSUE"]
