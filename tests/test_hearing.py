import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators import curves, reaction, reshape, sdt
from earshot.params import RXN_KEYS

SETTING = ("Green 1", "Male", "Baseline", "BBN", "NA", "NA", 50.0)
TRIAL = "ID string, Sex string, Condition string, Stim string, BG_Type string, BG_Intensity string, Dur double, Type int, Freq double, Inten double, Response string"


def responses(level, hit=0, miss=0, setting=SETTING):
    return [(*setting, 1, 0.0, level, "Hit")] * hit + [(*setting, 1, 0.0, level, "Miss")] * miss


def nogo(cr=0, fa=0, setting=SETTING, level=-100.0):
    return [(*setting, 0, 0.0, level, "C.R.")] * cr + [(*setting, 0, 0.0, level, "F.A.")] * fa


def test_response_table_adds_up(spark):
    rows = responses(30.0, 4, 2) + responses(40.0, 6) + nogo(5, 1)
    table = sdt.response_table(spark.createDataFrame(rows, TRIAL)).collect()
    assert sum((r.CR or 0) + (r.FA or 0) + (r.Hit or 0) + (r.Miss or 0) for r in table) == len(rows)
    assert {r.Inten: (r.Hit, r.Miss) for r in table if r.Type == 1} == {30.0: (4, 2), 40.0: (6, None)}


@pytest.mark.parametrize("rule,levels,want", [
    ("sum", [-100.0], (5, 1)), ("sum", [], (0, 0)), ("sum", [-100.0, -90.0], (10, 2)),
    ("row_count", [-100.0], (5, 1)), ("row_count", [], (0, 0)), ("row_count", [-100.0, -90.0], (2, 2)),
])
def test_nogo_rules(spark, rule, levels, want):
    rows = responses(30.0, 3, 1) + [r for level in levels for r in nogo(5, 1, level=level)]
    other = ("Orange 1", *SETTING[1:])
    rows += responses(30.0, 1, 1, other) + nogo(7, 0, other)
    got = sdt.attach_nogo(sdt.response_table(spark.createDataFrame(rows, TRIAL)), nogo=rule).where("ID = 'Green 1'").collect()
    assert [(r.CR, r.FA) for r in got] == [want]


def test_indices(spark):
    rows = responses(10.0, 4, 4) + responses(20.0, 8, 0) + nogo(4, 4)
    got = {r.dB: r for r in sdt.dprime_table(spark.createDataFrame(rows, TRIAL)).collect()}
    even, perfect = got[10.0], got[20.0]
    assert (even.dprime, even.c, even.beta, even.aprime) == pytest.approx((0, 0, 1, 0.5), abs=1e-12)
    assert math.isfinite(perfect.dprime) and perfect.dprime > 1.5
    h, f = 1.0, 0.5
    assert perfect.aprime == pytest.approx(0.5 + (h - f) * (1 + h - f) / (4 * h * (1 - f)))
    assert perfect.bppd == pytest.approx(((1 - h) * (1 - f) - h * f) / ((1 - h) * (1 - f) + h * f))


def curve_table(spark, curves_by_name):
    rows = [(k, float(x), float(y)) for k, (xs, ys) in curves_by_name.items() for x, y in zip(xs, ys)]
    return spark.createDataFrame(rows, "k string, x double, y double")


def brute_local_fit(xs, ys, span=0.75, cell=0.2, margin=0.005):
    """The same published method by dense least squares."""
    n = len(xs)
    q, least = int(span * n + 1e-5), math.floor(n * span * cell)
    cells, done = [(1, n)], []
    while cells:
        l, u = cells.pop()
        if u - l + 1 <= least or u <= l:
            done.append(l)
        else:
            cells += [(l, (l + u) // 2), ((l + u) // 2 + 1, u)]
    w = margin * max(xs[-1] - xs[0], max(abs(xs[0]), abs(xs[-1])) * 1e-3 + 1e-30)
    borders = sorted([xs[0] - w, xs[-1] + w] + [(xs[l - 2] + xs[l - 1]) / 2 for l in done if l > 1])
    value, slope = [], []
    for v in borders:
        h = np.sort(np.abs(xs - v))[q - 1]
        weight = np.clip(1 - (np.abs(xs - v) / h) ** 3, 0, None) ** 3
        keep = (xs - v) ** 2 < 0.999 * h ** 2
        design = np.vander(xs[keep] - v, 3, increasing=True) * np.sqrt(weight[keep])[:, None]
        if keep.sum() < 3:  # least norm of the scaled columns
            length = np.sqrt((design ** 2).sum(axis=0))
            length[length == 0] = 1
            beta = np.linalg.pinv(design / length, rcond=1e-9) @ (ys[keep] * np.sqrt(weight[keep])) / length
        else:
            beta = np.linalg.lstsq(design, ys[keep] * np.sqrt(weight[keep]), rcond=None)[0]
        value.append(beta[0]), slope.append(beta[1])
    out = []
    for x in xs:
        i = max(j for j in range(len(borders)) if borders[j] <= x)
        g = borders[i + 1] - borders[i]
        s = (x - borders[i]) / g
        out.append((1 + 2 * s) * (1 - s) ** 2 * value[i] + s * (1 - s) ** 2 * g * slope[i]
                   + s * s * (3 - 2 * s) * value[i + 1] + s * s * (s - 1) * g * slope[i + 1])
    return np.array(out)


@pytest.mark.parametrize("longest", [500, 8, 2])
def test_local_fit_rows_and_joins_agree_with_dense_fit(spark, longest):
    rng = np.random.default_rng(0)
    shapes = {"four": 4, "five": 5, "ten": 10, "seventeen": 17, "forty": 40}
    data = {k: (np.sort(rng.choice(200, n, replace=False)).astype(float), rng.normal(size=n).cumsum()) for k, n in shapes.items()}
    got = curves.local_fit(curve_table(spark, data), ["k"], "x", "y", longest=longest).toPandas()
    for k, (xs, ys) in data.items():
        fitted = got[got.k == k].sort_values("x").fitted.to_numpy()
        assert fitted == pytest.approx(brute_local_fit(xs, ys), abs=1e-8)


def test_local_fit_keeps_a_line_and_needs_points(spark):
    xs = np.arange(0, 100, 10.0)
    data = {"line": (xs, 0.05 * xs - 1), "short": (xs[:2], xs[:2]), "five": (xs[:5], 0.05 * xs[:5])}
    fit = curves.local_fit(curve_table(spark, data), ["k"], "x", "y")
    got = fit.toPandas()
    line = got[got.k == "line"]
    assert line.fitted.to_numpy() == pytest.approx(line.y.to_numpy(), abs=1e-9)
    assert got[got.k == "short"].fitted.isna().all()
    th = {r.k: r.TH for r in curves.crossing(fit, ["k"], "x", "fitted", 1.5).collect()}
    assert th["line"] == pytest.approx(50.0) and th["short"] is None and th["five"] is not None


def test_crossing_rules(spark):
    rows = [("flat", 1.0, 2.0), ("flat", 2.0, 2.0), ("tied", 0.0, 1.0), ("tied", 10.0, 1.0), ("tied", 20.0, 2.0),
            ("exact", 5.0, 1.5), ("exact", 9.0, 3.0), ("below", 1.0, 0.1), ("below", 2.0, 0.2), ("falling", 10.0, 2.0), ("falling", 20.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, f double")
    got = {r.k: r.TH for r in curves.crossing(df, ["k"], "x", "f", 1.5).collect()}
    assert got == {"flat": None, "tied": 12.5, "exact": 5.0, "below": None, "falling": 15.0}


def test_bracket_loses_ties(spark):
    rows = [("tie", 10.0, 1.0), ("tie", 20.0, 2.0), ("tie", 30.0, 2.4), ("ok", 10.0, 1.3), ("ok", 20.0, 1.9), ("ok", 30.0, 2.4), ("far", 10.0, 3.0)]
    df = spark.createDataFrame(rows, "k string, dB double, dprime double")
    got = {r.k: r.TH for r in curves.bracket_thresholds(df, keys=["k"]).collect()}
    assert got == {"ok": round((0.8 * 10 + 0.6 * 20) / 1.4)}


def test_cutoff_rules(spark):
    trial = "ID string, Condition string, BG_Type string, BG_Intensity string, Dur double, Freq double, Inten double"
    hits = spark.createDataFrame(
        [(i, "Baseline", "NA", "NA", 50.0, f, l) for i in ("known", "null", "none") for f in (0.0, 4.0) for l in (10.0, 40.0)], trial)
    th = spark.createDataFrame([
        ("Male", "known", "Baseline", "NA", "NA", 50.0, "BBN", 20.0), ("Male", "known", "Baseline", "NA", "NA", 50.0, "4kHz", 10.0),
        ("Male", "null", "Baseline", "NA", "NA", 50.0, "BBN", None),
    ], "Sex string, ID string, Condition string, BG_Type string, BG_Intensity string, Dur double, Type string, TH double")
    got = {(r.ID, r.Freq, r.Inten) for r in reaction.over_threshold(hits, th).collect()}
    # A setting known for one stimulus counts as known, with no threshold, for the others.
    assert got == {("known", 0.0, 40.0), ("known", 4.0, 10.0), ("known", 4.0, 40.0)} | {
        ("none", f, l) for f in (0.0, 4.0) for l in (10.0, 40.0)}


def test_counted_trials_give_the_same_tables(spark):
    rows = responses(30.0, 4, 2) + responses(40.0, 6) + nogo(5, 1)
    trials = spark.createDataFrame([(*r, 100.0 + i) for i, r in enumerate(rows)], TRIAL + ", RTime double")
    cells = reaction.counted(trials, RXN_KEYS)
    assert sorted(map(tuple, sdt.dprime_table(cells, weight="n").collect())) == sorted(map(tuple, sdt.dprime_table(trials).collect()))
    got = {r.Inten: (r.n, r["mean"]) for r in reaction.mean_reaction(reaction.go_hits(cells)).collect()}
    assert got == {30.0: (4, 101.5), 40.0: (6, 108.5)}


def test_wide_and_long_are_inverse(spark):
    df = spark.createDataFrame([("a", "p", 1.0), ("a", "q", 2.0), ("b", "p", 3.0)], "k string, n string, v double")
    wide = reshape.wide(df, ["k"], "n", "v", ["p", "q"])
    back = reshape.long(wide, ["k"], ["p", "q"], "n", "v").where(F.col("v").isNotNull())
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    filled = reshape.wide(df, ["k"], "n", "v", ["p", "q"], fill=0.0)
    assert {r.k: r.q for r in filled.collect()} == {"a": 2.0, "b": 0.0}
    both = reshape.in_every_condition(df, ["k"], ["p", "q"], "n")
    assert {r.k for r in both.collect()} == {"a"}
    assert reshape.stack(df, df.drop("v")).where("v is null").count() == 3
