"""Thresholds from d' curves: local regression, inverse interpolation, nearest-point rule."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.functions.labels import background_label
from earshot.operators.joins import attach
from earshot.operators.ranks import cumulative, midranks
from earshot.operators.reshape import long, wide
from earshot.params import CURVE_KEYS, STIM_TYPES, TH_KEYS
from earshot.session import cut_lineage

#: Product of the two eigenvalues of a scaled 3 x 3 normal matrix below which it counts as having one.
RANK_TWO = 1e-12
#: Share of the squared bandwidth from which a point has no weight, so that rounding gives none to the q-th one.
NEAR = 0.999


def _halvings(share: float) -> int:
    """Halvings after which every cell holds at most that share of its curve's points, or one point.

    Halves are rounded up and the bound down, which together cost two more at most.
    """
    return math.ceil(math.log2(1 / share)) + 2 if share < 1 else 1


def _cells(curves: DataFrame, keys: list[str], smallest: Column, halvings: int) -> DataFrame:
    """The cells (first and last rank) each curve of ``_n`` points is halved into.

    A cell is halved at its middle rank while it holds more than ``smallest`` points.
    """
    cells = curves.select(*keys, smallest.alias("_least"), F.lit(1).cast("long").alias("_l"), F.col("_n").alias("_u"))
    low, high, middle = F.col("_l"), F.col("_u"), F.floor((F.col("_l") + F.col("_u")) / 2)
    halves = F.array(
        F.struct(low.alias("l"), middle.alias("u")), F.struct((middle + 1).alias("l"), high.alias("u"))
    )
    done = (high - low + 1 <= F.col("_least")) | (high <= low)
    for _ in range(halvings):
        cells = cells.select(*keys, "_least", F.explode(
            F.when(done, F.array(F.struct(low.alias("l"), high.alias("u")))).otherwise(halves)
        ).alias("_c")).select(*keys, "_least", F.col("_c.l").alias("_l"), F.col("_c.u").alias("_u"))
    return cells.select(*keys, "_l", "_u")


def _solve(s: list[Column], t: list[Column]) -> tuple[Column, Column]:
    """Value and slope at the origin of a weighted quadratic, from its normal equations."""
    det = (
        s[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * s[3] - s[2] * s[2])
    )
    value = (
        t[0] * (s[2] * s[4] - s[3] * s[3]) - s[1] * (t[1] * s[4] - s[3] * t[2]) + s[2] * (t[1] * s[3] - s[2] * t[2])
    )
    slope = (
        s[0] * (t[1] * s[4] - s[3] * t[2]) - t[0] * (s[1] * s[4] - s[2] * s[3]) + s[2] * (s[1] * t[2] - t[1] * s[2])
    )
    return F.try_divide(value, det), F.try_divide(slope, det)


def _with_solution(rows: DataFrame, s: list[Column], t: list[Column], points: Column) -> DataFrame:
    """Adds ``_value`` and ``_slope`` at the origin whatever the number of points with weight, one at least.

    One or two points leave the quadratic undetermined. Of all through them it is the one of
    least norm after every column of the design is scaled to length one: the pseudo-inverse of
    the scaled normal matrix N. With at most two eigenvalues that are not zero, sum e1 and
    product e2, it is ((e1^2 - e2) N - e1 N^2) / e2^2, or N / e1^2 where there is only one.
    The steps are columns of their own, so that no expression repeats another.
    """
    c = F.col
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    n = lambda i, j: c(f"_n{min(i, j)}{max(i, j)}")
    steps = [
        {f"_i{j}": F.when(d > 0, 1 / F.sqrt(d)).otherwise(0.0) for j, d in enumerate((s[0], s[2], s[4]))},
        {f"_n{i}{j}": s[i + j] * c(f"_i{i}") * c(f"_i{j}") for i, j in pairs} | {f"_r{j}": t[j] * c(f"_i{j}") for j in range(3)},
        {f"_g{i}": n(i, 0) * c("_r0") + n(i, 1) * c("_r1") + n(i, 2) * c("_r2") for i in range(3)} | {
            "_e1": n(0, 0) + n(1, 1) + n(2, 2),
            "_e2": sum(n(i, i) * n(j, j) - n(i, j) * n(i, j) for i, j in pairs if i < j)},
    ]
    for step in steps:
        rows = rows.withColumns(step)
    short = []
    for i in range(2):
        twice = n(i, 0) * c("_g0") + n(i, 1) * c("_g1") + n(i, 2) * c("_g2")
        both = ((c("_e1") * c("_e1") - c("_e2")) * c(f"_g{i}") - c("_e1") * twice) / (c("_e2") * c("_e2"))
        short.append(c(f"_i{i}") * F.when(c("_e2") > RANK_TWO, both).otherwise(F.try_divide(c(f"_g{i}"), c("_e1") * c("_e1"))))
    solved = [F.when(points >= 3, full).when(points >= 1, few) for full, few in zip(_solve(s, t), short)]
    return rows.withColumns({"_value": solved[0], "_slope": solved[1]}).drop(*[name for step in steps for name in step])


def local_fit(
    points: DataFrame, keys: list[str], x: str, y: str,
    span: float = 0.75, cell: float = 0.2, margin: float = 0.005, longest: int = 500,
) -> DataFrame:
    """Local quadratic regression of ``y`` on ``x`` per curve; adds ``fitted``.

    Cleveland, Devlin & Grosse (1988): the curve is cut into cells of at most
    ``span * cell`` of its points, a tricube-weighted quadratic is fitted at the
    cell borders only, and the borders' values and slopes are blended by cubic
    Hermite pieces.

    ``x`` must be distinct within a curve. The bandwidth is the distance to the
    q-th nearest point, q = floor(span * n). Where a border has only one or two
    points of positive weight (short curves) the quadratic is the one of least norm
    among those through them; a border with none leaves ``fitted`` NULL (curves of up to
    three points, for which the span is too small).

    Curves of up to ``longest`` points (counted first) are fitted each in one row;
    longer ones by joins and aggregates that send a point to some twenty fits.
    """
    # Cut first: a filter on a computed y would be pushed below the computation and repeat it.
    pts = cut_lineage(points).where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sizes = pts.groupBy(*keys).agg(F.count("*").alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= longest:
        return _fit_rows(pts, keys, x, y, span, cell, margin)
    short = attach(pts, sizes, keys).where(F.col("_n") <= longest).drop("_n")
    far = attach(pts, sizes, keys).where(F.col("_n") > longest).drop("_n")
    return _fit_rows(short, keys, x, y, span, cell, margin).unionByName(
        _fit_joined(far, keys, x, y, span, cell, margin)
    )


def _widen(low: Column, high: Column, margin: float) -> Column:
    """How far the outer borders lie outside the points."""
    return F.greatest(high - low, F.greatest(F.abs(low), F.abs(high)) * 1e-3 + 1e-30) * F.lit(margin)


# Weighted sums of a border's points: s0..s4 of powers of u, t0..t2 of those times y.
_POWERS = ["1", "e.u", "e.u * e.u", "e.u * e.u * e.u", "e.u * e.u * e.u * e.u"]
_SUMS = {f"s{k}": f"e.w * {u}" for k, u in enumerate(_POWERS)} | {
    f"t{k}": f"e.w * {u} * e.y" for k, u in enumerate(_POWERS[:3])
}
_ZEROS = ", ".join(f"'{name}', 0D" for name in _SUMS)
_ADD = ", ".join(f"'{name}', m.{name} + {term}" for name, term in _SUMS.items())


def _fit_rows(pts: DataFrame, keys: list[str], x: str, y: str, span: float, cell: float, margin: float) -> DataFrame:
    """Fit curves of bounded length, one curve per row.

    ``_p`` holds the points, ``_cells`` the cells as first and last rank, ``_fits``
    one entry per border that grows from its place and bandwidth to value and slope.
    """
    cells = "array(named_struct('l', 1L, 'u', bigint(_n)))"
    halves = """flatten(transform({}, c -> if(c.u - c.l + 1 <= _least or c.u <= c.l, array(c), array(
        named_struct('l', c.l, 'u', (c.l + c.u) div 2), named_struct('l', (c.l + c.u) div 2 + 1, 'u', c.u)))))"""
    for _ in range(_halvings(span * cell)):
        cells = halves.format(cells)
    borders = """concat(array(_p[0].x - _w), transform(filter(_cells, c -> c.l > 1),
        c -> (_p[int(c.l) - 2].x + _p[int(c.l) - 1].x) / 2), array(_p[_n - 1].x + _w))"""
    bands = """filter(transform(_borders, v -> named_struct('v', v, 'h',
        get(array_sort(transform(_p, e -> abs(e.x - v))), _q - 1))), b -> b.h > 0)"""
    near = f"""transform(_fits, b -> named_struct('v', b.v, 'h', b.h, 'near', transform(filter(
        transform(_p, e -> named_struct('u', (e.x - b.v) / b.h, 'y', e.y)), e -> e.u * e.u < {NEAR}),
        e -> named_struct('u', e.u, 'y', e.y, 'w', pow(1 - pow(abs(e.u), 3), 3)))))"""
    summed = f"""transform(_fits, b -> named_struct('v', b.v, 'h', b.h, 'k', size(b.near), 'm', aggregate(b.near,
        named_struct({_ZEROS}), (m, e) -> named_struct({_ADD}))))"""
    moments = [F.col(f"_s.m.{name}") for name in _SUMS]
    curve = (
        pts.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(x).alias("x"), F.col(y).alias("y")))).alias("_p"))
        .withColumn("_n", F.size("_p"))
        .withColumns({
            "_q": F.floor(F.col("_n") * F.lit(span) + F.lit(1e-5)).cast("int"),
            "_least": F.floor(F.col("_n") * F.lit(span * cell)),
            "_w": _widen(F.expr("_p[0].x"), F.expr("_p[_n - 1].x"), margin),
        })
        .withColumn("_cells", F.expr(cells))
    )
    for name, text in (("_borders", borders), ("_fits", bands), ("_fits", near), ("_fits", summed)):
        curve = curve.withColumn(name, F.expr(text))
    rows = (
        _with_solution(curve.select(*keys, "_p", F.explode_outer("_fits").alias("_s")), moments[:5], moments[5:], F.col("_s.k"))
        .select(*keys, "_p", F.struct(F.col("_s.v").alias("v"), F.col("_value").alias("f"), (F.col("_slope") / F.col("_s.h")).alias("d")).alias("_fit"))
        .groupBy(*keys).agg(F.array_sort(F.collect_list("_fit")).alias("_fits"), F.first("_p").alias("_p"))
        .select(*keys, "_fits", F.explode("_p").alias("_e"))
        .select(*keys, "_fits", F.col("_e.x").alias(x), F.col("_e.y").alias(y))
    )
    return _blend(rows, x)


def _blend(rows: DataFrame, x: str) -> DataFrame:
    """Cubic Hermite piece between the border at or below a point and the next one."""
    at = rows.withColumn("_i", F.size(F.filter("_fits", lambda b: b["v"] <= F.col(x)))).withColumns({
        "_a": F.expr("try_element_at(_fits, nullif(_i, 0))"), "_b": F.expr("try_element_at(_fits, _i + 1)"),
    })
    a, b = F.col("_a"), F.col("_b")
    step = b["v"] - a["v"]
    s = (F.col(x) - a["v"]) / step
    hermite = (
        (1 + 2 * s) * (1 - s) * (1 - s) * a["f"] + s * (1 - s) * (1 - s) * step * a["d"]
        + s * s * (3 - 2 * s) * b["f"] + s * s * (s - 1) * step * b["d"]
    )
    return at.withColumn("fitted", hermite).drop("_i", "_a", "_b", "_fits")


def _fit_joined(pts: DataFrame, keys: list[str], x: str, y: str, span: float, cell: float, margin: float) -> DataFrame:
    """Fit curves of any length: points are ranked, joined to their curve's few borders, summed."""
    ranked = cumulative(cut_lineage(pts.withColumn("_t", F.lit(1).cast("long"))), keys, x, "_t")
    pts = cut_lineage(ranked.select(*keys, x, y, (F.col("before") + 1).alias("_rank"), F.col("total").alias("_n")))
    q = F.floor(F.col("_n") * F.lit(span) + F.lit(1e-5))
    curve = pts.groupBy(*keys).agg(
        F.min(x).alias("_lo"), F.max(x).alias("_hi"), F.max("_n").alias("_n"),
    )
    smallest = F.floor(F.col("_n") * F.lit(span * cell))
    widen = _widen(F.col("_lo"), F.col("_hi"), margin)

    # Borders: the two widened ends, and midway between the ranks either side of a cut.
    starts = _cells(curve, keys, smallest, _halvings(span * cell)).where(F.col("_l") > 1).withColumnRenamed("_l", "_start").drop("_u")
    sides = starts.withColumn("_rank", F.explode(F.array(F.col("_start") - 1, F.col("_start"))))
    cuts = (
        attach(sides, pts.select(*keys, "_rank", x), [*keys, "_rank"])
        .groupBy(*keys, "_start").agg(F.avg(x).alias("_v")).select(*keys, "_v")
    )
    ends = curve.select(*keys, F.explode(F.array(F.col("_lo") - widen, F.col("_hi") + widen)).alias("_v"))
    borders = (
        cuts.unionByName(ends).groupBy(*keys)
        .agg(F.array_sort(F.collect_list("_v")).alias("_borders"))  # at most 65 numbers
    )

    # Bandwidth: the narrowest run of q neighbouring points around the border.
    far = pts.select(*keys, (F.col("_rank") - q + 1).alias("_rank"), F.col(x).alias("_far"))
    near = attach(attach(pts, far, [*keys, "_rank"]), borders, keys)
    pairs = near.select(*keys, x, y, "_far", F.explode("_borders").alias("_v"))
    reach = F.greatest(F.col("_v") - F.col(x), F.col("_far") - F.col("_v"))
    bands = pairs.where(F.col("_far").isNotNull()).groupBy(*keys, "_v").agg(F.min(reach).alias("_h"))

    u = (F.col(x) - F.col("_v")) / F.col("_h")
    w = F.pow(1 - F.pow(F.abs(F.col("_u")), F.lit(3)), F.lit(3))
    weighed = (
        attach(pairs, bands, [*keys, "_v"]).where(F.col("_h") > 0)
        .withColumn("_u", u).where(F.col("_u") * F.col("_u") < NEAR).withColumn("_w", w)
    )
    moment = lambda k, extra=1.0: F.sum(F.col("_w") * F.pow(F.col("_u"), F.lit(k)) * extra)
    sums = weighed.groupBy(*keys, "_v").agg(
        F.count("*").alias("_k"), F.max("_h").alias("_h"),
        *[moment(k).alias(f"_s{k}") for k in range(5)],
        *[moment(k, F.col(y)).alias(f"_t{k}") for k in range(3)],
    )
    solved = _with_solution(sums, [F.col(f"_s{k}") for k in range(5)], [F.col(f"_t{k}") for k in range(3)], F.col("_k"))
    fits = (
        solved.select(*keys, F.struct(
            F.col("_v").alias("v"), F.col("_value").alias("f"), (F.col("_slope") / F.col("_h")).alias("d")).alias("_fit"))
        .groupBy(*keys).agg(F.array_sort(F.collect_list("_fit")).alias("_fits"))  # one per border
    )
    return _blend(attach(pts.select(*keys, x, y), fits, keys), x)


def crossing(curve: DataFrame, keys: list[str], x: str, fitted: str, level: float, out: str = "TH") -> DataFrame:
    """Per curve, the ``x`` at which the fitted values, taken in rising order, pass ``level``.

    ``x`` is averaged over fitted values that are equal to nine decimals (symmetric curves
    have such, and the last bits of a sum depend on its order); NULL when the level is outside the
    fitted range or part of the curve could not be fitted.
    """
    steps = curve.withColumn(fitted, F.round(fitted, 9)).groupBy(*keys, fitted).agg(F.avg(x).alias("_x"))
    point = F.struct(F.col(fitted).alias("f"), F.col("_x").alias("x"))
    ends = steps.groupBy(*keys).agg(
        F.max(F.when(F.col(fitted) <= level, point)).alias("_a"),
        F.min(F.when(F.col(fitted) >= level, point)).alias("_b"),
        F.bool_and(F.col(fitted).isNotNull()).alias("_whole"),
    )
    a, b = F.col("_a"), F.col("_b")
    share = (F.lit(level) - a["f"]) / (b["f"] - a["f"])
    place = F.when(a["f"] == b["f"], a["x"]).otherwise(a["x"] + share * (b["x"] - a["x"]))
    return ends.select(*keys, F.when(F.col("_whole"), place).alias(out))


def thresholds(dprimes: DataFrame, cutoff: float = 1.5, keys: list[str] = CURVE_KEYS) -> DataFrame:
    """Level at which each d' curve passes ``cutoff``, one row per curve."""
    points = dprimes.select(*keys, "dB", "dprime")
    return crossing(local_fit(points, keys, "dB", "dprime"), keys, "dB", "fitted", cutoff)


def bracket_thresholds(
    dprimes: DataFrame, cutoff: float = 1.5, within: float = 1.0, keys: list[str] = CURVE_KEYS,
) -> DataFrame:
    """Mean level of the two points nearest the cutoff, nearer ones weighing more.

    Ranks are averaged over ties and must be exactly 1 or 2, so two points that
    tie for nearest (both 1.5) leave the curve without a threshold.
    """
    scored = cut_lineage(
        dprimes.select(*keys, "dB", F.abs(F.col("dprime") - cutoff).alias("score"))
    ).where(F.col("score") < within)
    weight = 1 - F.col("score")
    return (
        midranks(scored, keys, "score", width=within / 20).where(F.col("rank").isin(1.0, 2.0))
        .groupBy(*keys).agg(F.bround(F.try_divide(F.sum(weight * F.col("dB")), F.sum(weight)), 0).alias("TH"))
    )


def by_stimulus(th: DataFrame, keys: list[str] = TH_KEYS) -> DataFrame:
    """One column per stimulus."""
    return wide(th, keys, "Type", "TH", STIM_TYPES)


def average_by_condition(
    th_wide: DataFrame, conditions=("Baseline", "Post HHL"), by=("Condition", "BG_Type", "BG_Intensity"), digits: int | None = 0,
) -> DataFrame:
    """Mean threshold per stimulus, rounded half to even unless ``digits`` is None."""
    mean = lambda c: F.avg(c) if digits is None else F.bround(F.avg(c), digits)
    return th_wide.where(F.col("Condition").isin(*conditions)).groupBy(*by).agg(
        *[mean(k).alias(f"{k}_avg") for k in STIM_TYPES]
    )


def average_by_background(th_wide: DataFrame, conditions=("Baseline", "Post HHL"), digits: int | None = 0) -> DataFrame:
    """Mean threshold per background in long form."""
    by = ["BG_Type", "BG_Intensity"]
    means = average_by_condition(th_wide, conditions, by, digits)
    renamed = means.withColumnsRenamed({f"{k}_avg": k for k in STIM_TYPES})
    return long(renamed, by, STIM_TYPES, "Type", "TH")


def dprime_change(dprimes: DataFrame, before: str = "Baseline", after: str = "Post HHL") -> DataFrame:
    """d' before, after and its change, per stimulus and level, with the background's name."""
    keys = ["ID", "Sex", "Type", "BG_Type", "BG_Intensity", "Dur", "dB"]
    both = (
        wide(dprimes.where(F.col("Condition").isin(before, after)), keys, "Condition", "dprime", [before, after])
        .withColumn("dprime_change", F.col(after) - F.col(before))
        .withColumn("BG", background_label(F.col("BG_Type"), F.col("BG_Intensity")))
    )
    return long(both, [*keys, "BG"], ["dprime_change", before, after], "Condition", "dprime")
