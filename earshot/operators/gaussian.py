"""Heavy-tail removal: Lambert W transform towards a normal distribution (Goerg 2015).

The observed y is taken as sigma * u * exp(delta * u^2 / 2) + mu for a near-normal
u. The three parameters are those for which u has mean 0, variance 1 and kurtosis
3. A pass over the distinct values tries several parameters at once (an exploded
array of at most :data:`TRIED` entries, sums combined where the values lie); only
the sums of each reach the driver. Newton steps come first, each tried in several
lengths; where they get stuck, the interval of delta is cut, which always ends.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from earshot.operators.ranks import histogram

HALLEY_STEPS = 8
TRIED = 15               # parameters of one pass
HEAVIEST = 1.0           # tail weights from which on the transform has no mean
LENGTHS = (1.0, 0.5, 0.25, 0.1, 0.03)  # parts of a Newton step
CUTS, SETTLING = 6, 40   # cuts of the interval of delta, and passes of one cut
NEAR = 1e-5              # from here on one more Newton step is exact


def lambert_w(x: Column) -> Column:
    """Principal branch of w * exp(w) = x for x >= 0, by Halley steps."""
    def step(w: Column, _: Column) -> Column:
        e = F.exp(w)
        miss = w * e - x
        return w - miss / (e * (w + 1.0) - (w + 2.0) * miss / (2.0 * w + 2.0))

    return F.aggregate(F.sequence(F.lit(1), F.lit(HALLEY_STEPS)), F.log1p(x), step)


@dataclass(frozen=True)
class HeavyTail:
    """Location, scale and tail weight; ``converged`` is False where no tail weight gives a kurtosis of 3."""

    mu: float
    sigma: float
    delta: float
    converged: bool = True

    def score(self, y: Column) -> Column:
        """u for an observed value."""
        return _score((y - self.mu) / self.sigma, F.lit(float(self.delta)))

    def drawn_in(self, y: Column) -> Column:
        """The value without its heavy tail."""
        return y if self.delta == 0.0 else self.score(y) * self.sigma + self.mu


def _score(z: Column, delta: Column) -> Column:
    return F.when(delta > 0, F.signum(z) * F.sqrt(lambert_w(delta * z * z) / delta)).otherwise(z)


def _means(hist: DataFrame, y: str, n: int, tried: list[tuple]) -> list[np.ndarray]:
    """For each (mu, sigma, delta): means of u, u^2 and u^4, then the slopes of each by the three parameters."""
    entries = F.array(*[
        F.struct(F.lit(i).alias("i"), *[F.lit(float(a)).alias(c) for c, a in zip(("mu", "sigma", "delta"), at)])
        for i, at in enumerate(tried)
    ])
    t, u, z, delta = F.col("t"), F.col("u"), F.col("z"), F.col("delta")
    scored = (
        hist.select("t", F.col(y).cast("double").alias("v"), F.explode(entries).alias("e")).select("t", "v", "e.*")
        .withColumn("z", (F.col("v") - F.col("mu")) / F.col("sigma")).withColumn("u", _score(z, delta))
    )
    by_z = F.exp(-u * u * (delta / 2)) / (1.0 + delta * u * u)
    slopes = [-by_z / F.col("sigma"), -by_z * z / F.col("sigma"), -u * u * u / 2.0 / (1.0 + delta * u * u)]
    powers = {1: F.lit(1.0), 2: u, 4: u * u * u}
    columns = [t * u * p for p in powers.values()] + [t * k * p * s for k, p in powers.items() for s in slopes]
    rows = scored.groupBy("i").agg(*[F.sum(c).alias(f"s{j}") for j, c in enumerate(columns)]).collect()
    return [np.array(r[1:]) / n for r in sorted(rows, key=lambda r: r["i"])]


def _off(e: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """How far mean, variance and kurtosis are off, and the slopes of that."""
    share = n / (n - 1)
    by_mean, by_square, by_fourth = e[3:6], e[6:9], e[9:12]
    off = np.array([e[0], e[1] * share - 1.0, e[2] / e[1] ** 2 - 3.0])
    return off, np.array([by_mean, by_square * share, by_fourth / e[1] ** 2 - 2.0 * e[2] / e[1] ** 3 * by_square])


def fit_heavy_tail(df: DataFrame, y: str, steps: int = 25) -> HeavyTail:
    """Parameters of the transform over the finite values of ``y``; delta is 0 where kurtosis does not exceed 3.

    Always returns parameters. Where kurtosis stays over 3 up to the heaviest tail (most rows
    equal to one value), they are those of the heaviest tail, not ``converged``.
    """
    hist = histogram(df.where(F.abs(F.col(y).cast("double")) < float("inf")), [], y)
    t, v = F.col("t"), F.col(y).cast("double")
    n, total = hist.agg(F.sum("t"), F.sum(t * v)).first()
    if not n or n < 2:
        return HeavyTail(float(total or 0.0), 1.0, 0.0)
    mean = total / n
    d = v - mean
    m2, m4 = hist.agg(F.sum(t * d * d), F.sum(t * d * d * d * d)).first()
    sd = float(np.sqrt(m2 / (n - 1)))
    if m2 == 0 or m4 * n / (m2 * m2) <= 3.0:
        return HeavyTail(mean, sd or 1.0, 0.0)
    guess = max((np.sqrt(max(66.0 * m4 * n / (m2 * m2) - 162.0, 0.0)) - 6.0) / 66.0, 0.01)
    # the variance of such a y is sigma^2 / (1 - 2 delta)^1.5
    tried = [np.array([mean, sd * (1.0 - 2.0 * min(part * guess, 0.4)) ** 0.75, part * guess]) for part in (0.5, 0.75, 1.0, 1.5, 2.0)]
    least = np.inf
    for _ in range(steps):
        found = [(np.abs(off).max(), k, off, slope) for k, (off, slope) in enumerate(_off(e, n) for e in _means(hist, y, n, tried))]
        found = [f for f in found if np.isfinite(f[0]) and np.isfinite(f[3]).all()]
        if not found or min(f[0] for f in found) >= least:
            break
        least, k, off, slope = min(found, key=lambda f: f[:2])
        try:
            move = np.linalg.solve(slope, off)
        except np.linalg.LinAlgError:
            break
        at = tried[k]
        tried = [at - part * move for part in LENGTHS]
        tried = [a for a in tried if a[1] > 0.2 * at[1] and 0.0 < a[2] < HEAVIEST]
        if least < NEAR and tried:
            return HeavyTail(*(float(a) for a in tried[0]))
        if not tried:
            break
    return _cut(hist, y, n, mean, sd)


def _cut(hist: DataFrame, y: str, n: int, mean: float, sd: float) -> HeavyTail:
    """Tail weight by cutting its interval; location and scale of each weight by Goerg's iteration."""
    low, high, at, reached = 0.0, HEAVIEST, (mean, sd), False
    for _ in range(CUTS):
        deltas = np.linspace(low, high, TRIED + 1)[1:]
        mu, sigma = np.full(TRIED, at[0]), np.full(TRIED, at[1])
        for _ in range(SETTLING):
            e = np.array(_means(hist, y, n, list(zip(mu, sigma, deltas))))
            spread = np.sqrt((e[:, 1] - e[:, 0] ** 2) * n / (n - 1))
            mu, sigma = mu + sigma * e[:, 0], np.maximum(sigma * spread, sd * 1e-9)
            if max(np.abs(e[:, 0]).max(), np.abs(spread - 1.0).max()) < 1e-9:
                break
        square = e[:, 1] - e[:, 0] ** 2
        under = np.flatnonzero(e[:, 2] / square ** 2 <= 3.0)
        k = int(under[0]) if len(under) else TRIED - 1
        reached = reached or len(under) > 0
        at, low, high = (mu[k], sigma[k]), (deltas[k - 1] if k else low), deltas[k]
        if not reached:
            break
    return HeavyTail(float(at[0]), float(at[1]), float(high), converged=reached)


def gaussianize(df: DataFrame, y: str, out: str | None = None) -> DataFrame:
    """Replace ``y`` (or add ``out``) by its value with the heavy tails drawn in.

    NULL stays NULL; infinite values and NaN stay as they are and take no part in the fit.
    """
    value = F.col(y)
    drawn = fit_heavy_tail(df, y).drawn_in(value)
    finite = F.abs(value.cast("double")) < float("inf")
    return df.withColumn(out or y, F.when(finite, drawn).otherwise(value))
