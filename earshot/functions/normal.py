"""Normal distribution as column expressions: quantile, upper and lower tails.

Spark SQL has no normal quantile or error function, so both are rational
approximations from the literature: Wichura (1988), algorithm AS 241, for the
quantile and Hart (1968) in the form given by West (2005) for the distribution
function. Both are good to about 15 digits.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values: AS 241 (PPND16) coefficients, constant term first ---
CENTRAL_NUM = [
    3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3,
    1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4,
    3.3430575583588128105e4, 2.5090809287301226727e3,
]
CENTRAL_DEN = [
    1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3,
    2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4,
    5.2264952788528545610e3,
]
MIDDLE_NUM = [
    1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0,
    3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1,
    2.27238449892691845833e-2, 7.74545014278341407640e-4,
]
MIDDLE_DEN = [
    1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1,
    1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4,
    1.05075007164441684324e-9,
]
FAR_NUM = [
    6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0,
    2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3,
    2.71155556874348757815e-5, 2.01033439929228813265e-7,
]
FAR_DEN = [
    1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2,
    7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7,
    2.04426310338993978564e-15,
]
# --- fixed values: Hart/West normal tail coefficients, constant term first ---
TAIL_NUM = [
    220.206867912376, 221.213596169931, 112.079291497871, 33.912866078383,
    6.37396220353165, 0.700383064443688, 3.52624965998911e-2,
]
TAIL_DEN = [
    440.413735824752, 793.826512519948, 637.333633378831, 296.564248779674,
    86.7807322029461, 16.064177579207, 1.75566716318264, 8.83883476483184e-2,
]
# ------------------------------------------------------------------------------
TAIL_SWITCH = 7.07106781186547
ROOT_TWO_PI = 2.5066282746310002


def _poly(coefs: list[float], x):
    """Polynomial in ``x`` with the constant term first; works on columns and arrays."""
    value = x * coefs[-1] + coefs[-2]
    for c in reversed(coefs[:-2]):
        value = value * x + c
    return value


def _poly_text(coefs: list[float], x: str) -> str:
    """The same as SQL text."""
    text = f"{coefs[-1]!r}D"
    for c in reversed(coefs[:-1]):
        text = f"({text} * {x} + {c!r}D)"
    return text


def with_probit(df: DataFrame, quantiles: dict[str, Column]) -> DataFrame:
    """Add standard normal quantiles of probability columns; NULL outside (0, 1).

    The parts that the polynomials repeat are columns of their own, so that they
    are computed once per row instead of being written out in every term.
    """
    names = list(quantiles)
    df = df.withColumns({f"_p_{n}": p.cast("double") for n, p in quantiles.items()})
    df = df.withColumns({f"_q_{n}": F.expr(f"_p_{n} - 0.5D") for n in names} | {
        f"_t_{n}": F.expr(f"sqrt(-ln(least(_p_{n}, 1D - _p_{n})))") for n in names
    })
    df = df.withColumns({f"_r_{n}": F.expr(f"0.180625D - _q_{n} * _q_{n}") for n in names} | {
        f"_m_{n}": F.expr(f"_t_{n} - if(_t_{n} <= 5D, 1.6D, 5D)") for n in names
    })
    ratio = lambda num, den, x: f"{_poly_text(num, x)} / {_poly_text(den, x)}"
    df = df.withColumns({n: F.expr(f"""CASE
        WHEN NOT (_p_{n} > 0D AND _p_{n} < 1D) THEN NULL
        WHEN abs(_q_{n}) <= 0.425D THEN _q_{n} * {ratio(CENTRAL_NUM, CENTRAL_DEN, f'_r_{n}')}
        WHEN _t_{n} <= 5D THEN signum(_q_{n}) * {ratio(MIDDLE_NUM, MIDDLE_DEN, f'_m_{n}')}
        ELSE signum(_q_{n}) * {ratio(FAR_NUM, FAR_DEN, f'_m_{n}')} END""") for n in names})
    return df.drop(*[f"_{part}_{n}" for part in "pqtrm" for n in names])


def normal_upper(x: Column) -> Column:
    """P(Z > x) for a standard normal Z."""
    a = F.abs(x)
    near = _poly(TAIL_NUM, a) / _poly(TAIL_DEN, a)
    far = F.lit(1.0) / ((a + F.lit(1.0) / (a + F.lit(2.0) / (a + F.lit(3.0) / (a + F.lit(4.0) / (a + 0.65))))) * ROOT_TWO_PI)
    tail = F.exp(-a * a / 2.0) * F.when(a < TAIL_SWITCH, near).otherwise(far)
    return F.when(x < 0.0, 1.0 - tail).otherwise(tail)


def normal_cdf_array(x: np.ndarray) -> np.ndarray:
    """Lower normal tail of a numpy array (used inside tasks that already hold one)."""
    a = np.abs(x)
    near = _poly(TAIL_NUM, a) / _poly(TAIL_DEN, a)
    far = 1.0 / ((a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) * ROOT_TWO_PI)
    tail = np.exp(-a * a / 2.0) * np.where(a < TAIL_SWITCH, near, far)
    return np.where(x > 0, 1.0 - tail, tail)
