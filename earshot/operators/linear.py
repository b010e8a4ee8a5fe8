"""Linear models by sums of products: analysis of variance, coefficients, residuals, Tukey.

Rows are first reduced to design cells (distinct combinations of the model's
columns) with count, sum and sum of squares: one aggregate with map-side
combination. Each batch of cells becomes one small matrix of products, matrices
are added up entry by entry, and a single row per model holds what is left to
solve. A model's size depends on its terms and factor levels, never on the data.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from earshot.functions.tails import f_upper, t_two_sided, tukey_quantile, tukey_upper
from earshot.operators.joins import attach

ALIASED = 1e-9


def crossed(*columns: str) -> list[tuple[str, ...]]:
    """All main effects, then pairs, then triples, ...: the terms of ``A*B*C``."""
    return [c for size in range(1, len(columns) + 1) for c in combinations(columns, size)]


def levels_of(df: DataFrame, column: str) -> list:
    """Distinct values of a factor in sorted order; a model has a column for each of them."""
    return sorted(r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().collect())


class Design:
    """Columns of a model: the intercept, numbers as they are, factors as 0/1 levels."""

    def __init__(self, terms: list[tuple[str, ...]], levels: dict[str, list]):
        self.terms, self.levels = terms, levels
        self.variables = list(dict.fromkeys(v for t in terms for v in t))
        self.columns: list[tuple[int, tuple]] = [(-1, ())]
        for i, term in enumerate(terms):
            parts = [()]
            for v in term:
                steps = [(v, l) for l in levels[v][1:]] if v in levels else [(v, None)]
                parts = [p + (s,) for s in steps for p in parts]
            self.columns += [(i, p) for p in parts]

    def __len__(self) -> int:
        return len(self.columns)

    def name(self, j: int) -> str:
        parts = self.columns[j][1]
        return ":".join(v if l is None else f"{v}{l}" for v, l in parts) or "(Intercept)"

    def term_name(self, i: int) -> str:
        return ":".join(self.terms[i])

    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        out = np.ones((len(pdf), len(self)))
        for j, (_, parts) in enumerate(self.columns):
            for v, l in parts:
                out[:, j] *= pdf[v].to_numpy(dtype=float) if l is None else (pdf[v] == l).to_numpy(dtype=float)
        return out

    def used(self, df: DataFrame, y: str) -> DataFrame:
        """Rows that take part: nothing of the model is NULL, and every factor has a listed level."""
        known = F.col(f"`{y}`").isNotNull()
        for v in self.variables:
            c = F.col(f"`{v}`")
            known &= c.isin(self.levels[v]) if v in self.levels else c.isNotNull()
        return df.where(known)

    def fitted(self, coefficients: Column) -> Column:
        """The model's value as a column expression over an array of coefficients."""
        total = F.lit(0.0)
        for j, (_, parts) in enumerate(self.columns):
            x = F.get(coefficients, F.lit(j))
            for v, l in parts:
                x = x * (F.col(v) if l is None else F.when(F.col(v) == l, 1.0).otherwise(0.0))
            total = total + x
        return total


def product_sums(df: DataFrame, y: str, design: Design, keys: list[str] = ()) -> DataFrame:
    """One row per key: the entries of the product matrix of (design, y), in order; none where no row takes part."""
    keys, p = list(keys), len(design)
    used = design.used(df, y)
    cells = used.groupBy(*keys, *design.variables).agg(
        F.count("*").cast("double").alias("_n"), F.sum(y).alias("_y"), F.sum(F.col(y) * F.col(y)).alias("_yy"),
    )
    schema = T.StructType([cells.schema[k] for k in keys] + [
        T.StructField("_m", T.ArrayType(T.DoubleType()), False)])

    def products(batches):
        for pdf in batches:
            groups = pdf.groupby(keys, dropna=False, sort=False) if keys else [((), pdf)]
            rows = []
            for key, g in groups:
                x, n = design.matrix(g), g["_n"].to_numpy()
                m = np.empty((p + 1, p + 1))
                m[:p, :p] = x.T @ (x * n[:, None])
                m[p, :p] = m[:p, p] = x.T @ g["_y"].to_numpy()
                m[p, p] = g["_yy"].sum()
                rows.append([*key, m.ravel().tolist()])
            if rows:
                yield pd.DataFrame(rows, columns=[*keys, "_m"])

    entries = cells.mapInPandas(products, schema).select(*keys, F.posexplode("_m").alias("_pos", "_v"))
    summed = entries.groupBy(*keys, "_pos").agg(F.sum("_v").alias("_v"))
    return summed.groupBy(*keys).agg(  # (p + 1)^2 numbers
        F.transform(F.array_sort(F.collect_list(F.struct("_pos", "_v"))), lambda e: e["_v"]).alias("_m")
    ).where(F.size("_m") > 0)


class Solved:
    """A product matrix eliminated column by column, in term order.

    Columns that earlier ones already explain (empty cells) are left out.
    """

    def __init__(self, entries, p: int):
        m = np.asarray(entries, dtype=float).reshape(p + 1, p + 1)
        self.n, self.p = m[0, 0], p
        self.gram, self.xy, self.yy = m[:p, :p], m[:p, p], m[p, p]
        upper, kept = m.copy(), []
        for k in range(p):
            if upper[k, k] <= ALIASED * max(m[k, k], 1e-300):
                continue
            kept.append(k)
            ratio = upper[k + 1:, k] / upper[k, k]
            upper[k + 1:, :] -= ratio[:, None] * upper[k, :]
        self.upper, self.kept = upper, kept
        self.residual_ss = max(float(upper[p, p]), 0.0)
        self.residual_df = self.n - len(kept)

    def column_ss(self, k: int) -> float:
        return self.upper[k, self.p] ** 2 / self.upper[k, k] if k in self.kept else 0.0

    def coefficients(self) -> tuple[np.ndarray, np.ndarray]:
        """Coefficients and the inverse product matrix of the kept columns."""
        inverse = np.linalg.pinv(self.gram[np.ix_(self.kept, self.kept)])
        return np.linalg.solve(self.gram[np.ix_(self.kept, self.kept)], self.xy[self.kept]), inverse

    def level_means(self, columns: list[int], counts: np.ndarray) -> np.ndarray:
        """Means of a factor's levels from the part of the fit that its own term adds."""
        effects = np.zeros(len(columns) + 1)
        for k in columns:
            if k not in self.kept:
                continue
            along = np.array([self.upper[k, j] if j >= k else 0.0 for j in columns])
            share = self.upper[k, self.p] / self.upper[k, k]
            effects[1:] += along * share
            effects[0] -= along.sum() * share
        return self.xy[0] / self.n + effects / np.where(counts > 0, counts, np.nan)


def _per_model(sums: DataFrame, keys: list[str], fields: str, solve) -> DataFrame:
    """Apply ``solve`` (entries to rows) to each finished model."""
    schema = T.StructType([sums.schema[k] for k in keys] + T.StructType.fromDDL(fields).fields)
    names = [f.name for f in schema.fields]

    def run(batches):
        for pdf in batches:
            rows = [
                [*(getattr(r, k) for k in keys), *row]
                for r in pdf.rename(columns={"_m": "entries"}).itertuples(index=False) for row in solve(r.entries)
            ]
            yield pd.DataFrame(rows, columns=names)

    return sums.mapInPandas(run, schema)


def _level_lists(df: DataFrame, factors) -> dict[str, list]:
    """Factor levels as given, or looked up where only the name is."""
    if isinstance(factors, dict):
        return {k: list(v) for k, v in factors.items()}
    return {k: levels_of(df, k) for k in factors}


def anova(df: DataFrame, y: str, terms: list[tuple], factors, keys: list[str] = ()) -> DataFrame:
    """Sequential sums of squares per term, with F and p, and the residual line."""
    keys, design = list(keys), Design(terms, _level_lists(df, factors))

    def table(entries):
        s = Solved(entries, len(design))
        ms = s.residual_ss / s.residual_df if s.residual_df > 0 else None
        for i in range(len(terms)):
            columns = [j for j in s.kept if design.columns[j][0] == i]
            if not columns:
                continue
            ss = sum(s.column_ss(j) for j in columns)
            f = ss / len(columns) / ms if ms else None
            p = f_upper(f, len(columns), s.residual_df) if f is not None else None
            yield [i + 1, design.term_name(i), len(columns), ss, ss / len(columns), f, p]
        yield [len(terms) + 1, "Residuals", int(s.residual_df), s.residual_ss, ms, None, None]

    fields = "position int, term string, df long, sum_sq double, mean_sq double, f double, p double"
    return _per_model(product_sums(df, y, design, keys), keys, fields, table)


def coefficients(df: DataFrame, y: str, terms: list[tuple], factors, keys: list[str] = ()) -> DataFrame:
    """Estimate, standard error, t and p of every coefficient that can be estimated."""
    keys, design = list(keys), Design(terms, _level_lists(df, factors))

    def table(entries):
        s = Solved(entries, len(design))
        values, inverse = s.coefficients()
        ms = s.residual_ss / s.residual_df if s.residual_df > 0 else None
        for i, j in enumerate(s.kept):
            se = float(np.sqrt(inverse[i, i] * ms)) if ms is not None else None
            t = float(values[i]) / se if se else None
            p = t_two_sided(t, s.residual_df) if t is not None else None
            yield [j, design.name(j), float(values[i]), se, t, p]

    fields = "position int, coefficient string, estimate double, std_error double, t double, p double"
    return _per_model(product_sums(df, y, design, keys), keys, fields, table)


def residuals(df: DataFrame, y: str, terms: list[tuple], factors, keys: list[str] = (), out: str = "residual") -> DataFrame:
    """Rows with what the model leaves of ``y``; rows that take no part in it are dropped."""
    keys, design = list(keys), Design(terms, _level_lists(df, factors))

    def solve(entries):
        s = Solved(entries, len(design))
        full = np.zeros(len(design))
        full[s.kept] = s.coefficients()[0]
        yield [full.tolist()]

    fitted = _per_model(product_sums(df, y, design, keys), keys, "_b array<double>", solve)
    used = design.used(df, y)
    # Without keys this is exactly one row.
    joined = attach(used, fitted, keys) if keys else used.crossJoin(F.broadcast(fitted))
    return joined.withColumn(out, F.col(y) - design.fitted(F.col("_b"))).drop("_b")


def tukey(
    df: DataFrame, y: str, terms: list[tuple], factors, factor: str,
    ordered: bool = False, level: float = 0.95,
) -> DataFrame:
    """Honest differences between all levels of one factor of the model (Tukey-Kramer)."""
    lists = _level_lists(df, factors)
    design, names = Design(terms, lists), [str(l) for l in lists[factor]]
    index = terms.index((factor,))
    columns = [j for j, (i, _) in enumerate(design.columns) if i == index]

    def table(entries):
        s = Solved(entries, len(design))
        counts = np.array([0.0, *(s.gram[0, j] for j in columns)])
        counts[0] = s.n - counts[1:].sum()
        means = s.level_means(columns, counts)
        present = [i for i in range(len(names)) if counts[i] > 0]
        if len(present) < 2 or s.residual_df <= 0:
            return
        if ordered:
            present.sort(key=lambda i: means[i])
        ms = s.residual_ss / s.residual_df
        reach = tukey_quantile(level, len(present), s.residual_df)
        for a, low in enumerate(present):
            for high in present[a + 1:]:
                diff = float(means[high] - means[low])
                se = float(np.sqrt(ms / 2 * (1 / counts[high] + 1 / counts[low])))
                p = tukey_upper(abs(diff) / se, len(present), s.residual_df) if se > 0 else None
                yield [factor, f"{names[high]}-{names[low]}", diff, diff - reach * se, diff + reach * se, p]

    fields = "term string, contrast string, estimate double, lower double, upper double, p double"
    return _per_model(product_sums(df, y, design), [], fields, table)
