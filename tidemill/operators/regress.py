"""Least squares on any number of factors from one grouped aggregate, and orthogonal factors.

Means and covariances of a group are all that least squares needs; they merge, so each task sends one
row a group. The normal equations are solved in column expressions by Cholesky.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SINGULAR = 1e-12  #: a pivot below this share of its variance means that factors depend on each other


def moments(rows: DataFrame, by: list[str], y: str, xs: list[str]) -> DataFrame:
    """by, n, the means m_i and population covariances v_i_j (j <= i) of xs and, as the last, of y.

    Rows with a null or NaN in any of them are left out."""
    names = [*xs, y]
    whole = rows.dropna(subset=names)
    values = {f"m_{i}": F.avg(a) for i, a in enumerate(names)}
    values |= {f"v_{i}_{j}": F.covar_pop(a, names[j]) for i, a in enumerate(names) for j in range(i + 1)}
    return whole.groupBy(*by).agg(F.count("*").alias("n"), *(e.alias(k) for k, e in values.items()))


def cholesky(m: DataFrame, k: int) -> DataFrame:
    """m with l_i_j, the lower factor of the covariances of its first k columns; null where singular."""
    for j in range(k):
        pivot = F.col(f"v_{j}_{j}") - sum((F.col(f"l_{j}_{p}") * F.col(f"l_{j}_{p}") for p in range(j)), F.lit(0.0))
        m = m.withColumn(f"l_{j}_{j}", F.when(pivot > SINGULAR * F.col(f"v_{j}_{j}"), F.sqrt(pivot)))
        below = lambda i: (F.col(f"v_{i}_{j}") - sum((F.col(f"l_{i}_{p}") * F.col(f"l_{j}_{p}") for p in range(j)), F.lit(0.0))) / F.col(f"l_{j}_{j}")  # noqa: B023, E731
        m = m.withColumns({f"l_{i}_{j}": below(i) for i in range(j + 1, k)}) if j + 1 < k else m
    return m


def forward(m: DataFrame, k: int, value, name: str) -> DataFrame:
    """m with name_i, the solution of L x = value(i)."""
    for i in range(k):
        x = (value(i) - sum((F.col(f"l_{i}_{p}") * F.col(f"{name}_{p}") for p in range(i)), F.lit(0.0))) / F.col(f"l_{i}_{i}")
        m = m.withColumn(f"{name}_{i}", x)
    return m


def ols(rows: DataFrame, by: list[str], y: str, xs: list[str], least: int = 250, year: int = 245) -> DataFrame:
    """by, n, alpha_lin, alpha_comp, t, r2, beta_<x> and cor_<x> of y on xs and a constant, for each group of
    at least `least` whole rows. Where factors depend on each other, all but n and the correlations are null."""
    k = len(xs)
    m = cholesky(moments(rows, by, y, xs).where(F.col("n") >= least), k)
    m = forward(m, k, lambda i: F.col(f"v_{k}_{i}"), "z")  # of y
    m = forward(m, k, lambda i: F.col(f"m_{i}"), "u")  # of the means
    for i in reversed(range(k)):
        upper = sum((F.col(f"l_{p}_{i}") * F.col(f"b_{p}") for p in range(i + 1, k)), F.lit(0.0))
        m = m.withColumn(f"b_{i}", (F.col(f"z_{i}") - upper) / F.col(f"l_{i}_{i}"))
    total = lambda f: sum((f(i) for i in range(k)), F.lit(0.0))
    m = m.withColumns({
        "alpha": F.col(f"m_{k}") - total(lambda i: F.col(f"b_{i}") * F.col(f"m_{i}")),
        "rest": F.col(f"v_{k}_{k}") - total(lambda i: F.col(f"z_{i}") * F.col(f"z_{i}")),
        "spread": 1 + total(lambda i: F.col(f"u_{i}") * F.col(f"u_{i}")),
    })
    some = lambda e: F.nullif(e, F.lit(0.0))
    error = F.sqrt(F.col("rest") / (F.col("n") - k - 1) * F.col("spread"))
    out = {"alpha_lin": F.col("alpha") * year, "alpha_comp": F.pow(1 + F.col("alpha"), F.lit(year)) - 1, "t": F.col("alpha") / some(error), "r2": 1 - F.col("rest") / some(F.col(f"v_{k}_{k}"))}
    out |= {f"beta_{x}": F.col(f"b_{i}") for i, x in enumerate(xs)}
    out |= {f"cor_{x}": F.col(f"v_{k}_{i}") / some(F.sqrt(F.col(f"v_{i}_{i}") * F.col(f"v_{k}_{k}"))) for i, x in enumerate(xs)}
    return m.select(*by, "n", *(e.alias(c) for c, e in out.items()))


def orthogonal_map(rows: DataFrame, xs: list[str]) -> dict[str, Column]:
    """For each of xs its symmetric orthogonal form as an expression: standard values times the inverse
    square root of their correlations, the nearest factors to xs that have none among each other.

    Only the k means and k x k covariances come to the driver; the map goes out as constants. Rows with a
    null in any of xs have no values. Without rows, or for a constant factor, all is null."""
    k = len(xs)
    m = moments(rows, [], xs[0], xs).first()
    if not m.n or any(not m[f"v_{i}_{i}"] for i in range(k)):
        return {x: F.lit(None).cast("double") for x in xs}
    cov = np.array([[m[f"v_{max(i, j)}_{min(i, j)}"] for j in range(k)] for i in range(k)])
    sd = np.sqrt(np.diag(cov))
    roots, axes = np.linalg.eigh(cov / np.outer(sd, sd))
    turn = axes @ np.diag(np.maximum(roots, 1e-10) ** -0.5) @ axes.T
    standard = [(F.col(x) - float(m[f"m_{i}"])) / float(sd[i]) for i, x in enumerate(xs)]
    return {x: sum((s * float(turn[i, j]) for i, s in enumerate(standard)), F.lit(0.0)) for j, x in enumerate(xs)}


def orthogonal(rows: DataFrame, xs: list[str]) -> DataFrame:
    """rows with xs in their symmetric orthogonal form."""
    return rows.withColumns(orthogonal_map(rows, xs))
