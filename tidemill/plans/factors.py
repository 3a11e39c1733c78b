"""Regressions on several factors and orthogonal factors, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import regress, series
from tidemill.plans.catalogue import BARS, query, rounded
from tidemill.sources.tables import daily_bars

XS = ["market", "first", "second", "third"]

FACTOR_DAYS = f"""{BARS}, r AS (
  SELECT symbol, d, ln(close / lag(close) OVER (PARTITION BY symbol ORDER BY d)) / 100 AS r FROM bars
), f AS (
  SELECT d, avg(r) AS market, avg(r) FILTER (symbol % 4 = 1) - avg(r) AS first,
         avg(r) FILTER (symbol % 4 = 2) - avg(r) AS second, avg(r) FILTER (symbol % 4 = 3) - avg(r) AS third
  FROM r WHERE r IS NOT NULL GROUP BY d
), p AS (
  SELECT symbol, d, r, market, first, second, third FROM r JOIN f USING (d)
  WHERE r IS NOT NULL AND first IS NOT NULL AND second IS NOT NULL AND third IS NOT NULL
)"""


def factor_days(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Log returns by symbol and day (a hundredth of them, as these prices leap), and four factors by day: the mean of all symbols, and how far the means of
    three groups of symbols part from it. A factor without symbols is null."""
    r = daily_bars(spark, sf_dir).select("symbol", "d", (F.log(F.col("close") / F.lag("close").over(series.by_day())) / 100).alias("r")).where("r is not null")
    group = lambda k: F.avg(F.when(F.col("symbol") % 4 == k, F.col("r"))) - F.avg("r")
    return r, r.groupBy("d").agg(F.avg("r").alias("market"), group(1).alias("first"), group(2).alias("second"), group(3).alias("third"))


def eliminated(k: int) -> str:
    """CTEs s0 to s<k> that sweep the (k + 2) x (k + 2) matrix of sums of (1, xs, y) column by column.

    After the sweep of 1 and all xs the entries hold the inverse, the coefficients and the rest of y."""
    n = k + 2
    names = ["1", *XS[:k], "r"]
    first = ", ".join(f"sum(CAST({names[i]} AS DOUBLE) * {names[j]}) AS a{i}_{j}" for i in range(n) for j in range(n))
    out = [f"s0 AS (SELECT symbol, count(*) AS n, {first} FROM p GROUP BY symbol HAVING count(*) >= 250)"]
    for c in range(k + 1):
        cells = []
        for i in range(n):
            for j in range(n):
                if i == c and j == c:
                    e = f"1 / a{c}_{c}"
                elif i == c:
                    e = f"a{c}_{j} / a{c}_{c}"
                elif j == c:
                    e = f"-a{i}_{c} / a{c}_{c}"
                else:
                    e = f"a{i}_{j} - a{i}_{c} * a{c}_{j} / a{c}_{c}"
                cells.append(f"{e} AS a{i}_{j}")
        out.append(f"s{c + 1} AS (SELECT symbol, n, {', '.join(cells)} FROM s{c})")
    return ", ".join(out)


@query(f"""WITH {FACTOR_DAYS}, {eliminated(4)}, c AS (
  SELECT symbol, var_pop(r) AS v, {', '.join(f'corr(r, {x}) AS cor_{x}' for x in XS)} FROM p GROUP BY symbol
)
SELECT s.symbol, s.n, round(a0_5 * 245, 4) AS alpha_lin, round(pow(1 + a0_5, 245) - 1, 4) AS alpha_comp,
       round(a0_5 / sqrt(a5_5 / (n - 5) * a0_0), 3) AS t, round(1 - a5_5 / n / v, 4) AS r2,
       {', '.join(f'round(a{i + 1}_5, 4) AS beta_{x}' for i, x in enumerate(XS))},
       {', '.join(f'round(cor_{x}, 4) AS cor_{x}' for x in XS)}
FROM s5 s JOIN c USING (symbol)""")
def four_factor_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol on four factors and a constant; the SQL sweeps the matrix of sums instead."""
    r, f = factor_days(spark, sf_dir)
    out = regress.ols(r.join(f, "d"), ["symbol"], "r", XS)
    return rounded(rounded(out, *(c for c in out.columns if c not in ("symbol", "n", "t"))), "t", digits=3)


@query(f"""WITH {FACTOR_DAYS}, z AS (
  SELECT d, (market - avg(market) OVER ()) / stddev_pop(market) OVER () AS a, (first - avg(first) OVER ()) / stddev_pop(first) OVER () AS b,
         corr(market, first) OVER () AS c
  FROM f WHERE first IS NOT NULL
), m AS (
  SELECT *, (1 / sqrt(1 + c) + 1 / sqrt(1 - c)) / 2 AS p, (1 / sqrt(1 + c) - 1 / sqrt(1 - c)) / 2 AS q FROM z
)
SELECT d, round(p * a + q * b, 6) AS market, round(q * a + p * b, 6) AS first FROM m""")
def orthogonal_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two factors made uncorrelated, each kept as near to itself as can be; in SQL by the closed form of two."""
    f = factor_days(spark, sf_dir)[1].select("d", "market", "first").dropna()
    return rounded(regress.orthogonal(f, ["market", "first"]), "market", "first", digits=6)


@query(f"""WITH {FACTOR_DAYS}, z AS (
  SELECT d, (market - avg(market) OVER ()) / stddev_pop(market) OVER () AS a, (first - avg(first) OVER ()) / stddev_pop(first) OVER () AS b,
         corr(market, first) OVER () AS c
  FROM f WHERE first IS NOT NULL
), m AS (
  SELECT *, (1 / sqrt(1 + c) + 1 / sqrt(1 - c)) / 2 AS u, (1 / sqrt(1 + c) - 1 / sqrt(1 - c)) / 2 AS w FROM z
), o AS (
  SELECT symbol, r, u * a + w * b AS x, w * a + u * b AS y FROM r JOIN m USING (d) WHERE r IS NOT NULL
), c AS (
  SELECT symbol, count(*) AS n, avg(r) AS mr, avg(x) AS mx, avg(y) AS my, var_pop(r) AS rr, var_pop(x) AS xx, var_pop(y) AS yy,
         covar_pop(r, x) AS rx, covar_pop(r, y) AS ry, covar_pop(x, y) AS xy
  FROM o GROUP BY symbol HAVING count(*) >= 250
), b AS (
  SELECT *, (rx * yy - ry * xy) / (xx * yy - xy * xy) AS bx, (ry * xx - rx * xy) / (xx * yy - xy * xy) AS b_y FROM c
)
SELECT symbol, n, round((mr - bx * mx - b_y * my) * 245, 4) AS alpha_lin, round(bx, 6) AS beta_market, round(b_y, 6) AS beta_first,
       round((bx * rx + b_y * ry) / rr, 4) AS r2
FROM b""")
def orthogonal_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol on two orthogonal factors."""
    r, f = factor_days(spark, sf_dir)
    pair = regress.orthogonal(f.select("d", "market", "first").dropna(), ["market", "first"])
    out = regress.ols(r.join(pair, "d"), ["symbol"], "r", ["market", "first"])
    return rounded(rounded(out.select("symbol", "n", "alpha_lin", "beta_market", "beta_first", "r2"), "alpha_lin", "r2"), "beta_market", "beta_first", digits=6)
