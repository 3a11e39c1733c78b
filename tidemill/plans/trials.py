"""Significance of Sharpe ratios among many trials, grids with their surroundings, and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import inference, series
from tidemill.plans.catalogue import BARS, query, rounded
from tidemill.plans.metrics import RET, returns
from tidemill.sources.tables import daily_bars, parts_of


def horner(x: str, coefficients: tuple) -> str:
    out = str(coefficients[0])
    for c in coefficients[1:]:
        out = f"({out} * ({x}) + {c})"
    return out


def cdf_sql(z: str) -> str:
    """The normal law in SQL, for a column z below 7 in size; beyond, 0 or 1."""
    x = f"abs({z})"
    tail = f"exp(-{z} * {z} / 2) * {horner(x, inference.LAW_OVER)} / {horner(x, inference.LAW_UNDER)}"
    return f"CASE WHEN {x} >= 7 THEN CASE WHEN {z} > 0 THEN 1.0 ELSE 0.0 END WHEN {z} > 0 THEN 1 - {tail} ELSE {tail} END"


def quantile_sql(p: str) -> str:
    tail = lambda q: f"{horner(q, inference.TAIL_OVER)} / {horner(q, inference.TAIL_UNDER)}"
    middle = f"{horner(f'({p} - 0.5) * ({p} - 0.5)', inference.MIDDLE_OVER)} * ({p} - 0.5) / {horner(f'({p} - 0.5) * ({p} - 0.5)', inference.MIDDLE_UNDER)}"
    return f"CASE WHEN {p} < 0.02425 THEN {tail(f'sqrt(-2 * ln({p}))')} WHEN {p} > 1 - 0.02425 THEN -{tail(f'sqrt(-2 * ln(1 - {p}))')} ELSE {middle} END"


def moments_sql(source: str, keys: str, r: str) -> str:
    """A select of keys, n, sr, skew, kurt, se of the returns r in source."""
    return f"""SELECT *, sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1)) AS se FROM (
  SELECT {keys}, count(*) AS n, any_value(m) / any_value(sd) AS sr, avg(pow(({r} - m) / sd, 3)) AS skew, avg(pow(({r} - m) / sd, 4)) AS kurt
  FROM (SELECT *, avg({r}) OVER (PARTITION BY {keys}) AS m, stddev_pop({r}) OVER (PARTITION BY {keys}) AS sd FROM {source}) GROUP BY {keys})"""


EXCESS = f"""{BARS}, {RET}, e AS (
  SELECT symbol, d, r - avg(r) OVER (PARTITION BY d) AS e FROM r WHERE r IS NOT NULL
)"""

BEST = f"""(0.42278433509846714 * ({quantile_sql('p1')}) + 0.5772156649015329 * ({quantile_sql('p2')}))"""


def excess_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """symbol, d, r (a day's return) and e, what it exceeds the day's mean of all symbols by."""
    r = returns(spark, sf_dir).where("r is not null").select("symbol", "d", "r")
    return r.join(F.broadcast(r.groupBy("d").agg(F.avg("r").alias("b"))), "d").select("symbol", "d", "r", (F.col("r") - F.col("b")).alias("e"))


@query(f"""WITH {EXCESS}, m AS ({moments_sql('e', 'symbol', 'e')}), t AS (
  SELECT count(*) AS trials, 1 - 1.0::DOUBLE / count(*) AS p1, 1 - 1.0::DOUBLE / (count(*) * exp(1.0::DOUBLE)) AS p2 FROM m
), z AS (
  SELECT m.*, trials, sr / se AS z0, (sr - CASE WHEN trials > 1 THEN se * {BEST} ELSE 0 END) / se AS z1 FROM m, t
)
SELECT symbol, trials, round(sr, 6) AS sharpe, round(se, 6) AS se, round(skew, 4) AS skew, round(kurt, 4) AS kurt,
       round({cdf_sql('z0')}, 6) AS psr, round({cdf_sql('z1')}, 6) AS dsr FROM z""")
def sharpe_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sharpe ratio of each symbol's excess returns, its standard error, the chance that it is above 0, and
    above the best that as many trials as there are symbols have by chance."""
    m = inference.sharpe_moments(excess_returns(spark, sf_dir), ["symbol"], "e")
    trials = m.agg(F.count("*").alias("trials"))  # one row
    x = inference.significance(m.crossJoin(F.broadcast(trials)), F.col("trials"))
    x = x.select("symbol", "trials", F.col("sr").alias("sharpe"), "se", "skew", "kurt", "psr", "dsr")
    return rounded(rounded(x, "sharpe", "se", "psr", "dsr", digits=6), "skew", "kurt")


TRIALS = (1, 2, 10, 1000)


@query(f"""WITH {EXCESS}, m AS ({moments_sql('e', 'symbol', 'e')}), t AS (
  SELECT trials, 1 - 1.0::DOUBLE / trials AS p1, 1 - 1.0::DOUBLE / (trials * exp(1.0::DOUBLE)) AS p2 FROM (SELECT unnest([1, 2, 10, 1000]) AS trials)
), b AS (
  SELECT symbol, trials, sr, se, CASE WHEN trials > 1 THEN se * {BEST.replace("ln(", "ln(1e-300 + ")} ELSE 0 END AS best FROM m, t
), z AS (SELECT *, (sr - best) / se AS z FROM b)
SELECT symbol, trials, round(best, 6) AS best, round({cdf_sql('z')}, 6) AS dsr FROM z""")
def sharpe_by_trials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How the significance of each ratio falls as it is taken for the best of more trials."""
    m = inference.sharpe_moments(excess_returns(spark, sf_dir), ["symbol"], "e")
    x = m.withColumn("trials", F.explode(F.array(*map(F.lit, TRIALS))))
    x = inference.significance(x, F.col("trials")).withColumn("best", inference.best_by_chance(F.col("se"), F.col("trials")))
    return rounded(x.select("symbol", "trials", "best", "dsr"), "best", "dsr", digits=6)


FAST, SLOW, DECLARED, DELTAS = (3, 5, 10), (10, 20, 40), 12, (0.1, 0.2, 0.34)


def strategy_returns(spark: SparkSession, sf_dir: str, pairs: list[tuple[int, int]]) -> DataFrame:
    """fast, slow, d, e: mean excess return of the symbols whose fast mean was above their slow one two
    days before. Bars are read once, and a day's means of all pairs are one row, spread afterwards.

    A moving mean is the difference of two running sums: of whole millionths, to which closes are rounded,
    so that it is exact and costs the same for any length."""
    w, lengths = series.by_day(), sorted({n for p in pairs for n in p})
    sofar = F.struct(F.sum(F.round(F.col("close") * 1e6).cast("long")).over(w).alias("s"), F.count("close").over(w).alias("n"))
    was = lambda n, c: F.coalesce(F.lag("_all", n).over(w)[c], F.lit(0))
    mean = lambda n: F.round((F.col("_all")["s"] - was(n, "s")) / (F.nullif(F.col("_all")["n"] - was(n, "n"), F.lit(0)) * 1e6), 9)
    x = daily_bars(spark, sf_dir, parts_of(spark, sf_dir, "lineitem")).select("symbol", "d", "close", sofar.alias("_all"))
    x = x.select("symbol", "d", (F.col("close") / F.lag("close").over(w) - 1).alias("r"), *(mean(n).alias(f"m{n}") for n in lengths))
    held = x.select("d", "r", *(F.lag(F.col(f"m{f}") > F.col(f"m{s}"), 2).over(w).alias(f"h{f}_{s}") for f, s in pairs)).where("r is not null")
    day = held.groupBy("d").agg(F.avg("r").alias("b"), *(F.avg(F.when(F.col(f"h{f}_{s}"), F.col("r"))).alias(f"r{f}_{s}") for f, s in pairs))
    runs = F.array(*(F.struct(F.lit(f).alias("fast"), F.lit(s).alias("slow"), F.col(f"r{f}_{s}").alias("r")) for f, s in pairs))
    return day.select("d", "b", F.explode(runs).alias("g")).where("g.r is not null").select("g.fast", "g.slow", "d", (F.col("g.r") - F.col("b")).alias("e"))


def strategy_sql(pairs: str) -> str:
    """CTEs that end in s(fast, slow, d, e) for the pairs in a CTE of this name; frames as wide as the row says."""
    return f"""x AS (
  SELECT fast, slow, symbol, d, close / lag(close) OVER w - 1 AS r,
         round(avg(close) OVER (w ROWS BETWEEN fast - 1 PRECEDING AND CURRENT ROW), 9) > round(avg(close) OVER (w ROWS BETWEEN slow - 1 PRECEDING AND CURRENT ROW), 9) AS above
  FROM bars, {pairs} WINDOW w AS (PARTITION BY fast, slow, symbol ORDER BY d)
), h AS (
  SELECT *, lag(above, 2) OVER (PARTITION BY fast, slow, symbol ORDER BY d) AS held FROM x
), s AS (
  SELECT fast, slow, d, avg(r) FILTER (held) - avg(r) AS e FROM h WHERE r IS NOT NULL GROUP BY fast, slow, d HAVING count(*) FILTER (held) > 0
)"""


GRID = f"g AS (SELECT fast, slow FROM (SELECT unnest({list(FAST)}) AS fast), (SELECT unnest({list(SLOW)}) AS slow) WHERE fast < slow)"


def grid_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = [(f, s) for f in FAST for s in SLOW if f < s]
    return inference.sharpe_moments(strategy_returns(spark, sf_dir, pairs), ["fast", "slow"], "e")


@query(f"""WITH {BARS}, {GRID}, {strategy_sql('g')}, m AS ({moments_sql('s', 'fast, slow', 'e')}), t AS (
  SELECT count(*) + {DECLARED} AS trials, 1 - 1.0::DOUBLE / (count(*) + {DECLARED}) AS p1, 1 - 1.0::DOUBLE / ((count(*) + {DECLARED}) * exp(1.0::DOUBLE)) AS p2 FROM m
), z AS (SELECT m.*, trials, sr / se AS z0, (sr - se * {BEST}) / se AS z1 FROM m, t)
SELECT fast, slow, n AS days, trials, round(sr, 6) AS sharpe, round({cdf_sql('z0')}, 6) AS psr, round({cdf_sql('z1')}, 6) AS dsr,
       row_number() OVER (ORDER BY round(sr, 9) DESC NULLS LAST, fast, slow) AS place, round(0.05 / trials, 6) AS threshold FROM z""")
def grid_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of two lengths ranked by Sharpe ratio, with the significance that all its points and twelve
    trials declared before leave to each."""
    m = grid_moments(spark, sf_dir)
    trials = m.agg((F.count("*") + DECLARED).alias("trials"))  # one row
    x = inference.significance(m.crossJoin(F.broadcast(trials)), F.col("trials"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last(F.round("sr", 9)), "fast", "slow")).cast("long")  # a row a grid point
    x = x.select("fast", "slow", F.col("n").alias("days"), "trials", F.col("sr").alias("sharpe"), "psr", "dsr", place.alias("place"), (0.05 / F.col("trials")).alias("threshold"))
    return rounded(x, "sharpe", "psr", "dsr", "threshold", digits=6)


def near_points(fast: int, slow: int) -> list[tuple[str, int]]:
    """Each of two whole parameters moved by each share, down and up, to the nearest whole number; a move
    that changes nothing, or repeats another, is left out."""
    out = []
    for name, value in (("fast", fast), ("slow", slow)):
        for delta in DELTAS:
            out += [(name, near) for near in (round(value * (1 - delta)), round(value * (1 + delta))) if near != value and (name, near) not in out]
    return out


@query(f"""WITH {BARS}, {GRID}, {strategy_sql('g')}, m AS ({moments_sql('s', 'fast, slow', 'e')}), top AS (
  SELECT fast AS f0, slow AS s0, sr AS base FROM m ORDER BY round(sr, 9) DESC NULLS LAST, fast, slow LIMIT 1
), near AS (
  SELECT DISTINCT parameter, round_even(CASE parameter WHEN 'fast' THEN f0 ELSE s0 END * k::DOUBLE, 0)::INTEGER AS v, f0, s0, base
  FROM top, (SELECT unnest(['fast', 'slow']) AS parameter), (SELECT unnest([{', '.join(f'1 - {d}::DOUBLE, 1 + {d}::DOUBLE' for d in DELTAS)}]) AS k)
), q AS (
  SELECT parameter, v, base, CASE parameter WHEN 'fast' THEN v ELSE f0 END AS fast, CASE parameter WHEN 'slow' THEN v ELSE s0 END AS slow
  FROM near WHERE v <> CASE parameter WHEN 'fast' THEN f0 ELSE s0 END
), p AS (SELECT * FROM ({strategy_sql('q').replace('x AS (', 'WITH x AS (', 1)} {moments_sql('s', 'fast, slow', 'e')})),
v AS (SELECT parameter, v, base, sr FROM q JOIN p USING (fast, slow))
SELECT parameter, v AS value, round(base, 6) AS base, round(sr, 6) AS sharpe, count(*) OVER () AS n_points, round(max(sr) OVER () - min(sr) OVER (), 6) AS range,
       round(stddev_pop(sr) OVER (), 6) AS sd, round(greatest(0, base - min(sr) OVER ()) / abs(base), 4) AS degradation,
       greatest(0, base - min(sr) OVER ()) / abs(base) > 0.5 AS sensitive FROM v""")
def grid_perturbation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The surroundings of the grid's best point: each parameter moved by shares, what the worst of them
    loses, and whether that is over a half. The best point, a row of the grid, is known to the driver."""
    first = grid_moments(spark, sf_dir).orderBy(F.desc_nulls_last(F.round("sr", 9)), "fast", "slow").first()
    fields = "parameter string, value int, fast int, slow int"
    if first is None:
        points, pairs, base = [], [], None
    else:
        points = [(n, v, v if n == "fast" else first.fast, v if n == "slow" else first.slow) for n, v in near_points(first.fast, first.slow)]
        pairs, base = sorted({p[2:] for p in points}), first.sr
    asked = spark.createDataFrame(points, fields)
    m = inference.sharpe_moments(strategy_returns(spark, sf_dir, pairs or [(1, 2)]), ["fast", "slow"], "e")
    x = asked.join(m, ["fast", "slow"]).select("parameter", "value", F.lit(base).cast("double").alias("base"), F.col("sr").alias("sharpe"))
    every = Window.partitionBy()  # a row a point
    least = F.min("sharpe").over(every)
    loss = F.greatest(F.lit(0.0), F.col("base") - least) / F.when(F.abs("base") > 1e-12, F.abs("base"))
    x = x.withColumns({"n_points": F.count("*").over(every), "range": F.max("sharpe").over(every) - least, "sd": F.stddev_pop("sharpe").over(every), "degradation": loss})
    return rounded(rounded(x.withColumn("sensitive", F.col("degradation") > 0.5), "base", "sharpe", "range", "sd", digits=6), "degradation")


# Without SQL: seeded draws. Tested against the same draws in plain Python and by their moments.


@query()
def bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, Sharpe ratio and annual return of each symbol's excess returns with points of 200 resamples."""
    return inference.bootstrap(excess_returns(spark, sf_dir), "symbol", "e", ["symbol", "d"], 200, 7)


@query()
def permutation_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often 200 random signs give each symbol a Sharpe ratio as far from 0, and its place among them."""
    return inference.sign_flips(excess_returns(spark, sf_dir), "symbol", "e", ["symbol", "d"], 200, 7)


@query()
def drawdown_order_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each symbol's largest drawdown among those of 50 shuffled orders of its days. Excess returns are cut at
    half a day's value, which keeps net values above nothing."""
    e = excess_returns(spark, sf_dir).withColumn("e", F.least(F.greatest("e", F.lit(-0.5)), F.lit(0.5)))
    return inference.order_test(e, "symbol", "e", "d", 50, 7)


@query()
def noise_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each strategy of the grid stands among 500 portfolios that hold as many days drawn at random."""
    pairs = [(f, s) for f in FAST for s in SLOW if f < s]
    own = strategy_returns(spark, sf_dir, pairs)
    pool = own.groupBy("d").agg(F.avg("e").alias("e"))
    draws = inference.random_holdings(pool, "d", "e", 250, 500, 7)
    m = inference.sharpe_moments(own, ["fast", "slow"], "e").withColumn("sharpe", F.col("sr") * F.sqrt((F.col("n") - 1) / F.col("n")) * 252**0.5)
    met = m.select("fast", "slow", "sharpe").crossJoin(F.broadcast(draws.agg(F.sort_array(F.collect_list("sharpe")).alias("draws"))))  # 500 numbers
    share = F.size(F.filter("draws", lambda x: x <= F.col("sharpe"))) / F.size("draws")
    middle = lambda q: F.element_at("draws", F.greatest(F.lit(1), F.ceil(F.size("draws") * q)).cast("int"))
    return met.where(F.size("draws") > 0).select("fast", "slow", "sharpe", share.alias("place"), middle(0.05).alias("p05"), middle(0.5).alias("p50"), middle(0.95).alias("p95"))
