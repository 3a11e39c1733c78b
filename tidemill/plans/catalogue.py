"""Every registered analytics query by name, and its SQL on the same tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import classify
from tidemill.operators import maintenance, series, simulate, temporal
from tidemill.sources.tables import calendar, daily_bars, load, parts_of

QUERIES: dict = {}
ORACLE_SQL: dict = {}

BARS = """bars AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS d, round(sum(l_extendedprice) / sum(l_quantity), 6) AS close,
 round(max(l_extendedprice / l_quantity), 6) AS high, round(min(l_extendedprice / l_quantity), 6) AS low, CAST(sum(l_quantity) AS DOUBLE) AS vol,
 round(sum(l_extendedprice), 2) AS amount FROM lineitem GROUP BY 1, 2)"""
FACTORS = "factors AS (SELECT symbol, min(d) AS d, 1 + CAST(0.01 AS DOUBLE) * (year(min(d)) * 12 + month(min(d)) - 23900) - CASE WHEN month(min(d)) = 6 THEN CAST(0.05 AS DOUBLE) ELSE 0 END AS factor FROM bars GROUP BY symbol, year(d), month(d))"


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def factors(bars: DataFrame) -> DataFrame:
    """An adjustment factor from each symbol's first day in a month on, that rises but for June."""
    first = bars.groupBy("symbol", F.year("d").alias("y"), F.month("d").alias("m")).agg(F.min("d").alias("d"))
    return first.select("symbol", "d", (1 + 0.01 * (F.col("y") * 12 + F.col("m") - 23900) - F.when(F.col("m") == 6, 0.05).otherwise(0.0)).alias("factor"))


def rounded(df: DataFrame, *columns: str, digits: int = 4) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


DRAWDOWN = f"""WITH {BARS}, r AS (SELECT symbol, d, close / lag(close) OVER w - 1 AS r, close / max(close) OVER w - 1 AS dd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))
SELECT symbol, round(stddev_samp(r) * sqrt(252), 4) AS ann_vol, round(min(dd), 4) AS max_drawdown, count(*) AS days FROM r GROUP BY symbol"""


@query(DRAWDOWN)
def drawdown_by_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = daily_bars(spark, sf_dir)
    r = b.select("symbol", (F.col("close") / F.lag("close").over(series.by_day()) - 1).alias("r"), series.drawdown("close").alias("dd"))
    return r.groupBy("symbol").agg(F.round(F.stddev_samp("r") * 252**0.5, 4).alias("ann_vol"), F.round(F.min("dd"), 4).alias("max_drawdown"), F.count("*").alias("days"))


@query(f"""WITH {BARS}, r AS (SELECT symbol, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars)
SELECT symbol, round((avg(r) - (pow(1.02, 1 / 252.0) - 1)) / stddev_samp(r) * sqrt(252), 4) AS sharpe, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END), 4) AS win_rate,
round(avg(r) FILTER (r > 0) / abs(avg(r) FILTER (r < 0)), 4) AS profit_loss FROM r WHERE r IS NOT NULL GROUP BY symbol""")
def sharpe_win_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_bars(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(series.by_day()) - 1).where("r is not null")
    win, loss = F.avg(F.when(F.col("r") > 0, F.col("r"))), F.avg(F.when(F.col("r") < 0, F.col("r")))
    return r.groupBy("symbol").agg(F.round((F.avg("r") - (1.02 ** (1 / 252) - 1)) / F.stddev_samp("r") * 252**0.5, 4).alias("sharpe"), F.round(F.avg((F.col("r") > 0).cast("double")), 4).alias("win_rate"), F.round(win / F.abs(loss), 4).alias("profit_loss"))


@query(f"""WITH {BARS}, r AS (SELECT symbol, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars), m AS (SELECT d, avg(r) AS b FROM r WHERE r IS NOT NULL GROUP BY d)
SELECT symbol, round(covar_samp(r, b) / var_samp(b), 4) AS beta, round(stddev_samp(r - b) * sqrt(252), 4) AS tracking_error, round(avg(r - b) / stddev_samp(r - b) * sqrt(252), 4) AS information_ratio,
round(avg(r) FILTER (b > 0) / avg(b) FILTER (b > 0), 4) AS up_capture, round(avg(r) FILTER (b < 0) / avg(b) FILTER (b < 0), 4) AS down_capture, round(corr(r, b), 4) AS corr FROM r JOIN m USING (d) WHERE r IS NOT NULL GROUP BY symbol""")
def relative_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_bars(spark, sf_dir).withColumn("r", F.col("close") / F.lag("close").over(series.by_day()) - 1).where("r is not null").select("symbol", "d", "r")
    x = r.join(r.groupBy("d").agg(F.avg("r").alias("b")), "d")
    part = lambda c, cond: F.avg(F.when(cond, F.col(c)))
    up, down = F.col("b") > 0, F.col("b") < 0
    e = F.col("r") - F.col("b")
    return x.groupBy("symbol").agg(*(F.round(v, 4).alias(k) for k, v in {"beta": F.covar_samp("r", "b") / F.var_samp("b"), "tracking_error": F.stddev_samp(e) * 252**0.5, "information_ratio": F.avg(e) / F.stddev_samp(e) * 252**0.5, "up_capture": part("r", up) / part("b", up), "down_capture": part("r", down) / part("b", down), "corr": F.corr("r", "b")}.items()))


@query(f"""WITH {BARS}, r AS (SELECT symbol, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars)
SELECT symbol, CAST(year(d) AS INTEGER) AS y, CAST(month(d) AS INTEGER) AS m, round(product(1 + coalesce(r, 0)) - 1, 4) AS ret FROM r GROUP BY 1, 2, 3""")
def monthly_compound(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = daily_bars(spark, sf_dir).withColumn("r", F.coalesce(F.col("close") / F.lag("close").over(series.by_day()) - 1, F.lit(0.0)))
    return r.groupBy("symbol", F.year("d").alias("y"), F.month("d").alias("m")).agg(F.round(F.product(1 + F.col("r")) - 1, 4).alias("ret"))


WINDOW = "WINDOW w AS (PARTITION BY symbol ORDER BY d)"


@query(f"""WITH {BARS}, x AS (SELECT symbol, d, (close / lag(close, 20) OVER w - 1) * 100 AS chg, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN sum(vol) OVER (w ROWS 4 PRECEDING) * 3 / sum(vol) OVER (w ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING) END AS vr, (close / lag(close) OVER w - 1) * 100 AS day FROM bars {WINDOW}),
v AS (SELECT *, CASE WHEN abs(chg) > 1.5 THEN 2 * sign(chg) WHEN abs(chg) > 0.3 THEN sign(chg) ELSE 0 END AS a, CASE WHEN vr > 1.05 THEN sign(chg) WHEN vr < 0.95 THEN -abs(sign(chg)) ELSE 0 END AS b, CASE WHEN abs(day) > 4 THEN 2 * sign(day) WHEN abs(day) > 2 THEN sign(day) ELSE 0 END AS c FROM x)
SELECT symbol, d, round(chg, 4) AS chg, round(vr, 4) AS vr, CAST(greatest(-6, least(6, coalesce(a, 0) + coalesce(b, 0) + coalesce(c, 0))) AS INTEGER) AS beta FROM v""")
def volume_and_beta_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = daily_bars(spark, sf_dir).select("symbol", "d", series.change_pct("close", 20).alias("chg"), series.volume_ratio("vol").alias("vr"), series.change_pct("close", 1).alias("day"))
    return rounded(x.withColumn("beta", classify.beta_score(F.col("chg"), F.col("vr"), F.col("day"))).drop("day"), "chg", "vr")


@query(f"""WITH {BARS}, s AS (SELECT symbol, d, close - lag(close) OVER w AS s FROM bars {WINDOW}), x AS (SELECT symbol, d, count(s) OVER (w ROWS 13 PRECEDING) AS n, coalesce(avg(s) FILTER (s > 0) OVER (w ROWS 13 PRECEDING), 0) AS up, coalesce(avg(-s) FILTER (s < 0) OVER (w ROWS 13 PRECEDING), 1e-9) AS down FROM s {WINDOW})
SELECT symbol, d, CASE WHEN n = 14 THEN round(100 - 100 / (1 + up / down), 4) END AS rsi FROM x""")
def rsi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.rsi(daily_bars(spark, sf_dir)).select("symbol", "d", "rsi"), "rsi")


@query(f"""WITH {BARS}, x AS (SELECT symbol, d, close, high, low, count(*) OVER w20 AS n, avg(close) OVER w20 AS mid, stddev_pop(close) OVER w20 AS dev, count(*) OVER w14 AS n14, min(low) OVER w14 AS lo, max(high) OVER w14 AS hi FROM bars
WINDOW w20 AS (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING), w14 AS (PARTITION BY symbol ORDER BY d ROWS 13 PRECEDING))
SELECT symbol, d, CASE WHEN n = 20 THEN round(mid + 2 * dev, 3) END AS upper, CASE WHEN n = 20 THEN round(mid - 2 * dev, 3) END AS lower, CASE WHEN n14 = 14 THEN CASE WHEN hi = lo THEN 50.0 ELSE round((close - lo) / (hi - lo) * 100, 4) END END AS rsv FROM x""")
def bollinger_and_rsv(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = series.stochastic(series.bollinger(daily_bars(spark, sf_dir)))
    return rounded(rounded(x, "rsv").select("symbol", "d", "upper", "lower", "rsv"), "upper", "lower", digits=3)


@query(f"""WITH {BARS}, x AS (SELECT symbol, d, close, count(*) OVER (w ROWS 54 PRECEDING) AS n, avg(close) OVER (w ROWS 12 PRECEDING) AS a, avg(close) OVER (w ROWS 20 PRECEDING) AS b, avg(close) OVER (w ROWS 33 PRECEDING) AS c, avg(close) OVER (w ROWS 54 PRECEDING) AS e FROM bars {WINDOW})
SELECT symbol, d, CASE WHEN n = 55 THEN round((a + b + c + e) / 4, 3) END AS bbi FROM x""")
def bbi_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = sum((series.moving_mean("close", n) for n in (13, 21, 34, 55)), F.lit(0.0)) / 4
    return rounded(daily_bars(spark, sf_dir).select("symbol", "d", mean.alias("bbi")), "bbi", digits=3)


@query(f"""WITH RECURSIVE {BARS}, n AS (SELECT symbol, close, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM bars), e AS (SELECT symbol, i, close AS fast, close AS slow, CAST(0 AS DOUBLE) AS dea FROM n WHERE i = 1
UNION ALL SELECT n.symbol, n.i, e.fast * (1 - 2 / 13.0) + n.close * (2 / 13.0), e.slow * (1 - 2 / 27.0) + n.close * (2 / 27.0), e.dea * 0.8 + 0.2 * ((e.fast * (1 - 2 / 13.0) + n.close * (2 / 13.0)) - (e.slow * (1 - 2 / 27.0) + n.close * (2 / 27.0))) FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
SELECT symbol, round(fast - slow, 3) AS dif, round(dea, 3) AS dea, round(2 * (fast - slow - dea), 3) AS hist FROM e QUALIFY i = max(i) OVER (PARTITION BY symbol)""")
def macd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(series.macd(daily_bars(spark, sf_dir)), "dif", "dea", "hist", digits=3)


@query(f"""WITH {BARS}, {FACTORS}, q AS (SELECT * FROM factors WHERE month(d) IN (1, 4, 7, 10) AND symbol > 2), l AS (SELECT symbol, max_by(factor, d) AS last, min_by(factor, d) AS first FROM q GROUP BY symbol)
SELECT b.symbol, b.d, round(b.close * coalesce(f.factor, l.first, 1.0) + 2e-9, 4) AS hfq, round(b.close * coalesce(f.factor, l.first, 1.0) / coalesce(l.last, 1.0) + 2e-9, 4) AS qfq FROM bars b ASOF LEFT JOIN q f ON b.symbol = f.symbol AND b.d >= f.d LEFT JOIN l ON l.symbol = b.symbol""")
def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices times the factor of their day, forward and backward adjusted. Factors come in quarter months
    and not for every symbol: before a symbol's first factor that one counts, without factors 1."""
    b = daily_bars(spark, sf_dir)
    f = factors(b).where("month(d) in (1, 4, 7, 10) and symbol > 2")
    last = f.groupBy("symbol").agg(F.max_by("factor", "d").alias("last"))
    x = temporal.asof_join(b, f, "symbol", "d", "factor", first_as_fallback=True, default=1.0).join(last, "symbol", "left")
    hfq = F.col("close") * F.col("factor")
    return x.select("symbol", "d", F.round(hfq + 2e-9, 4).alias("hfq"), F.round(hfq / F.coalesce("last", F.lit(1.0)) + 2e-9, 4).alias("qfq"))


@query(f"""WITH {BARS}, {FACTORS} SELECT b.symbol, b.d, round(f.factor, 6) AS strict, round(CASE WHEN date_diff('day', t.d, b.d) <= 5 THEN t.factor END, 6) AS near, round(n.factor, 6) AS ahead
FROM bars b ASOF LEFT JOIN factors f ON b.symbol = f.symbol AND b.d > f.d ASOF LEFT JOIN factors t ON b.symbol = t.symbol AND b.d >= t.d ASOF LEFT JOIN factors n ON b.symbol = n.symbol AND b.d <= n.d""")
def asof_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = parts_of(spark, sf_dir, "lineitem")
    b = daily_bars(spark, sf_dir, parts)
    asked = {"strict": {"strict": True}, "near": {"tolerance_days": 5}, "ahead": {"forward": True}}
    out = temporal.asof_joins(b.select("symbol", "d"), factors(b), "symbol", "d", "factor", asked, parts)
    return rounded(out, "strict", "near", "ahead", digits=6)


SPANS = "spans AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(o_orderdate AS DATE) + CAST(30 + o_orderkey % 20 AS INTEGER) AS e FROM orders)"


def spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("s"), F.date_add(F.to_date("o_orderdate"), (30 + F.col("o_orderkey") % 20).cast("int")).alias("e"))


@query(f"WITH {SPANS} SELECT o_orderkey, count(*) AS n FROM orders JOIN spans ON o_custkey = k AND CAST(o_orderdate AS DATE) >= s AND CAST(o_orderdate AS DATE) < e GROUP BY 1")
def interval_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), "o_orderkey", F.to_date("o_orderdate").alias("d"))
    """How many spans of its customer each order lies in, counted by opened and closed spans."""
    return temporal.interval_counts(points, spans(spark, sf_dir), "k", "d", "s", "e").where("n > 0").select("o_orderkey", "n")


@query("""WITH x AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS s, CAST(lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS DATE) AS e, o_orderstatus AS name FROM orders), m AS (SELECT DISTINCT last_day(CAST(o_orderdate AS DATE)) AS d FROM orders)
SELECT DISTINCT k, d FROM x JOIN m ON d >= s AND (e IS NULL OR d < e) WHERE name = 'P'""")
def marked_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month ends on which a customer's span of one kind is open; the last span has no end."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = load(spark, sf_dir, "orders")
    x = o.select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("s"), F.to_date(F.lead("o_orderdate").over(w)).alias("e"), "o_orderstatus").where("o_orderstatus = 'P'")
    last = o.agg(F.last_day(F.to_date(F.max("o_orderdate"))).alias("last"))  # one row
    own = x.groupBy("k").agg(F.min(F.trunc("s", "month")).alias("a")).join(F.broadcast(last), F.lit(True))
    points = own.select("k", F.explode(F.sequence("a", "last", F.expr("interval 1 month"))).alias("m")).select("k", F.last_day("m").alias("d"))
    return temporal.interval_join(points, x.select("k", "s", "e"), "k", "d", "s", "e").select("k", "d").distinct()


@query(f"""WITH {SPANS}, x AS (SELECT *, max(e) OVER (PARTITION BY k ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM spans), y AS (SELECT *, sum(CASE WHEN reach IS NULL OR s - reach > 3 THEN 1 ELSE 0 END) OVER (PARTITION BY k ORDER BY s, e) AS i FROM x)
SELECT k, min(s) AS s, max(e) AS e, count(*) AS parts FROM y GROUP BY k, i""")
def span_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return temporal.islands(spans(spark, sf_dir), "k", "s", "e", 3)


@query("""WITH a AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS d FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey, o_orderkey AS other, CAST(o_orderdate AS DATE) AS od FROM orders WHERE o_orderstatus = 'O')
SELECT o_orderkey, other, CAST(d - od AS INTEGER) AS gap FROM a JOIN b USING (o_custkey) WHERE d - od BETWEEN 0 AND 60 QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY d - od, other) = 1""")
def nearest_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("d"))
    b = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("other"), F.to_date("o_orderdate").alias("od"))
    return temporal.nearest_before(a, b, "o_custkey", "d", "od", 60, [F.col("other")]).select("o_orderkey", "other", F.datediff("d", "od").alias("gap"))


@query("SELECT o_custkey, o_orderkey, o_totalprice FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) = 1")
def pit_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").where(F.col("o_orderdate") <= F.lit("1998-06-30").cast("timestamp"))
    return temporal.latest_by(o, ["o_custkey"], [F.desc("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("""SELECT p_partkey, code, board, CAST(CASE WHEN board = 'bse' THEN 0.3 WHEN board IN ('gem', 'star') THEN 0.2 WHEN p_partkey % 7 = 0 THEN 0.05 ELSE 0.1 END AS DOUBLE) AS lim FROM (SELECT p_partkey, CASE WHEN regexp_matches(x, '^[569]') THEN x || '.SH' WHEN regexp_matches(x, '^(4|8)') THEN x || '.BJ' ELSE x || '.SZ' END AS code,
CASE WHEN regexp_matches(x, '^(300|301|302)') THEN 'gem' WHEN regexp_matches(x, '^(688|689)') THEN 'star' WHEN regexp_matches(x, '^(4|8|920)') THEN 'bse' ELSE 'main' END AS board FROM (SELECT p_partkey, lpad(CAST((p_partkey * 7919) % 1000000 AS VARCHAR), 6, '0') AS x FROM part))""")
def codes_and_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = load(spark, sf_dir, "part").select("p_partkey", F.lpad(((F.col("p_partkey") * 7919) % 1000000).cast("string"), 6, "0").alias("x"))
    b = classify.board(F.col("x"))
    return p.select("p_partkey", classify.exchange_code(F.col("x")).alias("code"), b.alias("board"), classify.limit_pct(b, F.col("p_partkey") % 7 == 0, F.lit("2020-01-01").cast("date")).alias("lim"))


BREADTH = f"""{BARS}, x AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY d) * 0.9 AS floor FROM bars), day AS (SELECT d, count(*) AS n, CAST(sum(CASE WHEN floor > 0 AND close <= floor * 1.0001 THEN 1 ELSE 0 END) AS BIGINT) AS down FROM x WHERE floor IS NOT NULL GROUP BY d)"""


def breadth_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = daily_bars(spark, sf_dir).withColumn("floor", F.lag("close").over(series.by_day()) * 0.9).where("floor is not null")
    return x.groupBy("d").agg(F.count("*").alias("n"), F.sum(classify.touches_down(F.col("close"), F.col("floor")).cast("long")).alias("down"))


@query(f"WITH {BREADTH} SELECT d, n, down, round(100.0 * down / n, 4) AS pct FROM day")
def breadth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return breadth_days(spark, sf_dir).withColumn("pct", F.round(100.0 * F.col("down") / F.col("n"), 4))


@query(f"""WITH RECURSIVE {BREADTH}, r AS (SELECT d, CASE WHEN down * 100 >= 45 * n THEN 'CRISIS' WHEN down * 100 >= 40 * n THEN 'WATCH' ELSE 'NORMAL' END AS raw, row_number() OVER (ORDER BY d) AS i FROM day),
m AS (SELECT CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS d, '' AS raw, '' AS status, 'IDLE' AS phase, 0 AS k UNION ALL SELECT r.i, r.d, r.raw,
CASE WHEN r.raw = 'CRISIS' OR (r.raw = 'WATCH' AND phase <> 'IDLE') THEN 'CRISIS' WHEN r.raw = 'WATCH' THEN 'WATCH' WHEN phase = 'CONFIRM' AND k + 1 < 3 THEN 'CRISIS' WHEN phase = 'CONFIRM' OR (phase = 'RECOVERY' AND k + 1 < 3) THEN 'RECOVERY' ELSE 'NORMAL' END,
CASE WHEN r.raw = 'CRISIS' OR (r.raw = 'WATCH' AND phase <> 'IDLE') THEN 'CONFIRM' WHEN r.raw = 'WATCH' THEN 'IDLE' WHEN phase = 'CONFIRM' AND k + 1 < 3 THEN 'CONFIRM' WHEN phase = 'CONFIRM' OR (phase = 'RECOVERY' AND k + 1 < 3) THEN 'RECOVERY' ELSE 'IDLE' END,
CASE WHEN r.raw = 'NORMAL' AND phase IN ('CONFIRM', 'RECOVERY') AND k + 1 < 3 THEN k + 1 ELSE 0 END FROM m JOIN r ON r.i = m.i + 1) SELECT d, raw, status FROM m WHERE i > 0""")
def liquidity_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = 100 * F.col("down")
    raw = F.when(share >= 45 * F.col("n"), "CRISIS").when(share >= 40 * F.col("n"), "WATCH").otherwise("NORMAL")
    return simulate.liquidity_states(breadth_days(spark, sf_dir).select("d", raw.alias("raw")))


@query(f"""WITH RECURSIVE {BARS}, x AS (
  SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY d) * 0.9 AS floor FROM bars
), day AS (
  SELECT CASE WHEN symbol % 2 = 0 THEN 'even' ELSE 'odd' END AS market, d, count(*) AS n, count(*) FILTER (floor > 0 AND close <= floor * 1.0001) AS down FROM x WHERE floor IS NOT NULL GROUP BY 1, 2
), r AS MATERIALIZED (
  SELECT market, d, CASE WHEN down * 100 >= 45 * n THEN 'CRISIS' WHEN down * 100 >= 40 * n THEN 'WATCH' ELSE 'NORMAL' END AS raw, row_number() OVER (PARTITION BY market ORDER BY d) AS i FROM day
), m AS (
  SELECT market, CAST(0 AS BIGINT) AS i, CAST(NULL AS DATE) AS d, '' AS raw, '' AS status, 0 AS crisis, 0 AS calm FROM r GROUP BY market
  UNION ALL
  SELECT r.market, r.i, r.d, r.raw,
         CASE WHEN r.raw = 'CRISIS' OR (r.raw = 'WATCH' AND crisis + calm > 0) THEN 'CRISIS' WHEN r.raw = 'WATCH' THEN 'WATCH' WHEN crisis > 1 THEN 'CRISIS' WHEN crisis = 1 OR calm > 1 THEN 'RECOVERY' ELSE 'NORMAL' END,
         CASE WHEN r.raw = 'CRISIS' OR (r.raw = 'WATCH' AND crisis + calm > 0) THEN 3 ELSE greatest(0, crisis - 1) END,
         CASE WHEN r.raw <> 'NORMAL' THEN 0 WHEN crisis = 1 THEN 3 ELSE greatest(0, calm - 1) END
  FROM m JOIN r ON r.market = m.market AND r.i = m.i + 1
)
SELECT market, d, raw, status FROM m WHERE i > 0""")
def liquidity_streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The machine of two markets kept up by a stream that takes a year of raw states at a time; a last row
    far ahead lets the watermark pass all days."""
    from tidemill.streaming.events import shared_folder
    from tidemill.streaming.liquidity import liquidity_stream

    x = daily_bars(spark, sf_dir).withColumn("floor", F.lag("close").over(series.by_day()) * 0.9).where("floor is not null")
    market = F.when(F.col("symbol") % 2 == 0, "even").otherwise("odd")
    share = 100 * F.sum(classify.touches_down(F.col("close"), F.col("floor")).cast("long"))
    raw = F.when(share >= 45 * F.count("*"), "CRISIS").when(share >= 40 * F.count("*"), "WATCH").otherwise("NORMAL")
    days, path = x.groupBy(market.alias("market"), "d").agg(raw.alias("raw")), f"{shared_folder(spark)}/days"
    held = days.withColumn("year", F.year("d")).repartition(1, "year")  # a row a market and day
    held.sortWithinPartitions("year").write.option("maxRecordsPerFile", 800).partitionBy("year").parquet(f"{path}_by_year")
    for year in sorted(r.year for r in spark.read.parquet(f"{path}_by_year").select("year").distinct().collect()):  # a row a year
        spark.read.parquet(f"{path}_by_year").where(F.col("year") == year).drop("year").coalesce(1).write.mode("append").parquet(path)
    end = days.select("market").distinct().select("market", F.lit("2100-01-01").cast("date").alias("d"), F.lit("NORMAL").alias("raw"))
    end.coalesce(1).write.mode("append").parquet(path)
    return liquidity_stream(spark, path, files_at_once=3)


@query(f"WITH {BARS} SELECT d, symbol, amount FROM bars QUALIFY row_number() OVER (PARTITION BY d ORDER BY amount, symbol) <= 3")
def topk_by_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("d").orderBy("amount", "symbol")
    return daily_bars(spark, sf_dir).withColumn("n", F.row_number().over(w)).where("n <= 3").select("d", "symbol", "amount")


@query("""WITH a AS (SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus <> 'O'), b AS (SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 1 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderstatus <> 'F')
SELECT o_orderkey, round(o_totalprice, 2) AS o_totalprice FROM b UNION ALL SELECT o_orderkey, round(o_totalprice, 2) FROM a WHERE o_orderkey NOT IN (SELECT o_orderkey FROM b)""")
def upsert_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus")
    b = o.where("o_orderstatus <> 'F'").withColumn("o_totalprice", F.when(F.col("o_orderkey") % 10 == 1, F.col("o_totalprice") + 1).otherwise(F.col("o_totalprice")))
    return rounded(maintenance.upsert(o.where("o_orderstatus <> 'O'"), b, ["o_orderkey"]).drop("o_orderstatus"), "o_totalprice", digits=2)


@query("""WITH a AS (SELECT o_orderkey AS k, o_totalprice AS v FROM orders WHERE o_orderstatus <> 'O'), b AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders WHERE o_orderstatus <> 'P')
SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' ELSE 'touched' END AS change FROM a FULL JOIN b ON a.k = b.k WHERE a.k IS NULL OR b.k IS NULL OR a.v IS DISTINCT FROM b.v""")
def keyed_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("v"), "o_orderstatus")
    b = o.where("o_orderstatus <> 'P'").withColumn("v", F.when(F.col("k") % 7 == 0, None).otherwise(F.col("v")))
    return maintenance.changes(o.where("o_orderstatus <> 'O'"), b, ["k"], ["v"])


@query("SELECT count(*) AS n, count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS key_dups FROM lineitem")
def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").count()
    return keys.agg(F.sum("count").alias("n"), F.sum(F.col("count") - 1).alias("key_dups"))


@query("""WITH c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), s AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 45) SELECT c.d, max(c.d) OVER (PARTITION BY year(c.d), month(c.d)) = c.d AS month_last FROM c ANTI JOIN s ON s.d = c.d + 3""")
def calendar_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = load(spark, sf_dir, "lineitem").where("l_returnflag = 'N' and l_quantity > 45").select(F.date_sub(F.to_date("l_shipdate"), 3).alias("d")).distinct()
    month = Window.partitionBy(F.year("d"), F.month("d"))
    return calendar(spark, sf_dir).join(done, "d", "left_anti").withColumn("month_last", F.max("d").over(month) == F.col("d"))


@query(f"""WITH {BARS}, x AS (SELECT *, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) AS q FROM bars) SELECT symbol, count(*) AS days, CAST(sum(CASE WHEN high < close - 1e-6 OR low > close + 1e-6 THEN 1 ELSE 0 END) AS BIGINT) AS bad_range, CAST(sum(CASE WHEN vol IS NULL OR vol <= 0 THEN 1 ELSE 0 END) AS BIGINT) AS bad_volume, CAST(sum(CASE WHEN q > 1.1 OR q < 0.9 THEN 1 ELSE 0 END) AS BIGINT) AS jumps FROM x GROUP BY symbol""")
def bar_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = daily_bars(spark, sf_dir).withColumn("q", F.col("close") / F.lag("close").over(series.by_day()))
    some = lambda cond: F.sum(F.coalesce(cond, F.lit(False)).cast("long"))
    return x.groupBy("symbol").agg(F.count("*").alias("days"), some((F.col("high") < F.col("close") - 1e-6) | (F.col("low") > F.col("close") + 1e-6)).alias("bad_range"), F.sum((F.col("vol").isNull() | (F.col("vol") <= 0)).cast("long")).alias("bad_volume"), some((F.col("q") > 1.1) | (F.col("q") < 0.9)).alias("jumps"))


@query("SELECT CAST(i AS BIGINT) AS fold, i * 60 AS train_from, i * 60 + 250 AS test_from, i * 60 + 250 + 60 AS test_to FROM (SELECT unnest(generate_series(0, (SELECT (count(DISTINCT CAST(o_orderdate AS DATE)) - 310) // 60 FROM orders))) AS i)")
def walk_forward_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = calendar(spark, sf_dir).agg(F.count("*").alias("n"))
    i = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 310) / 60))).alias("fold")
    return n.select(i).select("fold", (F.col("fold") * 60).alias("train_from"), (F.col("fold") * 60 + 250).alias("test_from"), (F.col("fold") * 60 + 310).alias("test_to"))


@query()
def equal_weight_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net value of a run for every nation, over its symbols and all days."""
    runs = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("symbol"), F.col("s_nationkey").cast("long").alias("run_id"))
    return simulate.run_equal_weight(daily_bars(spark, sf_dir).select("symbol", "d", "close"), runs)
