"""Corporate actions: dividends, their days, consolidations, factor jumps and rights, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import classify
from tidemill.operators import series, temporal
from tidemill.plans.catalogue import BARS, query
from tidemill.sources.tables import calendar, daily_bars, load

#: Announced dividends: a shipped line each; cash by quantity, bonus shares by line number, some without a pay day.
DIVS = """divs AS (SELECT l_suppkey AS symbol, CAST(l_shipdate AS DATE) AS ex, CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE CAST(l_shipdate AS DATE) + CAST(l_linenumber AS INTEGER) END AS pay, CASE WHEN l_linenumber = 6 THEN CAST(l_shipdate AS DATE) + 9 END AS early_pay, CASE WHEN l_returnflag = 'N' THEN 'done' ELSE 'planned' END AS state,
 CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(l_quantity AS BIGINT) % 4 END AS cash, CASE WHEN l_linenumber = 5 THEN NULL ELSE CAST(l_linenumber % 2 AS BIGINT) END AS bo, CAST(l_linenumber % 3 AS BIGINT) AS co, l_orderkey, l_linenumber FROM lineitem)"""


def dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, ex = F.col("l_linenumber"), F.to_date("l_shipdate")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("symbol"), ex.alias("ex"), F.when(n % 3 != 0, F.date_add(ex, n)).alias("pay"), F.when(n == 6, F.date_add(ex, 9)).alias("early_pay"), F.when(F.col("l_returnflag") == "N", "done").otherwise("planned").alias("state"),
        F.when(n != 7, F.col("l_quantity").cast("long") % 4).alias("cash"), F.when(n != 5, (n % 2).cast("long")).alias("bo"), (n % 3).cast("long").alias("co"), "l_orderkey", "l_linenumber",
    )


@query(f"WITH {DIVS}, x AS (SELECT symbol, ex, pay, coalesce(cash, 0) AS cash, coalesce(bo, 0) + coalesce(co, 0) AS stk FROM divs WHERE state = 'done' AND ex BETWEEN DATE '1998-01-01' AND DATE '2000-12-31') SELECT DISTINCT symbol, ex, pay, cash, stk FROM x")
def dividend_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dividends that were carried out in a span; rows with the same business columns, null as 0, are one."""
    x = dividends(spark, sf_dir).where("state = 'done' and ex between date'1998-01-01' and date'2000-12-31'")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return x.select("symbol", "ex", "pay", zero(F.col("cash")).alias("cash"), (zero(F.col("bo")) + zero(F.col("co"))).alias("stk")).distinct()


@query(f"""WITH {DIVS}, e AS (SELECT symbol, ex, 'merge' AS kind FROM divs WHERE l_linenumber = 4 GROUP BY 1, 2 UNION ALL SELECT symbol, ex, 'dividend' FROM divs WHERE state = 'done' GROUP BY 1, 2) SELECT ex, symbol, kind, row_number() OVER (PARTITION BY ex ORDER BY symbol, kind = 'dividend') AS nth FROM e""")
def event_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a day by symbol, consolidations before dividends."""
    d = dividends(spark, sf_dir)
    kinds = [d.where(c).select("symbol", "ex", F.lit(k).alias("kind")).distinct() for c, k in (("l_linenumber = 4", "merge"), ("state = 'done'", "dividend"))]
    e = kinds[0].unionByName(kinds[1])
    w = Window.partitionBy("ex").orderBy("symbol", F.col("kind") == "dividend")
    return e.select("ex", "symbol", "kind", F.row_number().over(w).cast("long").alias("nth"))


@query(f"""WITH {DIVS}, f AS (SELECT * FROM divs QUALIFY row_number() OVER (PARTITION BY symbol, ex ORDER BY l_orderkey, l_linenumber, cash, pay) = 1), p AS (SELECT symbol, ex, cash, coalesce(pay, early_pay, ex) AS due FROM f WHERE cash > 0), c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT symbol, ex, cash, coalesce(c.d, due) AS pay FROM p ASOF LEFT JOIN c ON p.due <= c.d""")
def fund_dividends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first row of a symbol and ex-day, if it pays; paid on the next trading day from its pay day on,
    or on that day beyond the calendar's end."""
    f = temporal.latest_by(dividends(spark, sf_dir), ["symbol", "ex"], [F.col(c) for c in ("l_orderkey", "l_linenumber")] + [F.col("cash").asc_nulls_last(), F.col("pay").asc_nulls_last()])
    p = f.where("cash > 0").select("symbol", "ex", "cash", F.coalesce("pay", "early_pay", "ex").alias("d"))
    c = calendar(spark, sf_dir).select("d", F.col("d").alias("open_day"))
    days = p.select("d").distinct().withColumn("one", F.lit(1))  # a row a day
    rolled = temporal.asof_join(days, c.withColumn("one", F.lit(1)), "one", "d", "open_day", forward=True).select("d", "open_day")
    return p.join(rolled, "d").select("symbol", "ex", "cash", F.coalesce("open_day", "d").alias("pay"))


MERGES = """b AS (SELECT symbol, d, close, lag(close) OVER w AS was, 1 + 0.0005 * (symbol % 3) + CASE WHEN vol > 60 THEN close / lag(close) OVER w - 1 ELSE 0 END AS step FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)), x AS (SELECT symbol, d, close, was, close / (1 + 0.01 * (CAST(day(d) AS INTEGER) % 4)) AS pre, step FROM b WHERE was > 0)"""


def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with a stated close before and a made factor step."""
    was = F.lag("close").over(series.by_day())
    b = daily_bars(spark, sf_dir).withColumn("was", was).where("was > 0")
    step = 1 + 0.0005 * (F.col("symbol") % 3) + F.when(F.col("vol") > 60, F.col("close") / F.col("was") - 1).otherwise(0.0)
    return b.select("symbol", "d", "close", "was", (F.col("close") / (1 + 0.01 * (F.dayofmonth("d") % 4))).alias("pre"), step.alias("step"))


@query(f"""WITH {BARS}, {DIVS}, {MERGES} SELECT x.symbol, x.d, round(pre / was, 6) AS ratio, abs(pre / was / step - 1) < 0.005 AS confirmed FROM x ANTI JOIN (SELECT symbol, ex FROM divs WHERE state = 'done') e ON e.symbol = x.symbol AND e.ex = x.d WHERE abs(close / was - 1) > 0.12 AND abs(close / pre - 1) < 0.05""")
def consolidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jumps of the close that the stated close before explains and no dividend does, and whether the factor agrees."""
    x = merge_rows(spark, sf_dir).where("abs(close / was - 1) > 0.12 and abs(close / pre - 1) < 0.05")
    e = dividends(spark, sf_dir).where("state = 'done'").select("symbol", F.col("ex").alias("d")).distinct()
    ratio = F.col("pre") / F.col("was")
    return x.join(e, ["symbol", "d"], "left_anti").select("symbol", "d", F.round(ratio, 6).alias("ratio"), (F.abs(ratio / F.col("step") - 1) < 0.005).alias("confirmed"))


@query(f"""WITH {BARS}, {DIVS}, {MERGES}, j AS (SELECT symbol, d, step FROM x WHERE abs(step - 1) > 0.001), e AS (SELECT symbol, ex, max(coalesce(bo, 0) + coalesce(co, 0)) AS stk FROM divs WHERE state = 'done' GROUP BY 1, 2) SELECT j.symbol, CASE WHEN e.ex IS NOT NULL AND stk > 0 THEN 'bonus' WHEN e.ex IS NOT NULL THEN 'cash' WHEN step > 1 THEN 'rise' ELSE 'fall' END AS reason, count(*) AS n FROM j LEFT JOIN e ON e.symbol = j.symbol AND e.ex = j.d GROUP BY 1, 2""")
def explained_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor jumps of over a thousandth, by what explains them."""
    j = merge_rows(spark, sf_dir).where("abs(step - 1) > 0.001").select("symbol", "d", "step")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    e = dividends(spark, sf_dir).where("state = 'done'").groupBy("symbol", F.col("ex").alias("d")).agg(F.max(zero(F.col("bo")) + zero(F.col("co"))).alias("stk"))
    reason = F.when(F.col("stk") > 0, "bonus").when(F.col("stk").isNotNull(), "cash").when(F.col("step") > 1, "rise").otherwise("fall")
    return j.join(e, ["symbol", "d"], "left").groupBy("symbol", reason.alias("reason")).agg(F.count("*").alias("n"))


RIGHTS = "r AS (SELECT o_orderkey AS id, o_totalprice / 1000 AS x, CAST(0.1 * (1 + o_orderkey % 3) AS DOUBLE) AS ratio, o_totalprice / 1000 * (0.4 + 0.1 * (o_orderkey % 5)) AS p, 1 + 0.01 * (o_orderkey % 12) AS seen, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE 0.08 * (1 + o_orderkey % 3) END AS done FROM orders)"


@query(f"""WITH {RIGHTS}, c AS (SELECT *, x * (1 + ratio) / (x + ratio * p) AS predicted FROM r), e AS (SELECT *, (x + ratio * p) / (1 + ratio) AS full_price, CASE WHEN done IS NOT NULL THEN (x + done * p) / (1 + done) END AS part_price FROM c)
SELECT id, round(predicted, 6) AS predicted, abs(predicted / seen - 1) <= 0.005 AS fits, CASE WHEN done IS NULL THEN 'stated' WHEN done / ratio >= 0.85 THEN 'subscribed' ELSE 'guarded' END AS tier, round(CASE WHEN done IS NOT NULL AND done / ratio >= 0.85 THEN part_price ELSE full_price END + 1e-9, 4) AS ex_price, abs(seen - 1) > 1e-9 AND abs((predicted - 1) / (seen - 1)) <= 5 AS bounded FROM e""")
def rights_math(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factor step that a rights issue predicts, whether it fits, which ex-right price counts, and the
    guard against small denominators."""
    k = F.col("o_orderkey")
    r = load(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_totalprice") / 1000).alias("x"), (0.1 * (1 + k % 3)).alias("ratio"), (F.col("o_totalprice") / 1000 * (0.4 + 0.1 * (k % 5))).alias("p"), (1 + 0.01 * (k % 12)).alias("seen"), F.when(k % 4 != 0, 0.08 * (1 + k % 3)).alias("done"))
    priced = lambda q: (F.col("x") + q * F.col("p")) / (1 + q)
    predicted = F.col("x") * (1 + F.col("ratio")) / (F.col("x") + F.col("ratio") * F.col("p"))
    enough = F.col("done") / F.col("ratio") >= 0.85
    tier = F.when(F.col("done").isNull(), "stated").when(enough, "subscribed").otherwise("guarded")
    price = F.when(F.coalesce(enough, F.lit(False)), priced(F.col("done"))).otherwise(priced(F.col("ratio")))
    gap = F.col("seen") - 1
    bounded = F.coalesce((F.abs(gap) > 1e-9) & (F.abs(F.try_divide(predicted - 1, gap)) <= 5), F.lit(False))
    return r.select("id", F.round(predicted, 6).alias("predicted"), (F.abs(predicted / F.col("seen") - 1) <= 0.005).alias("fits"), tier.alias("tier"), F.round(price + 1e-9, 4).alias("ex_price"), bounded.alias("bounded"))


@query(f"""WITH {BARS}, {DIVS}, f AS (SELECT symbol, min(d) AS d, 1 + 0.01 * count(*) AS factor FROM bars GROUP BY symbol, year(d), month(d)), e AS (SELECT symbol, ex, max(coalesce(bo, 0) + coalesce(co, 0)) AS stk FROM divs WHERE state = 'done' GROUP BY 1, 2), g AS (SELECT e.symbol, e.ex, e.stk, a.factor AS now, b.factor AS before FROM e ASOF LEFT JOIN f a ON a.symbol = e.symbol AND e.ex >= a.d ASOF LEFT JOIN f b ON b.symbol = e.symbol AND e.ex > b.d WHERE stk > 0)
SELECT symbol, count(*) AS n, count(*) FILTER (now IS NOT NULL AND before IS NOT NULL AND abs(now / before - 1) < 1e-4) AS unmoved FROM g GROUP BY symbol""")
def bonus_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonus days on which the factor did not move against the day before."""
    b = daily_bars(spark, sf_dir)
    f = b.groupBy("symbol", F.year("d").alias("y"), F.month("d").alias("m")).agg(F.min("d").alias("d"), (1 + 0.01 * F.count("*")).alias("now"))
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    e = dividends(spark, sf_dir).where("state = 'done'").groupBy("symbol", F.col("ex").alias("d")).agg(F.max(zero(F.col("bo")) + zero(F.col("co"))).alias("stk")).where("stk > 0")
    x = temporal.asof_join(e, f.select("symbol", "d", "now"), "symbol", "d", "now")
    x = temporal.asof_join(x, f.select("symbol", "d", F.col("now").alias("before")), "symbol", "d", "before", strict=True)
    still = F.abs(F.col("now") / F.col("before") - 1) < 1e-4
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.count(F.when(still, 1)).alias("unmoved"))


DROPS = """x AS (
  SELECT symbol, d, vol, lag(vol) OVER w AS vol0, amount, lag(amount) OVER w AS amount0 FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)
), shares AS (
  SELECT symbol, d, vol0 AS pre, vol AS post, vol / vol0 AS q FROM x WHERE vol0 > 0 AND vol / vol0 - 1 <= -0.03
), jumps AS (
  SELECT symbol, d, amount0 AS pre, amount AS post, amount / amount0 AS q FROM x WHERE amount0 > 0 AND amount / amount0 - 1 <= -0.03
)"""


@query(f"""WITH {BARS}, {DROPS}, met AS (
  SELECT s.symbol, s.d, j.q, abs(CAST(s.d - j.d AS INTEGER)) AS days, row_number() OVER (PARTITION BY s.symbol, s.d ORDER BY abs(CAST(s.d - j.d AS INTEGER)), j.d) AS nth
  FROM shares s JOIN jumps j USING (symbol) WHERE abs(CAST(s.d - j.d AS INTEGER)) <= 10 AND abs(j.q - s.q) / s.q <= 0.01
)
SELECT s.symbol, s.d, round(s.q, 6) AS ratio, CASE WHEN m.d IS NOT NULL THEN 'confirmed' WHEN year(s.d) BETWEEN 1996 AND 1997 THEN 'reform' ELSE 'buyback' END AS verdict, m.days, round(abs(m.q - s.q) / s.q, 6) AS apart
FROM shares s LEFT JOIN met m ON m.symbol = s.symbol AND m.d = s.d AND nth = 1""")
def share_consolidations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drops of the share count by 3 % or more, confirmed where a factor drops within ten days by a ratio a
    hundredth apart at most (the nearest day, the earlier of two); else told apart by their years."""
    w = series.by_day()
    x = daily_bars(spark, sf_dir)
    drops = lambda c: x.select("symbol", "d", F.lag(c).over(w).alias("pre"), F.col(c).alias("post")).where("pre > 0 and post / pre - 1 <= -0.03D").withColumn("q", F.col("post") / F.col("pre"))
    shares = drops("vol").select("symbol", "d", "q")
    met = temporal.ratio_band(shares, drops("amount").select("symbol", "d", "q"), "symbol", "d", "q", 10, 0.01)
    days = F.abs(F.datediff("d", "other_d"))
    nearest = met.groupBy("symbol", "d").agg(F.min(F.struct(days.alias("days"), "other_d", "other_q")).alias("m"))
    out = shares.join(nearest, ["symbol", "d"], "left")
    verdict = F.when(F.col("m").isNotNull(), "confirmed").when(F.year("d").between(1996, 1997), "reform").otherwise("buyback")
    return out.select("symbol", "d", F.round("q", 6).alias("ratio"), verdict.alias("verdict"), F.col("m.days").alias("days"), F.round(F.abs(F.col("m.other_q") - F.col("q")) / F.col("q"), 6).alias("apart"))


LIMITS = """x AS (
  SELECT o_orderkey AS k, CAST(o_orderdate + INTERVAL 27 YEAR AS DATE) AS d, lpad(CAST((o_custkey * 91193) % 1000000 AS VARCHAR), 6, '0') AS code, o_orderstatus = 'F' AS st FROM orders
)"""


@query(f"""WITH {LIMITS} SELECT k, CASE WHEN regexp_matches(code, '^(4|8|920)') THEN 0.30 WHEN regexp_matches(code, '^(300|301|302|688|689)') THEN 0.20 WHEN st AND d < DATE '2026-07-06' THEN 0.05 ELSE 0.10 END::DOUBLE AS pct FROM x""")
def limit_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily limits by board, mark and day, on days before and after the mark's limit widened."""
    code = F.lpad((F.col("o_custkey") * 91193 % 1000000).cast("string"), 6, "0")
    x = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.add_months(F.to_date("o_orderdate"), 27 * 12).alias("d"), code.alias("code"), (F.col("o_orderstatus") == "F").alias("st"))
    return x.select("k", classify.limit_pct(classify.board(F.col("code")), F.col("st"), F.col("d")).alias("pct"))
