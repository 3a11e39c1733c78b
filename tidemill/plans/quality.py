"""The data-quality gate over daily bars: rules, exemptions, trading states and their report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import classify
from tidemill.operators import series, temporal
from tidemill.plans.catalogue import BARS, query
from tidemill.sources.tables import daily_bars, load

#: Bars with codes, calendar places, limits and made defects, so that every rule has rows: an open that
#: leaves the range, missing volumes, halts, ST spans, listing and delisting days.
MARKET = f"""{BARS}, cal AS (SELECT d, row_number() OVER (ORDER BY d) AS pos FROM (SELECT DISTINCT d FROM bars)), mk AS (SELECT b.symbol, b.d, pos, lpad(CAST((symbol * 91193) % 1000000 AS VARCHAR), 6, '0') AS code, close, high, low,
 CASE WHEN (symbol + pos) % 97 = 0 THEN high * 1.01 WHEN (symbol + pos) % 89 = 0 THEN NULL ELSE low END AS open, CASE WHEN (symbol + pos) % 83 = 0 THEN NULL WHEN (symbol + pos) % 79 = 0 THEN 0 ELSE vol END AS vol, amount,
 lag(close) OVER w AS pre, lag(pos) OVER w AS last_pos, min(pos) OVER (PARTITION BY symbol) AS first_pos, (symbol + pos) % 13 = 0 AS st, (symbol + pos) % 31 = 0 AS halted, symbol % 9 = 4 AS neeq, CASE WHEN symbol % 6 = 0 THEN NULL ELSE 40 + symbol * 3 END AS list_pos,
 CASE WHEN symbol % 5 = 0 THEN 900 + symbol * 7 END AS gone_pos FROM bars b JOIN cal USING (d) WINDOW w AS (PARTITION BY symbol ORDER BY b.d))"""


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = daily_bars(spark, sf_dir)
    days = b.select("d").distinct()
    cal = days.withColumn("pos", F.row_number().over(Window.orderBy("d")).cast("long"))  # a row a day
    w, s, at = series.by_day(), F.col("symbol"), F.col("symbol") + F.col("pos")
    return b.join(F.broadcast(cal), "d").select(
        "symbol", "d", "pos", F.lpad((s * 91193 % 1000000).cast("string"), 6, "0").alias("code"), "close", "high", "low",
        F.when(at % 97 == 0, F.col("high") * 1.01).when(at % 89 == 0, None).otherwise(F.col("low")).alias("open"),
        F.when(at % 83 == 0, None).when(at % 79 == 0, 0.0).otherwise(F.col("vol")).alias("vol"), "amount",
        F.lag("close").over(w).alias("pre"), F.lag("pos").over(w).alias("last_pos"), F.min("pos").over(Window.partitionBy("symbol")).alias("first_pos"),
        (at % 13 == 0).alias("st"), (at % 31 == 0).alias("halted"), (s % 9 == 4).alias("neeq"), F.when(s % 6 != 0, 40 + s * 3).alias("list_pos"), F.when(s % 5 == 0, 900 + s * 7).alias("gone_pos"),
    )


def count_if(c: Column) -> Column:
    """How many rows hold; null does not."""
    return F.count(F.when(c, 1))


@query(f"WITH {MARKET} SELECT symbol, count(*) AS checked, count(*) FILTER (coalesce(high < low OR open > high * (1 + 1e-9) OR open < low * (1 - 1e-9) OR close > high * (1 + 1e-9) OR close < low * (1 - 1e-9), FALSE)) AS bad FROM mk GROUP BY symbol")
def cc1_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Open and close inside of low and high; a null leaves the other tests to decide, all null is no fault."""
    out = lambda c: (F.col(c) > F.col("high") * (1 + 1e-9)) | (F.col(c) < F.col("low") * (1 - 1e-9))
    return market(spark, sf_dir).groupBy("symbol").agg(F.count("*").alias("checked"), count_if((F.col("high") < F.col("low")) | out("open") | out("close")).alias("bad"))


WINDOW_LEN = "CASE WHEN gone_pos >= 1200 THEN 15 ELSE 30 END"
EXEMPT = f"""x AS (SELECT *, CASE WHEN regexp_matches(code, '^(300|301|302|688|689)') THEN 0.2 WHEN regexp_matches(code, '^(4|8|920)') THEN 0.3 ELSE 0.1 END AS base, coalesce(pos < gone_pos AND pos >= gone_pos - {WINDOW_LEN}, FALSE) AS leaving, coalesce(pos = gone_pos - {WINDOW_LEN}, FALSE) AS leaving_first,
 CASE WHEN list_pos IS NULL THEN pos - first_pos BETWEEN 0 AND 7 ELSE pos - list_pos BETWEEN 0 AND 7 END AS fresh, coalesce(pos - last_pos >= 250, FALSE) AS long_gap, last_pos IS NULL OR last_pos <> pos - 1 AS no_prev, coalesce((symbol + pos - 1) % 31 = 0, FALSE) AS resumed FROM mk),
y AS (SELECT *, CASE WHEN st AND NOT leaving AND base = 0.1 AND d < DATE '1999-07-06' THEN 0.05 ELSE base END AS lim, fresh OR long_gap OR no_prev OR resumed OR neeq OR leaving_first AS exempt FROM x)"""


def move_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The market with each day's bound and what exempts it from the bound."""
    base = classify.limit_pct(classify.board(F.col("code")), F.lit(False), F.col("d"))
    length = F.when(F.col("gone_pos") >= 1200, 15).otherwise(30)
    since = F.col("pos") - F.coalesce("list_pos", "first_pos")
    sure = lambda c: F.coalesce(c, F.lit(False))
    x = market(spark, sf_dir).withColumns({
        "base": base, "leaving": sure((F.col("pos") < F.col("gone_pos")) & (F.col("pos") >= F.col("gone_pos") - length)), "leaving_first": sure(F.col("pos") == F.col("gone_pos") - length),
        "fresh": since.between(0, 7), "long_gap": sure(F.col("pos") - F.col("last_pos") >= 250), "no_prev": ~sure(F.col("last_pos") == F.col("pos") - 1), "resumed": (F.col("symbol") + F.col("pos") - 1) % 31 == 0,
    })
    narrow = F.col("st") & ~F.col("leaving") & (F.col("base") == 0.1) & (F.col("d") < F.lit("1999-07-06").cast("date"))
    exempt = F.col("fresh") | F.col("long_gap") | F.col("no_prev") | F.col("resumed") | F.col("neeq") | F.col("leaving_first")
    return x.withColumns({"lim": F.when(narrow, 0.05).otherwise(F.col("base")), "exempt": exempt})


BEYOND = "pre > 0 AND NOT exempt AND abs(close / pre - 1) > lim + greatest(0.005, 0.01 / pre) + 1e-9"


@query(f"WITH {MARKET}, {EXEMPT} SELECT symbol, count(*) FILTER (pre > 0 AND NOT exempt) AS checked, count(*) FILTER ({BEYOND}) AS bad FROM y GROUP BY symbol")
def cc2_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily moves beyond the bound of board, ST or leaving window, with a price tick's tolerance."""
    return move_bounds(spark, sf_dir).groupBy("symbol").agg(count_if(F.expr("pre > 0 and not exempt")).alias("checked"), count_if(F.expr(BEYOND.replace("1e-9", "1e-9D"))).alias("bad"))


@query(f"""WITH {MARKET}, {EXEMPT} SELECT symbol, count(*) FILTER (fresh) AS listed, count(*) FILTER (fresh AND list_pos IS NULL) AS anchored, count(*) FILTER (resumed) AS resumed, count(*) FILTER (leaving_first) AS leaving_first, count(*) FILTER (long_gap) AS long_gap,
count(*) FILTER (neeq) AS other_board, count(*) FILTER (no_prev) AS no_previous, count(*) FILTER (leaving) AS leaving, count(*) FILTER (0.01 / pre > 0.005) AS ticks FROM y GROUP BY symbol""")
def cc2_exempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many rows each exemption and tolerance takes in."""
    names = {"listed": "fresh", "anchored": "fresh and list_pos is null", "resumed": "resumed", "leaving_first": "leaving_first", "long_gap": "long_gap", "other_board": "neeq", "no_previous": "no_prev", "leaving": "leaving", "ticks": "0.01D / pre > 0.005D"}
    return move_bounds(spark, sf_dir).groupBy("symbol").agg(*(count_if(F.expr(e)).alias(k) for k, e in names.items()))


@query(f"WITH {MARKET}, {EXEMPT} SELECT symbol, d, leaving_first AS first FROM y WHERE leaving")
def delist_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 15 or 30 trading days before a symbol goes, without the day itself; the first has no bound."""
    return move_bounds(spark, sf_dir).where("leaving").select("symbol", "d", F.col("leaving_first").alias("first"))


@query(f"WITH {MARKET}, c AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders) SELECT symbol, count(*) FILTER (c.d IS NULL) AS off_calendar, count(*) FILTER (halted) AS halted FROM mk LEFT JOIN c USING (d) GROUP BY symbol")
def cc3_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows on days that a calendar lacks, and on days of a halt."""
    c = load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d"), F.lit(True).alias("open_")).distinct()
    return market(spark, sf_dir).join(c, "d", "left").groupBy("symbol").agg(count_if(F.col("open_").isNull()).alias("off_calendar"), count_if(F.col("halted")).alias("halted"))


FACTOR_ROWS = "f AS (SELECT symbol, d, pos, CASE WHEN (symbol + pos) % 101 = 0 THEN 0 WHEN (symbol + pos) % 103 = 0 THEN 0.5 ELSE 1 + 0.001 * pos END AS factor FROM mk), g AS (SELECT *, lag(factor) OVER (PARTITION BY symbol ORDER BY d) AS was FROM f WHERE factor > 0)"


def factor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = F.col("symbol") + F.col("pos")
    return market(spark, sf_dir).select("symbol", "d", "pos", F.when(at % 101 == 0, 0.0).when(at % 103 == 0, 0.5).otherwise(1 + 0.001 * F.col("pos")).alias("factor"))


@query(f"WITH {MARKET}, {FACTOR_ROWS}, n AS (SELECT symbol, count(*) FILTER (factor <= 0) AS bad FROM f GROUP BY symbol) SELECT symbol, any_value(bad) AS not_positive, count(*) FILTER (factor < was - greatest(1e-3, 1e-4 * was)) AS falls FROM g JOIN n USING (symbol) GROUP BY symbol")
def cc4_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Factors that are not positive, and falls beyond the tolerance between positive ones."""
    was = F.last(F.when(F.col("factor") > 0, F.col("factor")), ignorenulls=True).over(series.by_day().rowsBetween(Window.unboundedPreceding, -1))
    x = factor_rows(spark, sf_dir).withColumn("was", was)
    fall = (F.col("factor") > 0) & (F.col("factor") < F.col("was") - F.greatest(F.lit(1e-3), 1e-4 * F.col("was")))
    return x.groupBy("symbol").agg(count_if(F.col("factor") <= 0).alias("not_positive"), count_if(fall).alias("falls"))


EX_DAYS = "ex AS (SELECT symbol, d, pos, 0.1 * (1 + symbol % 4) AS bonus FROM mk WHERE (symbol * 3 + pos) % 61 = 0)"


@query(f"WITH {MARKET}, {FACTOR_ROWS}, {EX_DAYS} SELECT ex.symbol, ex.d FROM ex ANTI JOIN (SELECT * FROM f WHERE pos % 3 <> 0) k ON k.symbol = ex.symbol AND k.d = ex.d")
def cc4b_ex_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ex-days without a factor row."""
    m = market(spark, sf_dir).where("(symbol * 3 + pos) % 61 = 0").select("symbol", "d")
    return m.join(factor_rows(spark, sf_dir).where("pos % 3 <> 0").select("symbol", "d"), ["symbol", "d"], "left_anti")


@query(f"WITH {MARKET} SELECT symbol, count(*) FILTER (vol IS NULL OR vol <= 0) AS bad_volume, count(*) FILTER (amount IS NULL OR amount <= 0) AS bad_amount FROM mk GROUP BY symbol")
def cc5_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume and amount above 0; a null breaks the rule."""
    return market(spark, sf_dir).groupBy("symbol").agg(*(count_if(F.col(c).isNull() | (F.col(c) <= 0)).alias(k) for c, k in (("vol", "bad_volume"), ("amount", "bad_amount"))))


@query(f"WITH {MARKET}, l AS (SELECT symbol, d, close, round(pre * 1.1 + 1e-8, 2) AS up, round(pre * 0.9 + 1e-8, 2) AS down FROM mk WHERE pre > 0) SELECT symbol, count(*) AS checked, count(*) FILTER (close > up * 1.005 OR close < down * 0.995) AS bad FROM l GROUP BY symbol")
def cc5b_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Closes beyond the stated limits by over half a hundredth."""
    l = market(spark, sf_dir).where("pre > 0").select("symbol", "close", F.round(F.col("pre") * 1.1 + 1e-8, 2).alias("up"), F.round(F.col("pre") * 0.9 + 1e-8, 2).alias("down"))  # noqa: E741
    return l.groupBy("symbol").agg(F.count("*").alias("checked"), count_if((F.col("close") > F.col("up") * 1.005) | (F.col("close") < F.col("down") * 0.995)).alias("bad"))


@query(f"""WITH {MARKET}, {EX_DAYS}, f AS (SELECT symbol, d, CASE WHEN symbol % 4 = 0 THEN 1.0 WHEN symbol % 4 = 1 THEN 1 + 0.01 * (pos // 40) ELSE 1 + 0.001 * pos END AS factor FROM mk), s AS (SELECT symbol, d, factor, lag(factor) OVER w AS was, min(factor) OVER a AS lo, max(factor) OVER a AS hi FROM f WINDOW w AS (PARTITION BY symbol ORDER BY d), a AS (PARTITION BY symbol ORDER BY d ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING))
SELECT ex.symbol, ex.d, CASE WHEN abs(s.factor / s.was - 1) > 1e-4 THEN 'matched' WHEN s.lo IS NULL THEN 'review' WHEN s.hi - s.lo < 1e-6 AND abs(s.hi - s.factor) < 1e-6 THEN 'phantom' ELSE 'late' END AS verdict FROM ex JOIN s ON s.symbol = ex.symbol AND s.d = ex.d WHERE s.was IS NOT NULL""")
def cc7_bonus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bonus days whose factor moves that day, later within 20 rows, or never."""
    w, ahead = series.by_day(), series.by_day().rowsBetween(1, 20)
    factor = F.when(F.col("symbol") % 4 == 0, 1.0).when(F.col("symbol") % 4 == 1, 1 + 0.01 * F.expr("pos div 40")).otherwise(1 + 0.001 * F.col("pos"))
    s = market(spark, sf_dir).withColumn("factor", factor).withColumns({"was": F.lag("factor").over(w), "lo": F.min("factor").over(ahead), "hi": F.max("factor").over(ahead)})
    still = (F.col("hi") - F.col("lo") < 1e-6) & (F.abs(F.col("hi") - F.col("factor")) < 1e-6)
    verdict = F.when(F.abs(F.col("factor") / F.col("was") - 1) > 1e-4, "matched").when(F.col("lo").isNull(), "review").when(still, "phantom").otherwise("late")
    return s.where("(symbol * 3 + pos) % 61 = 0 and was is not null").select("symbol", "d", verdict.alias("verdict"))


@query(f"""WITH {MARKET}, {EXEMPT}, b AS (SELECT 'range' AS rule, symbol, d FROM y WHERE coalesce(open > high * (1 + 1e-9), FALSE) UNION ALL SELECT 'move', symbol, d FROM y WHERE {BEYOND} UNION ALL SELECT 'volume', symbol, d FROM y WHERE vol IS NULL OR vol <= 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rule ORDER BY d, symbol) AS i FROM b) SELECT rule, count(*) AS n, string_agg(symbol || '@' || d, ',' ORDER BY i) FILTER (i <= 3) AS examples, rule <> 'volume' AS blocking FROM r GROUP BY rule""")
def gate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of three rules with their first three examples, of which each task sends three at most."""
    y = move_bounds(spark, sf_dir)
    tests = {"range": "open > high * (1 + 1e-9D)", "move": BEYOND.replace("1e-9", "1e-9D"), "volume": "vol is null or vol <= 0"}
    found = y.select("symbol", "d", F.explode(F.array_compact(F.array(*(F.when(F.expr(e), F.lit(k)) for k, e in tests.items())))).alias("rule"))
    first = temporal.first_rows(found, ["rule"], [F.col("d"), F.col("symbol")], 3)
    few = first.groupBy("rule").agg(F.array_sort(F.collect_list(F.struct("d", "symbol", F.concat_ws("@", "symbol", "d").alias("at")))).alias("few"))
    out = found.groupBy("rule").agg(F.count("*").alias("n")).join(few, "rule")
    return out.select("rule", "n", F.array_join("few.at", ",").alias("examples"), (F.col("rule") != "volume").alias("blocking"))


@query(f"""WITH {MARKET}, p AS (SELECT symbol, d, pre, CASE WHEN regexp_matches(code, '^(300|301|302|688|689)') THEN 0.2 WHEN regexp_matches(code, '^(4|8|920)') THEN 0.3 WHEN st AND d < DATE '1999-07-06' THEN 0.05 ELSE 0.1 END AS lim, halted, st, close, coalesce(pos >= gone_pos, FALSE) AS gone, CASE WHEN pos % 11 <> 0 THEN round(pre * 1.1 + 1e-8, 2) END AS up_given, CASE WHEN pos % 11 <> 0 THEN round(pre * 0.9 + 1e-8, 2) END AS down_given FROM mk),
q AS (SELECT *, coalesce(up_given, round(pre * (1 + lim) + 1e-8, 2)) AS up, coalesce(down_given, round(pre * (1 - lim) + 1e-8, 2)) AS down FROM p) SELECT symbol, d, round(up, 2) AS up, round(down, 2) AS down, halted, st, gone, coalesce(up > 0 AND close >= up * (1 - 1e-4), FALSE) AS at_up, coalesce(down > 0 AND close <= down * (1 + 1e-4), FALSE) AS at_down FROM q""")
def state_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Limits (given, or from the close before and the board), halts, ST, delisting and touched limits of a day."""
    board = classify.board(F.col("code"))
    lim = F.when(board.isin("gem", "star"), 0.2).when(board == "bse", 0.3).when(F.col("st") & (F.col("d") < F.lit("1999-07-06").cast("date")), 0.05).otherwise(0.1)
    given = lambda x: F.when(F.col("pos") % 11 != 0, F.round(F.col("pre") * x + 1e-8, 2))
    q = market(spark, sf_dir).withColumns({"up": F.coalesce(given(1.1), F.round(F.col("pre") * (1 + lim) + 1e-8, 2)), "down": F.coalesce(given(0.9), F.round(F.col("pre") * (1 - lim) + 1e-8, 2))})
    at_up, at_down = classify.touches_up(F.col("close"), F.col("up")), classify.touches_down(F.col("close"), F.col("down"))
    return q.select("symbol", "d", "up", "down", "halted", "st", F.coalesce(F.col("pos") >= F.col("gone_pos"), F.lit(False)).alias("gone"), at_up.alias("at_up"), at_down.alias("at_down"))


@query(f"""WITH {MARKET}, s AS (SELECT symbol, d, CASE WHEN halted THEN 'S' WHEN (symbol + pos) % 29 = 0 THEN 'R' END AS kind, CASE WHEN pos % 4 = 0 THEN '09:30-10:30' END AS timing FROM mk) SELECT symbol, count(*) AS full_days FROM s WHERE kind = 'S' AND timing IS NULL GROUP BY symbol""")
def full_halts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Halts of a whole day: of the kind S and without a time."""
    kind = F.when(F.col("halted"), "S").when((F.col("symbol") + F.col("pos")) % 29 == 0, "R")
    s = market(spark, sf_dir).select("symbol", kind.alias("kind"), F.when(F.col("pos") % 4 == 0, "09:30-10:30").alias("timing"))
    return s.where("kind = 'S' and timing is null").groupBy("symbol").agg(F.count("*").alias("full_days"))


@query(f"""WITH {MARKET}, t AS (SELECT symbol, min(d) AS start, max(d) AS stop FROM mk GROUP BY symbol) SELECT symbol, start, CASE WHEN start > DATE '1995-01-05' THEN CASE WHEN symbol % 2 = 0 THEN 'required' ELSE 'degraded' END ELSE 'covered' END AS verdict, CAST(greatest(start - DATE '1995-01-01', 0) AS INTEGER) AS late FROM t""")
def coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First days against the range that is asked for."""
    t = daily_bars(spark, sf_dir).groupBy("symbol").agg(F.min("d").alias("start"))
    late = F.when(F.col("symbol") % 2 == 0, "required").otherwise("degraded")
    return t.select("symbol", "start", F.when(F.col("start") > F.lit("1995-01-05").cast("date"), late).otherwise("covered").alias("verdict"), F.greatest(F.datediff("start", F.lit("1995-01-01").cast("date")), F.lit(0)).alias("late"))


@query(f"WITH {MARKET} SELECT symbol, d, CAST(pos - last_pos AS BIGINT) AS gap FROM mk WHERE pos - last_pos >= 8")
def long_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days after a gap of eight calendar places or more."""
    return market(spark, sf_dir).select("symbol", "d", (F.col("pos") - F.col("last_pos")).alias("gap")).where("gap >= 8")
