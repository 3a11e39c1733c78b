"""Indicator series, step maps, fund research and share flow, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import classify
from tidemill.operators import series
from tidemill.operators.scan import affine_pair
from tidemill.plans.catalogue import BARS, BREADTH, breadth_days, query, rounded
from tidemill.sources.tables import daily_bars, load, parts_of

CHG_VR = """x AS (SELECT symbol, d, (close / lag(close, 20) OVER w - 1) * 100 AS chg, CASE WHEN count(*) OVER (w ROWS 19 PRECEDING) = 20 THEN
 CAST(sum(vol) OVER (w ROWS 4 PRECEDING) AS DOUBLE) * 3 / sum(vol) OVER (w ROWS BETWEEN 19 PRECEDING AND 5 PRECEDING) END AS vr FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))"""


@query(f"""WITH {BARS}, {CHG_VR} SELECT symbol, d, CASE WHEN chg IS NULL OR vr IS NULL THEN 'none' WHEN chg > 2 AND vr > 1.05 THEN 'rising' WHEN abs(chg) <= 2 AND vr > 1.05 THEN 'building' WHEN chg < -2 AND vr > 1.05 THEN 'falling'
 WHEN chg > 2 AND vr < 0.95 THEN 'thin rise' WHEN chg > 0.5 THEN 'rising' WHEN chg < -0.5 THEN 'falling' WHEN vr > 1.0 THEN 'building' WHEN vr < 1.0 THEN 'falling' ELSE 'none' END AS quadrant FROM x""")
def quadrant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Price against volume: which of four states a day is in, by ordered tests."""
    x = daily_bars(spark, sf_dir).select("symbol", "d", series.change_pct("close", 20).alias("chg"), series.volume_ratio("vol").alias("vr"))
    return x.select("symbol", "d", classify.quadrant(F.col("chg"), F.col("vr")).alias("quadrant"))


@query("""WITH s AS (SELECT o_orderkey, CAST(o_orderkey % 17 AS INTEGER) - 8 AS b, CAST(o_orderkey % 41 AS INTEGER) - 3 AS heat FROM orders), t AS (SELECT o_orderkey, CASE WHEN b = 8 THEN NULL ELSE b END AS b, heat FROM s)
SELECT o_orderkey, CASE WHEN b IS NULL THEN 'unknown' WHEN b >= 3 THEN 'strong' WHEN b >= 1 THEN 'firm' WHEN b >= -1 THEN 'neutral' WHEN b >= -3 THEN 'soft' ELSE 'weak' END AS single,
CASE WHEN b IS NULL THEN 'unknown' WHEN b >= 6 THEN 'strong' WHEN b >= 3 THEN 'leaning long' WHEN b >= 1 THEN 'neutral to long' WHEN b >= -1 THEN 'neutral' WHEN b >= -6 THEN 'leaning short' ELSE 'weak' END AS composite,
CASE WHEN b IS NULL THEN 90 WHEN b >= 6 THEN 115 WHEN b >= 3 THEN 105 WHEN b >= 1 THEN 95 WHEN b >= -1 THEN 90 WHEN b >= -3 THEN 75 WHEN b >= -6 THEN 55 ELSE 40 END AS position,
CASE WHEN heat <= 0 THEN 0.0 ELSE round(least(2.0, CAST(heat AS DOUBLE) / 20 * 2 - 1), 1) END AS heat FROM t""")
def status_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Step maps of a score to states and shares, and the leverage heat."""
    b = F.when(F.col("o_orderkey") % 17 != 16, (F.col("o_orderkey") % 17 - 8).cast("int"))
    o = load(spark, sf_dir, "orders").select("o_orderkey", b.alias("b"), (F.col("o_orderkey") % 41 - 3).cast("double").alias("h"))
    return o.select("o_orderkey", classify.beta_status(F.col("b")).alias("single"), classify.composite_status(F.col("b")).alias("composite"), classify.composite_position(F.col("b")).alias("position"), classify.leverage_heat(F.col("h")).alias("heat"))


EMA_SQL = "e.{0} * (1 - 2 / {1}.0) + n.close * (2 / {1}.0)"
NUMBERED = "n AS (SELECT symbol, d, close, low, high, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM bars)"


@query(f"""WITH RECURSIVE {BARS}, {NUMBERED}, e AS (SELECT symbol, d, i, close, close AS fast, close AS slow, CAST(0 AS DOUBLE) AS dea FROM n WHERE i = 1 UNION ALL
SELECT n.symbol, n.d, n.i, n.close, {EMA_SQL.format('fast', 13)}, {EMA_SQL.format('slow', 27)}, e.dea * 0.8 + 0.2 * (({EMA_SQL.format('fast', 13)}) - ({EMA_SQL.format('slow', 27)})) FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1)
SELECT symbol, d, round(fast - slow, 3) AS dif, round(dea, 3) AS dea, round(2 * (fast - slow - dea), 3) AS hist, round(2 * (fast - slow - dea) / close * 100, 3) AS mom_ratio FROM e""")
def macd_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MACD of every day; a task holds the days of one symbol."""
    x = series.smoothed(daily_bars(spark, sf_dir).select("symbol", "d", "close"), {"fast": ("close", 2 / 13), "slow": ("close", 2 / 27)})
    x = series.smoothed(x.withColumn("dif", F.col("fast") - F.col("slow")), {"dea": ("dif", 2 / 10)})
    hist = 2 * (F.col("dif") - F.col("dea"))
    return rounded(x.select("symbol", "d", "dif", "dea", hist.alias("hist"), (hist / F.col("close") * 100).alias("mom_ratio")), "dif", "dea", "hist", "mom_ratio", digits=3)


@query(f"""WITH RECURSIVE {BARS}, {NUMBERED}, e AS (
  SELECT symbol, d, i, close, close AS fast, close AS slow FROM n WHERE i = 1
  UNION ALL
  SELECT n.symbol, n.d, n.i, n.close, {EMA_SQL.format('fast', 13)}, {EMA_SQL.format('slow', 27)} FROM e JOIN n ON n.symbol = e.symbol AND n.i = e.i + 1
), x AS (
  SELECT symbol, d, i, close, fast - slow AS dif, max(close) OVER p AS hc, max(fast - slow) OVER p AS hd, min(close) OVER p AS lc, min(fast - slow) OVER p AS ld
  FROM e WINDOW p AS (PARTITION BY symbol ORDER BY i ROWS BETWEEN 19 PRECEDING AND 1 PRECEDING)
)
SELECT symbol, d, CASE WHEN i < 20 THEN 'none' WHEN close >= hc AND dif < hd * 0.9 THEN 'top' WHEN close <= lc AND dif > ld * 1.1 THEN 'bottom' ELSE 'none' END AS signal FROM x""")
def divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices at a new high of twenty days while the gap of their averages stays behind its own, and the mirror."""
    x = series.smoothed(daily_bars(spark, sf_dir).select("symbol", "d", "close"), {"fast": ("close", 2 / 13), "slow": ("close", 2 / 27)})
    return series.divergence(x.withColumn("dif", F.col("fast") - F.col("slow")), "close", "dif").select("symbol", "d", "signal")


@query(f"""WITH RECURSIVE {BARS}, {NUMBERED}, r AS (
  SELECT symbol, d, i, CASE WHEN i < 14 OR max(high) OVER w = min(low) OVER w THEN 50.0 ELSE (close - min(low) OVER w) / (max(high) OVER w - min(low) OVER w) * 100 END AS rsv
  FROM n WINDOW w AS (PARTITION BY symbol ORDER BY i ROWS 13 PRECEDING)
), e AS (
  SELECT symbol, d, i, CAST(50 AS DOUBLE) AS k, CAST(50 AS DOUBLE) AS dd FROM r WHERE i = 1
  UNION ALL
  SELECT r.symbol, r.d, r.i, (e.k * 2 + r.rsv) / 3, (e.dd * 2 + (e.k * 2 + r.rsv) / 3) / 3 FROM e JOIN r ON r.symbol = e.symbol AND r.i = e.i + 1
)
SELECT symbol, d, round(k, 3) AS k, round(dd, 3) AS dd, round(3 * k - 2 * dd, 3) AS j FROM e""")
def kdj(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K, D and J of every day. Both start at 50 on a symbol's first day; until fourteen days are full, and on
    a flat range, the place in the range counts as 50."""
    bars = daily_bars(spark, sf_dir, parts_of(spark, sf_dir, "lineitem"))
    x = series.stochastic(bars).select("symbol", "d", F.coalesce("rsv", F.lit(50.0)).alias("rsv"))
    two_thirds = F.lit(2 / 3)  # on the first day both are 50 again
    k, d = (two_thirds, F.col("rsv") / 3), (two_thirds, F.lit(2 / 9), F.col("rsv") / 9)
    out = affine_pair(x, ["symbol"], [F.col("d")], k, d, ("k0", "d0"), (50.0, 50.0))
    out = out.withColumn("k", F.col("k0") * 2 / 3 + F.col("rsv") / 3).withColumn("dd", F.col("d0") * 2 / 3 + F.col("k") / 3)
    return rounded(out.select("symbol", "d", "k", "dd", (3 * F.col("k") - 2 * F.col("dd")).alias("j")), "k", "dd", "j", digits=3)


@query(f"""WITH {BARS}, x AS (SELECT symbol, d, close, count(*) OVER (w ROWS 23 PRECEDING) AS n, avg(close) OVER (w ROWS 2 PRECEDING) AS a, avg(close) OVER (w ROWS 5 PRECEDING) AS b, avg(close) OVER (w ROWS 11 PRECEDING) AS c, avg(close) OVER (w ROWS 23 PRECEDING) AS e FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))
SELECT symbol, d, CASE WHEN n < 3 THEN NULL ELSE round((a + CASE WHEN n >= 6 THEN b ELSE 0 END + CASE WHEN n >= 12 THEN c ELSE 0 END + CASE WHEN n >= 24 THEN e ELSE 0 END) / (1 + CAST(n >= 6 AS INTEGER) + CAST(n >= 12 AS INTEGER) + CAST(n >= 24 AS INTEGER)), 3) END AS bbi FROM x""")
def bbi_short(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of those of the means over 3, 6, 12 and 24 rows that are there."""
    means = F.array(*(series.moving_mean("close", n) for n in (3, 6, 12, 24)))
    there = F.filter(means, lambda x: x.isNotNull())
    total = F.aggregate(there, F.lit(0.0), lambda a, x: a + x)
    return rounded(daily_bars(spark, sf_dir).select("symbol", "d", F.when(F.size(there) > 0, total / F.size(there)).alias("bbi")), "bbi", digits=3)


@query(f"""WITH {BARS}, x AS (SELECT symbol, d, close, count(*) OVER w AS n, avg(close) OVER w AS mid, stddev_pop(close) OVER w AS dev FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING)), y AS (SELECT symbol, d, (close - (mid - 2 * dev)) / (4 * dev) * 100 AS place FROM x WHERE n = 20 AND dev > 0)
SELECT symbol, d, round(place, 2) AS place, CASE WHEN place > 80 THEN 'upper' WHEN place < 20 THEN 'lower' ELSE 'middle' END AS band FROM y""")
def bollinger_place(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a close lies between the bands, and its label."""
    x = series.bollinger(daily_bars(spark, sf_dir)).where("upper > lower")
    place = (F.col("close") - F.col("lower")) / (F.col("upper") - F.col("lower")) * 100
    return x.select("symbol", "d", F.round(place, 2).alias("place"), F.when(place > 80, "upper").when(place < 20, "lower").otherwise("middle").alias("band"))


FLOW = """x AS (SELECT symbol, d, vol, close, lag(vol) OVER (PARTITION BY symbol ORDER BY d) AS was FROM bars), k AS (SELECT symbol, d, vol, close FROM x WHERE was IS NULL OR vol >= 0.6 * was),
y AS (SELECT symbol, d, vol, close, row_number() OVER w AS i, vol - lag(vol) OVER w AS step, vol - lag(vol, 5) OVER w AS c5, vol - lag(vol, 20) OVER w AS c20 FROM k WINDOW w AS (PARTITION BY symbol ORDER BY d))"""


@query(f"""WITH {BARS}, {FLOW} SELECT symbol, d, CAST(c5 AS BIGINT) AS change5, CAST(c20 AS BIGINT) AS change20, CASE WHEN i > 5 THEN round(sum(step * close) OVER (w ROWS 4 PRECEDING), 0) END AS flow5, CASE WHEN i > 20 THEN round(sum(step * close) OVER (w ROWS 19 PRECEDING), 0) END AS flow20 FROM y WINDOW w AS (PARTITION BY symbol ORDER BY d)""")
def share_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share changes over 5 and 20 kept rows and their money flow; a row below 0.6 of the raw row before
    it is no share count and is left out, differences are taken between kept rows."""
    w = series.by_day()
    kept = daily_bars(spark, sf_dir).withColumn("was", F.lag("vol").over(w)).where("was is null or vol >= 0.6 * was")
    x = kept.withColumn("step", (F.col("vol") - F.lag("vol").over(w)) * F.col("close")).withColumn("i", F.row_number().over(w))
    flow = lambda n: F.when(F.col("i") > n, F.round(F.sum("step").over(series.rows_back(n - 1)), 0))
    change = lambda n: (F.col("vol") - F.lag("vol", n).over(w)).cast("long")
    return x.select("symbol", "d", change(5).alias("change5"), change(20).alias("change20"), flow(5).alias("flow5"), flow(20).alias("flow20"))


@query(f"""WITH {BARS}, v AS (
  SELECT symbol, d, avg(close) OVER w AS nav, count(*) OVER w AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING)
), r AS (
  SELECT symbol, d, nav, nav / lag(nav) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM v WHERE n = 20
)
SELECT symbol, round(pow(max_by(nav, d) / min_by(nav, d), 365.25 / CAST(max(d) - min(d) AS INTEGER)) - 1, 4) AS annual,
       CASE WHEN count(*) >= 120 AND count(*) FILTER (i > 91 AND abs(r) < 0.25) >= 100 THEN round(stddev_samp(r) FILTER (i > 91 AND abs(r) < 0.25) * sqrt(245), 4) END AS vol
FROM r GROUP BY symbol""")
def annual_and_vol(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly growth by calendar days of a net value (the mean of twenty closes); its volatility from row 92 on
    without jumps of a quarter, given 120 rows and 100 returns."""
    w = series.by_day()
    v = daily_bars(spark, sf_dir).select("symbol", "d", series.moving_mean("close", 20).alias("nav")).where("nav is not null")
    x = v.select("symbol", "d", "nav", (F.col("nav") / F.lag("nav").over(w) - 1).alias("r"), F.row_number().over(w).alias("i"))
    calm = F.when((F.col("i") > 91) & (F.abs("r") < 0.25), F.col("r"))
    grown = F.pow(F.max_by("nav", "d") / F.min_by("nav", "d"), 365.25 / F.datediff(F.max("d"), F.min("d"))) - 1
    vol = F.when((F.count("*") >= 120) & (F.count(calm) >= 100), F.stddev_samp(calm) * 245**0.5)
    return x.groupBy("symbol").agg(F.round(grown, 4).alias("annual"), F.round(vol, 4).alias("vol"))


@query(f"""WITH {BARS}, c AS (SELECT symbol, DATE '1998-01-01' AS cut FROM (SELECT DISTINCT symbol FROM bars)), b AS (SELECT symbol, close FROM bars JOIN c USING (symbol) WHERE d < cut QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d DESC) <= 15),
a AS (SELECT symbol, close FROM bars JOIN c USING (symbol) WHERE d >= cut QUALIFY row_number() OVER (PARTITION BY symbol ORDER BY d) <= 15), m AS (SELECT symbol, (SELECT median(close) FROM b WHERE b.symbol = c.symbol) AS before, (SELECT median(close) FROM a WHERE a.symbol = c.symbol) AS after FROM c)
SELECT symbol, round(before, 4) AS before, round(after, 4) AS after, abs(after / before - 1) > 0.05 AS broken FROM m WHERE before IS NOT NULL AND after IS NOT NULL""")
def adjustment_breaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of the 15 rows on each side of a cut, and whether they part by over a twentieth."""
    side = F.when(F.col("d") < F.lit("1998-01-01").cast("date"), "before").otherwise("after")
    far = F.when(F.col("side") == "before", -F.unix_date("d")).otherwise(F.unix_date("d"))
    near = daily_bars(spark, sf_dir).withColumn("side", side).withColumn("n", F.row_number().over(Window.partitionBy("symbol", "side").orderBy(far))).where("n <= 15")
    m = near.groupBy("symbol").agg(*(F.median(F.when(F.col("side") == s, F.col("close"))).alias(s) for s in ("before", "after"))).where("before is not null and after is not null")
    return rounded(m.withColumn("broken", F.abs(F.col("after") / F.col("before") - 1) > 0.05), "before", "after")


PARTS = "CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN 'Broad 300 Index*' || (40 + p_partkey % 50) || '%+Bond Index*' || (60 - p_partkey % 50) || '%' WHEN 1 THEN 'Small 1000 Index' WHEN 2 THEN 'Growth*95%+Deposit*5%' ELSE NULL END"


@query(f"""WITH b AS (SELECT p_partkey, {PARTS} AS t FROM part), x AS (SELECT p_partkey, t, list_transform(regexp_extract_all(coalesce(t, ''), '([0-9]+)%', 1), lambda y: CAST(y AS INTEGER)) AS w FROM b)
SELECT p_partkey, CAST(CASE WHEN t IS NULL THEN 0 ELSE len(string_split(t, '+')) END AS INTEGER) AS parts, CASE WHEN t IS NULL THEN 0 WHEN len(w) = 0 THEN 100 ELSE list_max(w) END AS weight FROM x""")
def benchmark_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many indices a benchmark text names and the largest share; a text without shares is all one."""
    k = F.col("p_partkey")
    mix = F.concat(F.lit("Broad 300 Index*"), (40 + k % 50).cast("string"), F.lit("%+Bond Index*"), (60 - k % 50).cast("string"), F.lit("%"))
    t = F.when(k % 4 == 0, mix).when(k % 4 == 1, "Small 1000 Index").when(k % 4 == 2, "Growth*95%+Deposit*5%")
    x = load(spark, sf_dir, "part").select("p_partkey", t.alias("t"), F.transform(F.regexp_extract_all(F.coalesce(t, F.lit("")), F.lit("([0-9]+)%"), 1), lambda w: w.cast("int")).alias("w"))
    parts = F.when(F.col("t").isNull(), 0).otherwise(F.size(F.split("t", r"\+")))
    return x.select("p_partkey", parts.alias("parts"), F.when(F.col("t").isNull(), 0).when(F.size("w") == 0, 100).otherwise(F.array_max("w")).alias("weight"))


FUNNEL = ["p_size >= 5", "p_retailprice < 1500", "p_type NOT LIKE '%TIN'", "p_name NOT LIKE '%1%'"]


@query(f"""WITH x AS (SELECT *, {' , '.join(f'({c}) AS c{i}' for i, c in enumerate(FUNNEL))} FROM part), k AS (SELECT *, row_number() OVER (PARTITION BY p_brand, p_type ORDER BY p_partkey) AS nth FROM x WHERE c0 AND c1 AND c2 AND c3)
SELECT 'all' AS step, count(*) AS n FROM part UNION ALL SELECT 'size', count(*) FROM x WHERE c0 UNION ALL SELECT 'price', count(*) FROM x WHERE c0 AND c1 UNION ALL SELECT 'type', count(*) FROM x WHERE c0 AND c1 AND c2
UNION ALL SELECT 'name', count(*) FROM k UNION ALL SELECT 'first of class', count(*) FROM k WHERE nth = 1""")
def fund_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What ordered filters leave, step by step, counted in one pass; then the first of each class."""
    passed, steps = F.lit(True), []
    for name, test in zip(("size", "price", "type", "name"), FUNNEL):
        passed = passed & F.expr(test)
        steps.append((name, passed))
    p = load(spark, sf_dir, "part")
    first = F.row_number().over(Window.partitionBy("p_brand", "p_type", "ok").orderBy("p_partkey")) == 1
    x = p.withColumn("ok", F.coalesce(passed, F.lit(False))).withColumn("first", first & F.col("ok"))
    counts = x.agg(F.count("*").alias("all"), *(F.sum(c.cast("long")).alias(k) for k, c in steps), F.sum(F.col("first").cast("long")).alias("first of class"))
    return counts.select(F.explode(F.array(*(F.struct(F.lit(c).alias("step"), F.col(f"`{c}`").alias("n")) for c in counts.columns))).alias("x")).select("x.*")


@query("""WITH q AS (SELECT o_custkey AS k, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q, sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS v FROM orders GROUP BY 1, 2, 3), s AS (SELECT k, y, q, sum(v) OVER (PARTITION BY k, y ORDER BY q) AS ytd FROM q),
z AS (SELECT k, y, max_by(ytd, q) AS full_year FROM s GROUP BY k, y) SELECT s.k, s.y, s.q, CAST(round(CASE WHEN s.q = 4 THEN ytd ELSE ytd + full_year - was END, 2) AS DOUBLE) AS ttm FROM s LEFT JOIN z ON z.k = s.k AND z.y = s.y - 1 LEFT JOIN (SELECT k, y, q, ytd AS was FROM s) p ON p.k = s.k AND p.y = s.y - 1 AND p.q = s.q""")
def ttm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last year's whole, less its same part, plus this year's so far; the fourth quarter is its own year."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.year("o_orderdate").alias("y"), F.quarter("o_orderdate").alias("q")).agg(F.sum(F.col("o_totalprice").cast("decimal(18,2)")).alias("v"))
    s = o.select("k", "y", "q", F.sum("v").over(Window.partitionBy("k", "y").orderBy("q")).alias("ytd"))
    whole = s.groupBy("k", (F.col("y") + 1).alias("y")).agg(F.max_by("ytd", "q").alias("full_year"))
    same = s.select("k", (F.col("y") + 1).alias("y"), "q", F.col("ytd").alias("was"))
    out = F.when(F.col("q") == 4, F.col("ytd")).otherwise(F.col("ytd") + F.col("full_year") - F.col("was"))
    return s.join(whole, ["k", "y"], "left").join(same, ["k", "y", "q"], "left").select("k", "y", "q", F.round(out, 2).cast("double").alias("ttm"))


FACTOR_PANEL = """r AS (SELECT symbol, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars), f AS (SELECT d, avg(r) AS m, avg(r) FILTER (symbol % 2 = 0) - avg(r) FILTER (symbol % 2 = 1) AS s FROM r WHERE r IS NOT NULL GROUP BY d),
p AS (SELECT symbol, d, r, m, s FROM r JOIN f USING (d) WHERE r IS NOT NULL AND m IS NOT NULL AND s IS NOT NULL)"""


def factor_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns with two daily factors: the mean of all symbols, and of even less odd symbols."""
    r = daily_bars(spark, sf_dir).select("symbol", "d", (F.col("close") / F.lag("close").over(series.by_day()) - 1).alias("r")).where("r is not null")
    low = F.col("symbol") % 2 == 0
    f = r.groupBy("d").agg(F.avg("r").alias("m"), (F.avg(F.when(low, F.col("r"))) - F.avg(F.when(~low, F.col("r")))).alias("s")).where("s is not null")
    return r.join(f, "d")


@query(f"""WITH {BARS}, {FACTOR_PANEL}, c AS (SELECT symbol, count(*) AS n, covar_samp(r, m) AS rm, covar_samp(r, s) AS rs, var_samp(m) AS mm, var_samp(s) AS ss, covar_samp(m, s) AS ms, var_samp(r) AS rr, avg(r) AS ar, avg(m) AS am, avg(s) AS as_, corr(m, s) AS c FROM p GROUP BY symbol),
b AS (SELECT *, (rm * ss - rs * ms) / (mm * ss - ms * ms) AS bm, (rs * mm - rm * ms) / (mm * ss - ms * ms) AS bs FROM c WHERE n >= 250), a AS (SELECT *, ar - bm * am - bs * as_ AS alpha, (bm * rm + bs * rs) / rr AS r2 FROM b)
SELECT symbol, n, round(bm, 4) AS beta_m, round(bs, 4) AS beta_s, round(alpha * 245, 4) AS alpha_year, round(pow(1 + alpha, 245) - 1, 4) AS alpha_compound, round(r2, 4) AS r2, round(c, 4) AS factor_corr,
round(alpha / sqrt((1 - r2) * rr * (n - 1) / (n - 3) * (1.0 / n + (am * am * ss - 2 * am * as_ * ms + as_ * as_ * mm) / ((n - 1) * (mm * ss - ms * ms)))), 3) AS t_alpha FROM a""")
def two_factor_ols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Least squares on two factors by the normal equations of one grouped aggregate, given 250 rows."""
    p = factor_panel(spark, sf_dir)
    cov = {"rm": F.covar_samp("r", "m"), "rs": F.covar_samp("r", "s"), "mm": F.var_samp("m"), "ss": F.var_samp("s"), "ms": F.covar_samp("m", "s"), "rr": F.var_samp("r"), "ar": F.avg("r"), "am": F.avg("m"), "a_s": F.avg("s"), "c": F.corr("m", "s")}
    x = p.groupBy("symbol").agg(F.count("*").alias("n"), *(v.alias(k) for k, v in cov.items())).where("n >= 250").withColumn("det", F.expr("mm * ss - ms * ms"))
    x = x.withColumns({"bm": F.expr("(rm * ss - rs * ms) / det"), "bs": F.expr("(rs * mm - rm * ms) / det")}).withColumns({"alpha": F.expr("ar - bm * am - bs * a_s"), "r2": F.expr("(bm * rm + bs * rs) / rr")})
    error = "sqrt((1 - r2) * rr * (n - 1) / (n - 3) * (1.0D / n + (am * am * ss - 2 * am * a_s * ms + a_s * a_s * mm) / ((n - 1) * det)))"
    out = {"beta_m": "bm", "beta_s": "bs", "alpha_year": "alpha * 245", "alpha_compound": "pow(1 + alpha, 245) - 1", "r2": "r2", "factor_corr": "c"}
    return x.select("symbol", "n", *(F.round(F.expr(e), 4).alias(k) for k, e in out.items()), F.round(F.expr(f"alpha / {error}"), 3).alias("t_alpha"))


@query(f"""WITH {BARS}, {FACTOR_PANEL}, c AS (SELECT symbol, corr(r, m) AS cm, corr(r, s) AS cs, regr_slope(r, m) AS bm, regr_r2(r, m) AS r2 FROM p GROUP BY symbol)
SELECT symbol, round(cm, 4) AS corr_m, round(cs, 4) AS corr_s, round(bm, 4) AS slope_m, round(r2, 4) AS r2_m, CASE WHEN cs > cm THEN 's' ELSE 'm' END AS dominant FROM c""")
def style_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which factor a symbol goes with most."""
    x = factor_panel(spark, sf_dir).groupBy("symbol").agg(F.corr("r", "m").alias("corr_m"), F.corr("r", "s").alias("corr_s"), F.regr_slope("r", "m").alias("slope_m"), F.regr_r2("r", "m").alias("r2_m"))
    return rounded(x.withColumn("dominant", F.when(F.col("corr_s") > F.col("corr_m"), "s").otherwise("m")), "corr_m", "corr_s", "slope_m", "r2_m")


@query(f"""WITH {BARS}, e AS (
  SELECT symbol, CAST(date_trunc('month', d) AS DATE) AS d, 1 + ln(1 + count(*)) / 10 AS f FROM bars GROUP BY 1, 2
), n AS (
  SELECT symbol, d, f / max_by(f, d) OVER (PARTITION BY symbol) AS f FROM e
)
SELECT b.symbol, b.d, round(b.close * n.f + 2e-9, 4) AS qfq, b.d <> n.d AS closed FROM bars b ASOF JOIN n ON b.symbol = n.symbol AND b.d >= n.d""")
def last_factor_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event factors scaled so that the last is 1, carried from their day on. Events are on the first of a
    month, mostly a day without a bar (`closed`), whose factor must not get lost."""
    from tidemill.operators import temporal

    b = daily_bars(spark, sf_dir)
    e = b.groupBy("symbol", F.trunc("d", "month").alias("d")).agg((1 + F.log1p(F.count("*")) / 10).alias("f"))
    last = F.max_by("f", "d").over(Window.partitionBy("symbol"))
    own = e.select("symbol", "d", F.struct((F.col("f") / last).alias("f"), F.col("d").alias("at")).alias("e"))
    x = temporal.asof_join(b, own, "symbol", "d", "e").where("e is not null")
    return x.select("symbol", "d", F.round(F.col("close") * F.col("e.f") + 2e-9, 4).alias("qfq"), (F.col("d") != F.col("e.at")).alias("closed"))


#: Bounds of the day's state, as wide as these prices move.
LIQUIDITY = {"index_crisis": -8, "index_watch": -10, "small_crisis": -20, "small_watch": -16, "down_crisis": 16, "down_watch": 14, "ratio_crisis": 50, "ratio_watch": 62}
FIRED = "array_to_string(list_filter([{}], lambda t: t IS NOT NULL), ',')"


def fired_sql(tests: dict[str, str]) -> str:
    return FIRED.format(", ".join(f"CASE WHEN {c} THEN '{k}' END" for k, c in tests.items()))


CRISIS_SQL = fired_sql({"down>=16": "down >= 16", "small<=-20": "small <= -20", "index<=-8 and ratio>=50": "index <= -8 AND ratio >= 50"})
WATCH_SQL = fired_sql({"index<=-10": "index <= -10", "down>=14": "down >= 14", "ratio>=62": "ratio >= 62", "small<=-16": "small <= -16"})


@query(f"""WITH {BREADTH}, level AS (
  SELECT d, avg(close) AS a, avg(close) FILTER (symbol % 4 = 1) AS s FROM bars GROUP BY d
), moves AS (
  SELECT d, (a / lag(a) OVER (ORDER BY d) - 1) * 100 AS index, (s / lag(s) OVER (ORDER BY d) - 1) * 100 AS small FROM level
), y AS (
  SELECT d, down, 100.0::DOUBLE * down / n AS ratio, index, small FROM day JOIN moves USING (d)
), t AS (SELECT d, {CRISIS_SQL} AS crisis, {WATCH_SQL} AS watch FROM y)
SELECT d, CASE WHEN crisis <> '' THEN 'CRISIS' WHEN watch <> '' THEN 'WATCH' ELSE 'NORMAL' END AS state, CASE WHEN crisis <> '' THEN crisis ELSE watch END AS triggers FROM t""")
def breadth_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of the day by how many symbols fell to their limit, their share, and the moves of a wide and a small
    index, with the tests that fired; the window runs over a row a day."""
    level = daily_bars(spark, sf_dir).groupBy("d").agg(F.avg("close").alias("a"), F.avg(F.when(F.col("symbol") % 4 == 1, F.col("close"))).alias("s"))
    move = lambda c: (F.col(c) / F.lag(c).over(Window.orderBy("d")) - 1) * 100
    x = breadth_days(spark, sf_dir).join(level.select("d", move("a").alias("index"), move("s").alias("small")), "d")
    state, fired = classify.liquidity_class(F.col("index"), F.col("small"), F.col("down"), 100.0 * F.col("down") / F.col("n"), LIQUIDITY)
    return x.select("d", state.alias("state"), F.array_join(fired, ",").alias("triggers"))


@query("""WITH m AS (SELECT CAST(o_orderdate AS DATE) AS d, sum(CAST(o_totalprice AS DECIMAL(18, 2))) FILTER (o_orderstatus = 'F') AS b FROM orders GROUP BY 1), t AS (SELECT CAST(l_shipdate AS DATE) AS d, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS v FROM lineitem GROUP BY 1)
SELECT m.d, round(CAST(100 * b AS DOUBLE) / CAST(v AS DOUBLE), 4) AS share, CASE WHEN 100 * b >= 20 * v THEN 'hot' WHEN 100 * b >= 18 * v THEN 'warm' ELSE 'calm' END AS level FROM m ASOF JOIN t ON m.d >= t.d WHERE m.b IS NOT NULL AND CAST(m.d - t.d AS INTEGER) <= 10""")
def leverage_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Financed amounts against the turnover of the day, or of the last day within ten that has one."""
    from tidemill.operators import temporal

    m = load(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("d")).agg(F.sum(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice").cast("decimal(18,2)"))).alias("b")).withColumn("one", F.lit(1))
    t = load(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).alias("v")).withColumn("one", F.lit(1))
    x = temporal.asof_join(m, t, "one", "d", "v", tolerance_days=10).where("v is not null and b is not null")  # a row a day
    level = F.when(100 * F.col("b") >= 20 * F.col("v"), "hot").when(100 * F.col("b") >= 18 * F.col("v"), "warm").otherwise("calm")
    return x.select("d", F.round((100 * F.col("b")).cast("double") / F.col("v").cast("double"), 4).alias("share"), level.alias("level"))


@query("""WITH m AS (SELECT o_custkey AS k, date_trunc('month', o_orderdate)::DATE AS m, median(o_totalprice) AS v FROM orders GROUP BY 1, 2), x AS (SELECT k, m, v, v / lag(v) OVER (PARTITION BY k ORDER BY m) - 1 AS chg FROM m) SELECT k, m, round(v + 1e-5, 2) AS v, round(chg, 4) AS chg FROM x WHERE abs(chg) > 0.5""")
def month_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly medians that part from the month before by over a half."""
    m = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k"), F.trunc("o_orderdate", "month").alias("m")).agg(F.median("o_totalprice").alias("v"))
    x = m.withColumn("chg", F.col("v") / F.lag("v").over(Window.partitionBy("k").orderBy("m")) - 1).where("abs(chg) > 0.5")
    return x.select("k", "m", F.round(F.col("v") + 1e-5, 2).alias("v"), F.round("chg", 4).alias("chg"))
