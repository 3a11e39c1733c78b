"""Table audits, task generators, reads, routing and code rules, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import classify
from tidemill.operators import maintenance, series, temporal
from tidemill.plans.catalogue import BARS, query
from tidemill.sources.tables import calendar, daily_bars, load, read_range

CAL = "cal AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders)"


def one_of(df: DataFrame, *made) -> DataFrame:
    """One row of aggregates over a table."""
    return df.agg(*made)


@query(f"WITH {BARS} SELECT symbol, d, close FROM bars WHERE symbol IN (1, 3, 7) AND d BETWEEN DATE '1996-01-01' AND DATE '1997-06-30'")
def codes_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Some symbols over a range of days; both predicates reach the scan."""
    li = read_range(spark, sf_dir, "lineitem", "1996-01-01", "1997-06-30", ["l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity"], {"l_suppkey": [1, 3, 7], "absent": [1]})
    return li.groupBy(F.col("l_suppkey").alias("symbol"), F.to_date("l_shipdate").alias("d")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("close"))


@query(f"WITH {BARS}, n AS (SELECT d, row_number() OVER (ORDER BY d) AS slice FROM (SELECT DISTINCT d FROM bars)) SELECT slice, row_number() OVER (PARTITION BY d ORDER BY symbol) AS nth, symbol, close FROM bars JOIN n USING (d)")
def day_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days in order, and symbols in order within a day, by numbers instead of one sorted stream."""
    b = daily_bars(spark, sf_dir)
    days = b.select("d").distinct().withColumn("slice", F.row_number().over(Window.orderBy("d")).cast("long"))  # a row a day
    return b.join(days, "d").select("slice", F.row_number().over(Window.partitionBy("d").orderBy("symbol")).cast("long").alias("nth"), "symbol", "close")


@query("SELECT CAST(year(o_orderdate) AS INTEGER) AS y, min(o_totalprice) AS low, max(o_totalprice) AS high, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day, count(*) AS n FROM orders GROUP BY 1")
def year_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of a column and of the days, by year."""
    o = load(spark, sf_dir, "orders")
    return o.groupBy(F.year("o_orderdate").alias("y")).agg(F.min("o_totalprice").alias("low"), F.max("o_totalprice").alias("high"), F.to_date(F.min("o_orderdate")).alias("first_day"), F.to_date(F.max("o_orderdate")).alias("last_day"), F.count("*").alias("n"))


@query(f"WITH {BARS}, a(symbol, d) AS (SELECT symbol, min(d) + 30 FROM bars GROUP BY symbol UNION ALL SELECT symbol, max(d) FROM bars GROUP BY symbol) SELECT a.symbol, a.d, max_by(b.close, b.d) AS close, CAST(a.d - max(b.d) AS INTEGER) AS age FROM a LEFT JOIN bars b ON b.symbol = a.symbol AND b.d <= a.d AND b.d >= a.d - 400 GROUP BY 1, 2")
def past_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Asked values: that of the day, else of the last day within 400 before it."""
    b = daily_bars(spark, sf_dir).withColumn("at", F.col("d"))
    asked = b.groupBy("symbol").agg(F.array(F.date_add(F.min("d"), 30), F.max("d")).alias("x")).select("symbol", F.explode("x").alias("d"))
    x = temporal.asof_join(asked, b.select("symbol", "d", F.struct("close", "at").alias("v")), "symbol", "d", "v", tolerance_days=400)
    return x.select("symbol", "d", F.col("v.close").alias("close"), F.datediff("d", "v.at").alias("age"))


@query(f"WITH {CAL}, n AS (SELECT d, row_number() OVER (ORDER BY d) AS i FROM cal) SELECT a.d, lag(a.d) OVER (ORDER BY a.d) AS previous, lead(a.d) OVER (ORDER BY a.d) AS next, CAST(i > max(i) OVER () - 20 AS BOOLEAN) AS recent, count(*) OVER (ORDER BY a.d RANGE BETWEEN INTERVAL 30 DAY PRECEDING AND CURRENT ROW) - 1 AS open_days_30 FROM n a")
def calendar_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trading day before and after, the twenty last, and open days in (d - 31, d]; windows over a row a day."""
    w = Window.orderBy("d")
    c = calendar(spark, sf_dir).withColumn("i", F.row_number().over(w))
    days = Window.orderBy(F.unix_date("d")).rangeBetween(-30, 0)
    last = F.max("i").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return c.select("d", F.lag("d").over(w).alias("previous"), F.lead("d").over(w).alias("next"), (F.col("i") > last - 20).alias("recent"), (F.count("*").over(days) - 1).alias("open_days_30"))


COLUMNS = ("o_orderkey", "o_custkey", "o_totalprice", "low", "zero", "same")


@query(f"""WITH x AS (SELECT o_orderdate AS t, CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS low, CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS zero, CAST(1 AS DOUBLE) AS same FROM orders)
{' UNION ALL '.join(f"SELECT '{c}' AS col, count(*) - count({c}) AS nulls, round(count(*) FILTER ({c} = 0) * 1.0 / nullif(count({c}), 0), 4) AS zero_share, count(DISTINCT {c}) <= 1 AS constant, max_by({c}, (t, o_orderkey)) = 0 AS latest_zero FROM x" for c in COLUMNS)}""")
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls, share of zeros, constant columns and a last value, nulls aside, of zero, in one pass."""
    done = F.col("o_orderstatus") == "F"
    x = load(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("t"), *(F.col(c).cast("double").alias(c) for c in COLUMNS[:3]), F.when(done, F.col("o_totalprice")).alias("low"), F.when(done, F.col("o_totalprice")).otherwise(0.0).alias("zero"), F.lit(1.0).alias("same"))
    last = lambda c: F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("t", "o_orderkey")))
    facts = lambda c: F.struct(F.lit(c).alias("col"), (F.count("*") - F.count(c)).alias("nulls"), F.round(F.count(F.when(F.col(c) == 0, 1)) / F.nullif(F.count(c), F.lit(0)), 4).alias("zero_share"), (F.min(c).eqNullSafe(F.max(c))).alias("constant"), (last(c) == 0).alias("latest_zero"))
    return one_of(x, F.array(*(facts(c) for c in COLUMNS)).alias("x")).select(F.explode("x").alias("r")).select("r.*")


CODE = "lpad(CAST((p_partkey * 7919) % 1000000 AS VARCHAR), 6, '0')"
SYMBOL = f"c AS (SELECT p_partkey, {CODE} AS c, CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN 'SH' WHEN 1 THEN 'SZ' WHEN 2 THEN 'CSI' WHEN 3 THEN 'SH' ELSE 'BJ' END AS x, p_partkey % 11 = 0 AS gone FROM part), s AS (SELECT p_partkey, c, x, CASE WHEN gone THEN 'T' ELSE '' END || c || '.' || x AS symbol FROM c)"


def symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    suffix = F.element_at(F.array(*map(F.lit, ("SH", "SZ", "CSI", "SH", "BJ"))), (k % 5 + 1).cast("int"))
    code = F.lpad((k * 7919 % 1000000).cast("string"), 6, "0")
    return load(spark, sf_dir, "part").select("p_partkey", code.alias("c"), suffix.alias("x"), F.concat(F.when(k % 11 == 0, "T").otherwise(""), code, F.lit("."), suffix).alias("symbol"))


@query(f"""WITH {SYMBOL}, t AS (SELECT p_partkey, symbol, CASE WHEN x IN ('CSI', 'CNI') OR regexp_matches(c, '^(399|93|H3|98)') OR (c LIKE '000%' AND x = 'SH') THEN 'index' WHEN regexp_matches(c, '^(600|601|603|605|688|689|900|00|30|20|43|83|87|92)') THEN 'stock' ELSE 'fund' END AS daily FROM s)
SELECT p_partkey, symbol, daily, CASE daily WHEN 'fund' THEN 'fund_adj' ELSE 'adj_factor' END AS factor, daily NOT IN ('stock', 'fund') AS conflict FROM t""")
def route_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which daily table and which factor table a symbol belongs to, and whether a feed of stocks and funds lacks it."""
    t = symbols(spark, sf_dir).withColumn("daily", classify.daily_table(F.col("symbol")))
    return t.select("p_partkey", "symbol", "daily", F.when(F.col("daily") == "fund", "fund_adj").otherwise("adj_factor").alias("factor"), (~F.col("daily").isin("stock", "fund")).alias("conflict"))


@query(f"""WITH {SYMBOL}, {BARS}, t AS (SELECT p_partkey AS symbol, CASE WHEN x IN ('CSI', 'CNI') OR regexp_matches(c, '^(399|93|H3|98)') OR (c LIKE '000%' AND x = 'SH') THEN 'index' WHEN regexp_matches(c, '^(600|601|603|605|688|689|900|00|30|20|43|83|87|92)') THEN 'stock' ELSE 'fund' END AS daily FROM s)
SELECT d, count(*) AS n, count(*) FILTER (daily = 'stock') AS stocks, round(CAST(sum(CASE daily WHEN 'stock' THEN vol * 100 WHEN 'fund' THEN vol * 10 ELSE vol END) AS DOUBLE), 2) AS shares FROM bars JOIN t USING (symbol) GROUP BY d""")
def mixed_feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three daily tables, each in its own units, brought together as one cross-section a day."""
    t = symbols(spark, sf_dir).select(F.col("p_partkey").alias("symbol"), classify.daily_table(F.col("symbol")).alias("daily"))
    b = daily_bars(spark, sf_dir).join(t, "symbol").select("d", "daily", "vol")
    feeds = [b.where(F.col("daily") == k).select("d", "daily", (F.col("vol") * u).alias("shares")) for k, u in (("stock", 100), ("fund", 10), ("index", 1))]
    whole = feeds[0].unionByName(feeds[1]).unionByName(feeds[2])
    return whole.groupBy("d").agg(F.count("*").alias("n"), F.count(F.when(F.col("daily") == "stock", 1)).alias("stocks"), F.round(F.sum("shares"), 2).alias("shares"))


@query(f"""WITH {SYMBOL} SELECT p_partkey, CASE x WHEN 'SH' THEN '1.' || c WHEN 'SZ' THEN '0.' || c WHEN 'BJ' THEN '0.' || c END AS secid, CASE x WHEN 'SH' THEN 'sh' || c WHEN 'SZ' THEN 'sz' || c END AS short, CASE WHEN c LIKE '5%' THEN c || '.SH' WHEN c LIKE '1%' THEN c || '.SZ' ELSE c || '.SH' END AS fund_code,
CASE x WHEN 'SH' THEN c LIKE '5%' WHEN 'SZ' THEN regexp_matches(c, '^1[5678]') ELSE FALSE END AS is_fund, CASE WHEN x = 'SH' AND c LIKE '50%' THEN 'LOF' WHEN x = 'SH' AND regexp_matches(c, '^5[1235689]') THEN 'ETF' WHEN x = 'SZ' AND regexp_matches(c, '^15[89]') THEN 'ETF' WHEN x = 'SZ' AND regexp_matches(c, '^1[68]') THEN 'LOF' ELSE 'other' END AS kind FROM s""")
def code_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The forms of a code elsewhere, and whether and which fund it is."""
    c, x = F.col("c"), F.col("x")
    secid = F.when(x == "SH", F.concat(F.lit("1."), c)).when(x.isin("SZ", "BJ"), F.concat(F.lit("0."), c))
    short = F.when(x == "SH", F.concat(F.lit("sh"), c)).when(x == "SZ", F.concat(F.lit("sz"), c))
    fund_code = F.concat(c, F.when(c.startswith("1"), ".SZ").otherwise(".SH"))
    return symbols(spark, sf_dir).select("p_partkey", secid.alias("secid"), short.alias("short"), fund_code.alias("fund_code"), classify.is_fund(c, x).alias("is_fund"), classify.fund_kind(c, x).alias("kind"))


NAMES = "CASE CAST(p_partkey % 8 AS INTEGER) WHEN 0 THEN '纳斯达克ETF' WHEN 1 THEN '现金增利' WHEN 2 THEN '金ETF' WHEN 3 THEN '可转债' ELSE p_name END"


@query(f"""WITH {SYMBOL}, n AS (SELECT s.*, {NAMES} AS name, DATE '2018-01-01' + CAST(s.p_partkey % 1500 AS INTEGER) AS d, CASE CAST(s.p_partkey % 3 AS INTEGER) WHEN 0 THEN 'star board index' WHEN 1 THEN 'growth board index' ELSE 'broad index' END AS bench, s.p_partkey % 4 <> 1 AS equity FROM s JOIN part USING (p_partkey))
SELECT p_partkey, CASE WHEN regexp_matches(name, '恒生|港股|纳斯达克|标普|道琼斯|日经|德国|法国|亚太|中概|海外|跨境|QDII|美国|香港') THEN 'foreign' WHEN regexp_matches(name, '货币|现金') THEN 'money' WHEN regexp_matches(name, '黄金|金ETF') THEN 'gold' WHEN contains(name, '债') THEN 'bond' WHEN c LIKE '513%' THEN 'foreign' WHEN c LIKE '511%' THEN 'bond' ELSE 'stock' END AS subclass,
CAST(CASE WHEN NOT equity THEN 0.1 WHEN bench LIKE '%star%' AND d >= DATE '2019-07-22' THEN 0.2 WHEN bench LIKE '%growth%' AND d >= DATE '2020-08-24' THEN 0.2 ELSE 0.1 END AS DOUBLE) AS lim FROM n""")
def fund_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subclass of a fund by its name, then its code; its price limit by what it follows, and since when."""
    k = F.col("p_partkey")
    name = F.when(k % 8 == 0, "纳斯达克ETF").when(k % 8 == 1, "现金增利").when(k % 8 == 2, "金ETF").when(k % 8 == 3, "可转债").otherwise(F.col("p_name"))
    bench = F.when(k % 3 == 0, "star board index").when(k % 3 == 1, "growth board index").otherwise("broad index")
    n = symbols(spark, sf_dir).join(load(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_partkey").withColumns({"name": name, "bench": bench, "d": F.date_add(F.lit("2018-01-01").cast("date"), (k % 1500).cast("int"))})
    return n.select("p_partkey", classify.fund_subclass(F.col("c"), F.col("name")).alias("subclass"), classify.fund_limit(k % 4 != 1, F.col("bench"), F.col("d")).alias("lim"))


@query("""WITH s AS (SELECT o_custkey AS k, CAST(min(o_orderdate) AS DATE) AS a, CASE WHEN o_custkey % 3 <> 0 THEN CAST(max(o_orderdate) AS DATE) END AS e FROM orders GROUP BY o_custkey)
SELECT k, a <= DATE '1998-01-01' AND coalesce(e >= DATE '1998-01-01', TRUE) AS on_day, a <= DATE '1996-01-31' AND (e IS NULL OR e >= DATE '1996-01-01') AS in_span FROM s""")
def alive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Who is listed on a day, and who at any time of a span; no end is open."""
    s = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("o_orderdate")).alias("e")).withColumn("e", F.when(F.col("k") % 3 != 0, F.col("e")))
    day = lambda x: F.lit(x).cast("date")
    ends = lambda x: F.coalesce(F.col("e") >= day(x), F.lit(True))
    return s.select("k", ((F.col("a") <= day("1998-01-01")) & ends("1998-01-01")).alias("on_day"), ((F.col("a") <= day("1996-01-31")) & ends("1996-01-01")).alias("in_span"))


@query("""WITH r AS (SELECT o_custkey AS k, o_orderkey AS id, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v FROM orders WHERE month(o_orderdate) = 12 AND o_orderdate < TIMESTAMP '1999-01-01' AND o_orderstatus <> 'P'), l AS (SELECT k, v, d FROM r QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC, id) = 1)
SELECT c_custkey AS k, round(c_acctbal, 2) AS bal, v FROM customer JOIN l ON k = c_custkey WHERE c_acctbal > 0 AND c_acctbal < 9000 AND v > 50000 AND c_mktsegment <> 'MACHINERY'""")
def screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest year-end report known on a day, joined to bounds on other figures."""
    o = load(spark, sf_dir, "orders").where("month(o_orderdate) = 12 and o_orderdate < timestamp'1999-01-01' and o_orderstatus <> 'P'")
    r = o.select(F.col("o_custkey").alias("k"), "o_orderkey", F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"))
    latest = temporal.latest_by(r, ["k"], [F.desc("d"), F.col("o_orderkey")]).where("v > 50000")
    c = load(spark, sf_dir, "customer").where("c_acctbal > 0 and c_acctbal < 9000 and c_mktsegment <> 'MACHINERY'")
    return c.join(latest, c.c_custkey == latest.k).select("k", F.round("c_acctbal", 2).alias("bal"), "v")


@query(f"""WITH {BARS}, r AS (SELECT symbol, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars), t AS (SELECT symbol, r, try_cast(CASE WHEN symbol % 3 = 0 THEN 'n/a' ELSE CAST(symbol AS VARCHAR) || '.5' END AS DOUBLE) AS x FROM r) SELECT symbol, round(avg(greatest(-0.2, least(0.2, r))), 6) AS clipped, round(avg(r) FILTER (abs(r) < 0.25), 6) AS trimmed, max(x) AS x FROM t WHERE r IS NOT NULL GROUP BY symbol""")
def clipped_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means of returns held in a fifth, and without those of a quarter and more; text that is no number is null."""
    r = daily_bars(spark, sf_dir).select("symbol", (F.col("close") / F.lag("close").over(series.by_day()) - 1).alias("r")).where("r is not null")
    x = F.when(F.col("symbol") % 3 == 0, "n/a").otherwise(F.concat(F.col("symbol").cast("string"), F.lit(".5"))).try_cast("double")
    return r.groupBy("symbol").agg(F.round(F.avg(F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("r")))), 6).alias("clipped"), F.round(F.avg(F.when(F.abs("r") < 0.25, F.col("r"))), 6).alias("trimmed"), F.max(x).alias("x"))


@query(f"WITH {CAL}, m AS (SELECT max(d) AS d FROM cal GROUP BY year(d), month(d)), w AS (SELECT max(d) AS d FROM cal GROUP BY yearweek(d)), f AS (SELECT DISTINCT date_trunc('week', d)::DATE + 4 AS d FROM cal) SELECT 'month' AS kind, d FROM m UNION ALL SELECT 'week', d FROM w UNION ALL SELECT 'friday', d FROM f WHERE d <= (SELECT max(d) FROM cal) UNION ALL SELECT 'report', CAST(q AS DATE) FROM (SELECT unnest(generate_series(DATE '1995-03-31', (SELECT max(d) FROM cal), INTERVAL 3 MONTH)) AS g), LATERAL (SELECT last_day(g) AS q) WHERE q <= (SELECT max(d) FROM cal)")
def expected_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days for which something is due: last of month and week, the week's Friday even if closed, and
    quarter ends, none after the last day."""
    c = calendar(spark, sf_dir)
    end = c.agg(F.max("d").alias("end"))  # one row
    m = c.groupBy(F.trunc("d", "month")).agg(F.max("d").alias("d")).select(F.lit("month").alias("kind"), "d")
    w = c.groupBy(F.trunc("d", "week")).agg(F.max("d").alias("d")).select(F.lit("week").alias("kind"), "d")
    fridays = c.select(F.date_add(F.trunc("d", "week"), 4).alias("d")).distinct().join(F.broadcast(end), F.col("d") <= F.col("end")).select(F.lit("friday").alias("kind"), "d")
    quarters = end.select("end", F.explode(F.sequence(F.lit("1995-03-01").cast("date"), F.col("end"), F.expr("interval 3 month"))).alias("q")).select(F.lit("report").alias("kind"), F.last_day("q").alias("d"), "end").where("d <= end").drop("end")
    return m.unionByName(w).unionByName(fridays).unionByName(quarters)


@query(f"WITH {CAL}, done AS (SELECT DISTINCT CAST(l_shipdate AS DATE) + 2 AS d FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT cal.d FROM cal ANTI JOIN done USING (d)) SELECT d, strftime(d, '%Y-%m') AS month_key, strftime(d, '%G-W%V') AS week_key, count(*) OVER (PARTITION BY date_trunc('month', d)) AS in_month FROM g")
def gaps_by_period(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected days that are not done, with the keys of their month and ISO week."""
    done = load(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(F.date_add(F.to_date("l_shipdate"), 2).alias("d")).distinct()
    g = calendar(spark, sf_dir).join(done, "d", "left_anti")
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "d").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("d").cast("string"), 2, "0"))
    return g.select("d", F.date_format("d", "yyyy-MM").alias("month_key"), week.alias("week_key"), F.count("*").over(Window.partitionBy(F.trunc("d", "month"))).alias("in_month"))


@query("""WITH c AS (SELECT max(CAST(o_orderdate AS DATE)) AS today FROM orders), l AS (SELECT o_custkey AS k, max(CAST(o_orderdate AS DATE)) AS last, count(*) AS n FROM orders GROUP BY 1), x AS (SELECT k, CAST(today - last AS INTEGER) AS age, k % 2 = 0 AS daily, n FROM l, c)
SELECT k, age, CASE WHEN daily THEN CASE WHEN age <= 7 THEN 'fresh' WHEN age <= 30 THEN 'late' ELSE 'stale' END WHEN age <= 60 THEN 'fresh' WHEN age <= 180 THEN 'late' ELSE 'stale' END AS verdict, CASE WHEN n < 3 THEN 'few rows' WHEN age > 365 THEN 'ended' ELSE 'behind' END AS diagnosis FROM x""")
def freshness_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Age of what is there against the bounds of its kind, and a first diagnosis."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"))
    l = o.groupBy("k").agg(F.max("d").alias("last"), F.count("*").alias("n"))  # noqa: E741
    x = l.crossJoin(F.broadcast(o.agg(F.max("d").alias("today")))).withColumn("age", F.datediff("today", "last"))  # one row
    level = lambda a, b: F.when(F.col("age") <= a, "fresh").when(F.col("age") <= b, "late").otherwise("stale")
    diagnosis = F.when(F.col("n") < 3, "few rows").when(F.col("age") > 365, "ended").otherwise("behind")
    return x.select("k", "age", F.when(F.col("k") % 2 == 0, level(7, 30)).otherwise(level(60, 180)).alias("verdict"), diagnosis.alias("diagnosis"))


@query("""WITH d AS (SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d FROM lineitem), a AS (SELECT DISTINCT k, d FROM d), s AS (SELECT k, min(d) AS first_seen, count(*) AS n FROM a GROUP BY k), r AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE DATE '1995-01-01' + CAST(s_suppkey AS INTEGER) END AS listed, s_suppkey % 3 = 0 AS registered FROM supplier)
SELECT r.k, CASE WHEN n IS NULL THEN 'no_daily' WHEN listed IS NULL THEN 'list_na' WHEN first_seen < listed THEN 'early' WHEN first_seen > listed + 10 THEN 'late' ELSE 'ok' END AS verdict, CASE WHEN registered AND first_seen <= listed + 10 THEN 'stale' WHEN registered THEN 'known' ELSE 'new' END AS registry FROM r LEFT JOIN s USING (k)""")
def start_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First day seen against the listing day, and entries of a registry that no longer hold."""
    seen = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.to_date(F.min("l_shipdate")).alias("first_seen"))
    k = F.col("s_suppkey")
    r = load(spark, sf_dir, "supplier").select(k.alias("k"), F.when(k % 4 != 0, F.date_add(F.lit("1995-01-01").cast("date"), k.cast("int"))).alias("listed"), (k % 3 == 0).alias("registered"))
    late = F.col("first_seen") > F.date_add("listed", 10)
    verdict = F.when(F.col("first_seen").isNull(), "no_daily").when(F.col("listed").isNull(), "list_na").when(F.col("first_seen") < F.col("listed"), "early").when(late, "late").otherwise("ok")
    return r.join(seen, "k", "left").select("k", verdict.alias("verdict"), F.when(F.col("registered") & ~late, "stale").when(F.col("registered"), "known").otherwise("new").alias("registry"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, count(*) AS n, count(DISTINCT (l_partkey, l_suppkey, l_quantity, l_extendedprice)) AS kinds FROM lineitem GROUP BY 1, 2)
SELECT CASE WHEN n = 1 THEN 'unique' WHEN kinds = 1 THEN 'copies' WHEN kinds = n THEN 'key too narrow' ELSE 'both' END AS verdict, count(*) AS keys, CAST(sum(n) AS BIGINT) AS n_rows FROM x GROUP BY 1""")
def key_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether keys that repeat are copies of a row or a key that is too narrow."""
    x = load(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.count_distinct(F.struct("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")).alias("kinds"))
    verdict = F.when(F.col("n") == 1, "unique").when(F.col("kinds") == 1, "copies").when(F.col("kinds") == F.col("n"), "key too narrow").otherwise("both")
    return x.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("keys"), F.sum("n").alias("n_rows"))


@query("""WITH a AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders), b AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS d FROM lineitem WHERE l_returnflag = 'A') SELECT coalesce(a.d, b.d) AS d, CASE WHEN b.d IS NULL THEN 'only left' ELSE 'only right' END AS side, CASE WHEN coalesce(a.d, b.d) > (SELECT max(d) FROM a) THEN 'after end' WHEN dayofweek(coalesce(a.d, b.d)) IN (0, 6) THEN 'weekend' ELSE 'gap' END AS cause FROM a FULL JOIN b ON a.d = b.d WHERE a.d IS NULL OR b.d IS NULL""")
def two_way_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days that one of two tables lacks, with a cause."""
    a = calendar(spark, sf_dir).withColumn("a", F.lit(True))
    b = load(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.to_date("l_shipdate").alias("d")).distinct().withColumn("b", F.lit(True))
    x = a.join(b, "d", "full").where("a is null or b is null").crossJoin(F.broadcast(a.agg(F.max("d").alias("end"))))  # one row
    cause = F.when(F.col("d") > F.col("end"), "after end").when(F.dayofweek("d").isin(1, 7), "weekend").otherwise("gap")
    return x.select("d", F.when(F.col("b").isNull(), "only left").otherwise("only right").alias("side"), cause.alias("cause"))


@query("""WITH f AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 = 0 THEN 'n/d' WHEN s_suppkey % 5 = 0 THEN '1996-1-1' ELSE '1996-01-' || lpad(CAST(1 + s_suppkey % 28 AS VARCHAR), 2, '0') END AS t, s_nationkey FROM supplier)
SELECT s_nationkey AS nation, count(*) AS n, round(avg(CASE WHEN regexp_matches(t, '^\\d{4}-?\\d{2}-?\\d{2}$') THEN 1.0 ELSE 0 END), 4) AS date_share FROM f GROUP BY 1""")
def date_likeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of texts that look like a day."""
    k = F.col("s_suppkey")
    t = F.when(k % 6 == 0, "n/d").when(k % 5 == 0, "1996-1-1").otherwise(F.concat(F.lit("1996-01-"), F.lpad((1 + k % 28).cast("string"), 2, "0")))
    return load(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("n"), F.round(F.avg(t.rlike(r"^\d{4}-?\d{2}-?\d{2}$").cast("double")), 4).alias("date_share"))


@query("""WITH u AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderdate >= TIMESTAMP '2000-01-01'), s AS (SELECT c_custkey AS k, c_nationkey AS g FROM customer) SELECT g, count(*) AS codes, count(u.k) AS used, CASE WHEN count(u.k) = 0 THEN 'unused' WHEN count(u.k) * 10 >= count(*) * 9 THEN 'covered' ELSE 'partial' END AS verdict FROM s LEFT JOIN u ON u.k = s.k AND g <> 5 GROUP BY g""")
def consumer_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each group is used lately; group 5 is made one that nobody uses."""
    u = load(spark, sf_dir, "orders").where("o_orderdate >= timestamp'2000-01-01'").select(F.col("o_custkey").alias("k")).distinct().withColumn("used", F.lit(1))
    s = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g")).join(u, "k", "left").withColumn("used", F.when(F.col("g") != 5, F.col("used"))).groupBy("g").agg(F.count("*").alias("codes"), F.count("used").alias("used"))
    return s.withColumn("verdict", F.when(F.col("used") == 0, "unused").when(F.col("used") * 10 >= F.col("codes") * 9, "covered").otherwise("partial"))


@query(f"WITH {BARS} SELECT symbol, d, round(count(*) OVER (PARTITION BY symbol ORDER BY close) * 100.0 / count(*) OVER (PARTITION BY symbol), 2) AS percentile FROM bars")
def valuation_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of a symbol's values at or below each."""
    w = Window.partitionBy("symbol")
    return daily_bars(spark, sf_dir).select("symbol", "d", F.round(F.count("*").over(w.orderBy("close")) * 100.0 / F.count("*").over(w), 2).alias("percentile"))


@query("""WITH RECURSIVE t AS (SELECT c_nationkey AS g, c_custkey AS k, CAST(1 + c_custkey % 7 AS INTEGER) AS cost, row_number() OVER (PARTITION BY c_nationkey ORDER BY round(c_acctbal, 2), c_custkey) AS i FROM customer), f AS (SELECT g, k, i, CASE WHEN cost <= 20 THEN cost ELSE 0 END AS spent, cost <= 20 AS taken FROM t WHERE i = 1
UNION ALL SELECT t.g, t.k, t.i, CASE WHEN f.spent + t.cost <= 20 THEN f.spent + t.cost ELSE f.spent END, f.spent + t.cost <= 20 FROM f JOIN t ON t.g = f.g AND t.i = f.i + 1) SELECT g, k, taken FROM f""")
def budget_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of a group in order while a budget lasts; one that does not fit is passed over, later ones may
    fit. Of one cost only the first can be taken that the whole budget pays for, so no more of a group come
    together, and are folded with what is spent as state."""
    budget = 20
    c = load(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("g"), F.round("c_acctbal", 2).alias("a"), F.col("c_custkey").alias("k"), (1 + F.col("c_custkey") % 7).cast("int").alias("cost"))
    near = temporal.first_rows(c, ["g", "cost"], [F.col("a"), F.col("k")], F.floor(F.lit(budget) / F.col("cost")))
    start = F.struct(F.lit(0).alias("spent"), F.array().cast("array<long>").alias("taken"))

    def step(s, t):
        fits = s["spent"] + t["cost"] <= budget
        return F.struct(F.when(fits, s["spent"] + t["cost"]).otherwise(s["spent"]).alias("spent"), F.when(fits, F.array_append(s["taken"], t["k"])).otherwise(s["taken"]).alias("taken"))

    done = near.groupBy("g").agg(F.explode(F.aggregate(F.sort_array(F.collect_list(F.struct("a", "k", "cost"))), start, step, lambda s: s["taken"])).alias("k"))
    return c.join(done.withColumn("taken", F.lit(True)), ["g", "k"], "left").select("g", "k", F.coalesce("taken", F.lit(False)).alias("taken"))


@query("""WITH n AS (SELECT s_suppkey AS k FROM supplier), h AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '2001-10-30' AND l_returnflag = 'R') SELECT k FROM n EXCEPT SELECT k FROM h""")
def never_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of the universe was never completed."""
    done = load(spark, sf_dir, "lineitem").where("l_shipdate >= timestamp'2001-10-30' and l_returnflag = 'R'").select(F.col("l_suppkey").alias("k"))
    return load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k")).subtract(done)


@query("SELECT o_custkey AS k, count(*) AS n, count(DISTINCT date_trunc('month', o_orderdate)) AS months FROM orders GROUP BY 1 HAVING count(*) <= 8")
def short_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series with so few rows that they are candidates for repair, and the months they cover."""
    o = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("n"), F.count_distinct(F.trunc("o_orderdate", "month")).alias("months"))
    return o.where("n <= 8")


@query(f"""WITH {BARS}, a AS (SELECT symbol, d, close FROM bars WHERE vol % 9 <> 0), b AS (SELECT symbol, d, CASE WHEN vol % 7 = 0 THEN close * 1.001 ELSE close END AS close FROM bars WHERE vol % 11 <> 0) SELECT symbol, count(*) FILTER (b.close IS NULL) AS only_a, count(*) FILTER (a.close IS NULL) AS only_b, count(*) FILTER (abs(a.close - b.close) > 1e-4 * a.close) AS apart, count(*) AS n FROM a FULL JOIN b USING (symbol, d) GROUP BY symbol""")
def aligned_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sources of the same bars: rows that one lacks and values that part."""
    bars = daily_bars(spark, sf_dir)
    a = bars.where("vol % 9 <> 0").select("symbol", "d", F.col("close").alias("a"))
    b = bars.where("vol % 11 <> 0").select("symbol", "d", F.when(F.col("vol") % 7 == 0, F.col("close") * 1.001).otherwise(F.col("close")).alias("b"))
    some = lambda c: F.count(F.when(F.expr(c), 1))
    return a.join(b, ["symbol", "d"], "full").groupBy("symbol").agg(some("b is null").alias("only_a"), some("a is null").alias("only_b"), some("abs(a - b) > 1e-4D * a").alias("apart"), F.count("*").alias("n"))


@query(f"WITH {BARS}, n AS (SELECT symbol, d, close, row_number() OVER (PARTITION BY symbol ORDER BY d) AS i FROM bars), p AS (SELECT symbol, min_by(i, (-close, d)) AS top_i FROM n GROUP BY symbol) SELECT symbol, d, close, i - top_i AS offset_ FROM n JOIN p USING (symbol) WHERE i BETWEEN top_i - 5 AND top_i + 3")
def anchor_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rows before and three after each symbol's highest close."""
    n = daily_bars(spark, sf_dir).select("symbol", "d", "close", F.row_number().over(series.by_day()).cast("long").alias("i"))
    at = F.min_by("i", F.struct(-F.col("close"), F.col("d"))).over(Window.partitionBy("symbol"))
    return n.withColumn("at", at).where("i between at - 5 and at + 3").select("symbol", "d", "close", (F.col("i") - F.col("at")).alias("offset_"))


@query(f"""WITH {BARS}, r AS (SELECT symbol, d, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars), m AS (SELECT d, avg(r) AS b FROM r WHERE r IS NOT NULL GROUP BY d) SELECT CAST(year(d) AS INTEGER) AS y, symbol % 4 AS slice, round(avg(r - b) * 252, 4) AS excess, round(avg(r - b) / stddev_samp(r - b) * sqrt(252), 4) AS ir FROM r JOIN m USING (d) WHERE r IS NOT NULL GROUP BY 1, 2""")
def robust_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Excess return and information ratio by year and slice."""
    r = daily_bars(spark, sf_dir).select("symbol", "d", (F.col("close") / F.lag("close").over(series.by_day()) - 1).alias("r")).where("r is not null")
    x = r.join(r.groupBy("d").agg(F.avg("r").alias("b")), "d").withColumn("e", F.col("r") - F.col("b"))
    return x.groupBy(F.year("d").alias("y"), (F.col("symbol") % 4).alias("slice")).agg(F.round(F.avg("e") * 252, 4).alias("excess"), F.round(F.avg("e") / F.stddev_samp("e") * 252**0.5, 4).alias("ir"))


@query("""WITH x AS (
  SELECT CAST(year(o_orderdate) AS INTEGER) AS y, CAST(o_orderdate AS DATE) AS d,
         md5(concat_ws('|', o_orderkey, o_custkey, o_orderstatus, CAST(round(o_totalprice * 100) AS BIGINT), CAST(o_orderdate AS DATE), o_orderpriority)) AS m
  FROM orders
)
SELECT y, count(*) AS n, min(d) AS a, max(d) AS e, CAST(sum(('0x' || substr(m, 1, 12))::BIGINT) % 1000000007 AS BIGINT) AS mark, count(DISTINCT m) AS different FROM x GROUP BY y""")
def content_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, bounds and an order-free mark of the content, by year: a sum over digests of whole rows, so
    that repeated rows count as often as they come."""
    values = ["o_orderkey", "o_custkey", "o_orderstatus", F.round(F.col("o_totalprice") * 100).cast("long"), F.to_date("o_orderdate"), "o_orderpriority"]
    x = load(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y"), F.to_date("o_orderdate").alias("d"), F.md5(F.concat_ws("|", *values).cast("binary")).alias("m"))
    number = F.conv(F.substring("m", 1, 12), 16, 10).cast("decimal(20,0)")
    mark = F.pmod(F.sum(number), F.lit(1000000007)).cast("long")
    return x.groupBy("y").agg(F.count("*").alias("n"), F.min("d").alias("a"), F.max("d").alias("e"), mark.alias("mark"), F.count_distinct("m").alias("different"))


@query(f"WITH {BARS}, g AS (SELECT symbol, CAST(d - lag(d) OVER (PARTITION BY symbol ORDER BY d) AS INTEGER) AS gap FROM bars) SELECT symbol, CAST(median(gap) AS DOUBLE) AS gap, CASE WHEN median(gap) <= 4 THEN 'daily' WHEN median(gap) <= 10 THEN 'weekly' ELSE 'sparse' END AS pace FROM g GROUP BY symbol")
def median_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median days between rows, and which side of a join is the denser."""
    g = daily_bars(spark, sf_dir).select("symbol", F.datediff("d", F.lag("d").over(series.by_day())).alias("gap")).groupBy("symbol").agg(F.median("gap").alias("gap"))
    return g.withColumn("pace", F.when(F.col("gap") <= 4, "daily").when(F.col("gap") <= 10, "weekly").otherwise("sparse"))


@query("SELECT o_custkey AS k, any_value(c_name) AS name, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total, count(c_custkey) * 2 >= count(*) AS matched FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) c ON c_custkey = o_custkey GROUP BY 1")
def matched_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A left join with its match rate."""
    c = load(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    x = load(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")).join(c, "o_custkey", "left")
    return x.select(F.col("o_custkey").alias("k"), F.col("c_name").alias("name"), "n", "total", F.col("c_name").isNotNull().alias("matched"))


@query("""WITH m AS (SELECT DISTINCT o_custkey AS k, date_trunc('month', o_orderdate)::DATE AS m FROM orders), n AS (SELECT k, min(m) AS since, count(*) AS months FROM m GROUP BY k), o AS (SELECT k, o_clerkish FROM (SELECT o_custkey AS k, min_by(o_orderpriority, (o_orderdate, o_orderkey)) AS o_clerkish FROM orders GROUP BY 1)) SELECT k, since, months, o_clerkish AS first_priority FROM n JOIN o USING (k)""")
def monthly_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of any month, since when, how often, and the first label of each."""
    o = load(spark, sf_dir, "orders")
    m = o.select(F.col("o_custkey").alias("k"), F.trunc("o_orderdate", "month").alias("m")).distinct().groupBy("k").agg(F.min("m").alias("since"), F.count("*").alias("months"))
    first = o.groupBy(F.col("o_custkey").alias("k")).agg(F.min_by("o_orderpriority", F.struct("o_orderdate", "o_orderkey")).alias("first_priority"))
    return m.join(first, "k")


@query("""WITH x AS (SELECT o_custkey AS k, CAST(o_orderdate AS DATE) AS d, o_totalprice AS v, o_orderkey AS id FROM orders), g AS (SELECT k, max(v) AS v FROM x GROUP BY k) SELECT x.k, x.d, x.v FROM x JOIN g USING (k, v) QUALIFY row_number() OVER (PARTITION BY x.k ORDER BY id) = 1 ORDER BY v DESC, k LIMIT 10""")
def largest_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row of each group's largest value; of these the ten largest: a top-k report."""
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.to_date("o_orderdate").alias("d"), F.col("o_totalprice").alias("v"), F.col("o_orderkey").alias("id"))
    best = o.groupBy("k").agg(F.max_by(F.struct("d", "v"), F.struct("v", -F.col("id"))).alias("x")).select("k", "x.*")
    return best.orderBy(F.desc("v"), "k").limit(10)


@query("""WITH a AS (
  SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS d, l_orderkey AS id, l_linenumber AS nr, l_quantity / (1.0::DOUBLE + l_discount) AS q FROM lineitem WHERE l_returnflag = 'R'
), b AS (
  SELECT l_suppkey AS k, CAST(l_shipdate AS DATE) AS od, l_quantity / (1.0::DOUBLE + l_discount) AS oq FROM lineitem WHERE l_returnflag = 'A'
)
SELECT id, nr, k, min(abs(CAST(d - od AS INTEGER))) AS days, count(*) AS n
FROM a JOIN b USING (k) WHERE abs(CAST(d - od AS INTEGER)) <= 10 AND abs(oq - q) / q <= 0.01 GROUP BY id, nr, k""")
def ratio_band(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of one symbol at most ten days and a hundredth of their (broken) quantity apart: the nearest
    day, and how many there are."""
    q = F.col("l_quantity") / (1 + F.col("l_discount"))
    li = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d"), F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("nr"), q.alias("q"), "l_returnflag")
    a, b = (li.where(F.col("l_returnflag") == flag).drop("l_returnflag") for flag in "RA")
    x = temporal.ratio_band(a, b.select("k", "d", "q"), "k", "d", "q", 10, 0.01)
    return x.groupBy("id", "nr", "k").agg(F.min(F.abs(F.datediff("d", "other_d"))).alias("days"), F.count("*").alias("n"))


@query("""WITH s AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE CAST(p_size AS DOUBLE) END AS v, p_brand AS g FROM part), o AS (SELECT k, v, g, CASE WHEN k % 5 = 0 THEN k || '.OF' ELSE CAST(k AS VARCHAR) END AS code FROM s), t AS (SELECT k, CASE WHEN k % 4 = 0 THEN v + 1 ELSE v END AS v, g FROM s)
SELECT o.k, o.code FROM o WHERE NOT (o.code LIKE '%.OF' AND EXISTS (SELECT 1 FROM t WHERE t.k = o.k AND t.g = o.g AND t.v IS NOT DISTINCT FROM o.v))""")
def sibling_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a malformed code go where a sibling of the plain code has the same values, nulls alike."""
    s = load(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.when(F.col("p_partkey") % 6 != 0, F.col("p_size").cast("double")).alias("v"), F.col("p_brand").alias("g"))
    bad = F.col("k") % 5 == 0
    o = s.withColumn("code", F.concat(F.col("k").cast("string"), F.when(bad, ".OF").otherwise("")))
    t = s.withColumn("v", F.when(F.col("k") % 4 == 0, F.col("v") + 1).otherwise(F.col("v")))
    return maintenance.without_siblings(o, t, ["k", "g"], ["v"], F.col("code").endswith(".OF")).select("k", "code")


@query("""WITH x AS (SELECT o_custkey AS k, o_orderkey AS i, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END AS a, o_orderstatus AS s FROM orders)
SELECT k, min_by(a, i) FILTER (a IS NOT NULL) AS first_a, max_by(a, i) FILTER (a IS NOT NULL) AS last_a, min_by(s, i) AS plain FROM x GROUP BY k""")
def merged_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a key: the first or last value that is not null, or the first row's."""
    x = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("i"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("a"), F.col("o_orderstatus").alias("s"))
    first, last = (maintenance.merge_keys(x.select("k", "i", "a"), ["k"], "i", last=end).withColumnRenamed("a", name) for end, name in ((False, "first_a"), (True, "last_a")))
    plain = temporal.latest_by(x, ["k"], [F.col("i")]).select("k", F.col("s").alias("plain"))
    return first.join(last, "k").join(plain, "k")


@query("""WITH o AS (SELECT o_custkey AS k, o_totalprice AS v, o_orderstatus AS s, c_nationkey AS g FROM orders JOIN customer ON c_custkey = o_custkey), a AS (SELECT g, k, min(v) AS v FROM o WHERE s <> 'P' GROUP BY 1, 2), b AS (SELECT g, k, min(v) AS v FROM o WHERE g % 5 <> 3 OR k % 2 = 0 GROUP BY 1, 2)
SELECT g, count(b.k) AS n, count(*) FILTER (a.k IS NULL) AS added, count(*) FILTER (a.v <> b.v) AS changed, count(b.k) >= count(a.k) AS accepted FROM b FULL JOIN a USING (g, k) GROUP BY g""")
def upsert_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that an upsert adds and changes in each group, and whether the guard against fewer rows lets it
    through; some groups are made to lose half of their keys."""
    c = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g"))
    o = load(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k"), F.col("o_totalprice").alias("v"), F.col("o_orderstatus").alias("s")).join(c, "k")
    a = o.where("s <> 'P'").groupBy("g", "k").agg(F.min("v").alias("was"))
    b = o.where("g % 5 <> 3 or k % 2 = 0").groupBy("g", "k").agg(F.min("v").alias("v"))
    x = b.join(a, ["g", "k"], "full")
    new, old = F.count("v"), F.count("was")
    return x.groupBy("g").agg(new.alias("n"), F.count_if(F.col("was").isNull()).alias("added"), F.count_if(F.col("was") != F.col("v")).alias("changed"), (new >= old).alias("accepted"))
