"""Pools of funds and batches of a rotation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.operators import funds, series, temporal
from tidemill.plans.catalogue import BARS, query
from tidemill.sources.tables import daily_bars, load

#: Made funds, one a part: their kinds, names and benchmarks by number; their values are the bars of a symbol.
FUNDS = f"""{BARS}, funds AS (
  SELECT CASE CAST(p_partkey % 5 AS INTEGER) WHEN 0 THEN '15' WHEN 1 THEN '51' ELSE '00' END || lpad(CAST(p_partkey AS VARCHAR), 5, '0') || '.OF' AS code,
         CASE CAST(p_partkey % 13 AS INTEGER) WHEN 0 THEN '中证' WHEN 1 THEN '全球' WHEN 2 THEN '分级' WHEN 3 THEN 'QDII' WHEN 4 THEN 'ETF' ELSE '成长' END || CAST(p_partkey // 4 AS VARCHAR)
           || CASE CAST(p_partkey % 4 AS INTEGER) WHEN 0 THEN 'A' WHEN 1 THEN '-C' WHEN 2 THEN '(旧)' ELSE '' END AS name,
         CASE CAST(p_partkey % 7 AS INTEGER) WHEN 0 THEN '债券型' WHEN 1 THEN '混合型' ELSE '股票型' END AS fund_type, CASE WHEN p_partkey % 11 = 0 THEN '被动指数型' ELSE '成长型' END AS invest_type,
         CAST(p_partkey // 40 AS VARCHAR) AS management, 1 + p_partkey % (SELECT count(*) FROM supplier) AS symbol, p_partkey % 17 <> 0 AS has_any,
         CASE CAST(p_partkey % 6 AS INTEGER) WHEN 0 THEN '沪深300指数*95.5%+存款*4.5%' WHEN 1 THEN '中债 100 %' WHEN 2 THEN '收益率' WHEN 3 THEN 'x*120%＋y*30%' WHEN 4 THEN NULL ELSE 'a*60%+b*40%' END AS benchmark
  FROM part
), navs AS (
  SELECT symbol, d, CASE WHEN symbol % 3 = 0 THEN NULL ELSE vol * 1e7 END AS net_asset, CASE WHEN symbol % 4 > 0 THEN avg(close) OVER w END AS adj_nav,
         CASE WHEN symbol % 5 = 0 THEN 1000 + avg(close) OVER w / 1000 ELSE close END AS unit_nav
  FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d ROWS 19 PRECEDING)
), counts AS (
  SELECT symbol, count(*) AS n_rows, max_by(net_asset, d) FILTER (net_asset IS NOT NULL) / 1e8 AS size, count(adj_nav) AS adj FROM navs GROUP BY symbol
), v AS (
  SELECT symbol, d, v, count(*) OVER (PARTITION BY symbol) AS n, min(d) OVER (PARTITION BY symbol) AS first
  FROM (SELECT n.symbol, d, CASE WHEN adj > 20 THEN adj_nav ELSE unit_nav END AS v FROM navs n JOIN counts USING (symbol)) WHERE v > 0
), r AS (
  SELECT symbol, v / lag(v) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM v WHERE n >= 120 AND d - first >= 90
), vols AS (
  SELECT symbol, CASE WHEN count(*) >= 100 THEN stddev_samp(r) * sqrt(245) END AS vol FROM r WHERE abs(r) < 0.25 GROUP BY symbol
), w AS (
  SELECT f.*, c.n_rows, c.size, vol, list_filter(list_transform(string_split_regex(coalesce(benchmark, ''), '[+＋]'), lambda p: TRY_CAST(regexp_extract(p, '([0-9]+(\\.[0-9]+)?)\\s*%', 1) AS DOUBLE)), lambda x: x IS NOT NULL AND x <= 100) AS ws,
         management || '|' || trim(regexp_replace(regexp_replace(name, '\\(.*?\\)', '', 'g'), '[-–—]?([A-Z]{{1,2}})$', '')) AS key
  FROM funds f LEFT JOIN counts c USING (symbol) LEFT JOIN vols USING (symbol)
), p AS (
  SELECT *, CASE WHEN fund_type NOT IN ('股票型', '混合型') THEN 0
    WHEN invest_type IN ('被动指数型', '增强指数型') OR regexp_matches(name, '联接|ETF|指数|LOF|MSCI|中证|国证|沪深|恒生|标普|纳指') OR coalesce(len(ws) = 1 AND list_max(ws) / list_sum(ws) >= 0.99, FALSE) THEN 1
    WHEN regexp_matches(code, '^(15|16|167|150)[0-9]') AND contains(name, '分级') THEN 2 WHEN regexp_matches(name, 'FOF|QDII|美元|纳斯达克|标普|全球|海外') THEN 3
    WHEN NOT has_any THEN 4 WHEN size < 2 THEN 5 WHEN vol < 0.08 THEN 6 ELSE 7 END AS reached FROM w
), pool AS (
  SELECT code, CASE WHEN reached < 7 OR code <> min(code) FILTER (reached = 7) OVER (PARTITION BY key) THEN reached WHEN n_rows >= 250 THEN 9 ELSE 8 END AS passed FROM p
)"""


def made_funds(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")

    def choice(by: int, *values, other):
        out = F.lit(other)
        for i, v in reversed(list(enumerate(values))):
            out = F.when(k % by == i, v).otherwise(out)
        return out

    suppliers = load(spark, sf_dir, "supplier").agg(F.count("*").alias("_n"))  # one row
    code = F.concat(choice(5, "15", "51", other="00"), F.lpad(k.cast("string"), 5, "0"), F.lit(".OF"))
    name = F.concat(choice(13, "中证", "全球", "分级", "QDII", "ETF", other="成长"), F.expr("cast(p_partkey div 4 as string)"), choice(4, "A", "-C", "(旧)", other=""))
    p = load(spark, sf_dir, "part").crossJoin(F.broadcast(suppliers))
    f = p.select(
        code.alias("code"), name.alias("name"), choice(7, "债券型", "混合型", other="股票型").alias("fund_type"), choice(11, "被动指数型", other="成长型").alias("invest_type"),
        F.expr("cast(p_partkey div 40 as string)").alias("management"), (1 + k % F.col("_n")).alias("symbol"), (k % 17 != 0).alias("has_any"),
        choice(6, "沪深300指数*95.5%+存款*4.5%", "中债 100 %", "收益率", "x*120%＋y*30%", None, other="a*60%+b*40%").alias("benchmark"),
    )
    mean, s = F.avg("close").over(series.rows_back(19)), F.col("symbol")
    navs = daily_bars(spark, sf_dir).select(
        s.alias("code"), "d", F.when(s % 3 != 0, F.col("vol") * 1e7).alias("net_asset"), F.when(s % 4 > 0, mean).alias("adj_nav"), F.when(s % 5 == 0, 1000 + mean / 1000).otherwise(F.col("close")).alias("unit_nav")
    )
    return f.join(funds.nav_statistics(navs).withColumnRenamed("code", "symbol"), "symbol", "left")


@query(f"WITH {FUNDS} SELECT code, passed FROM pool")
def fund_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far each fund comes through the ten ordered filters."""
    return funds.funnel(made_funds(spark, sf_dir)).select("code", "passed")


@query(f"WITH {FUNDS}, s AS (SELECT unnest({list(range(10))}) AS number, unnest({list(funds.STEPS)}) AS step) SELECT number, step, count(*) FILTER (passed >= number) AS n FROM pool, s GROUP BY number, step")
def fund_pool_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter of the pool leaves, in one pass."""
    return funds.funnel_counts(funds.funnel(made_funds(spark, sf_dir)))


@query("""WITH t AS (SELECT o_custkey AS k, max(CAST(o_orderdate AS DATE)) AS last FROM orders GROUP BY 1), n AS (SELECT c_custkey AS k, c_nationkey AS g, last FROM customer LEFT JOIN t ON k = c_custkey),
x AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY last NULLS FIRST, k) AS i, count(*) OVER (PARTITION BY g) AS n FROM n) SELECT g, k, last FROM x WHERE i <= ceil(n / 7.0)""")
def rotation_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next batch of each group when all are to be renewed within seven days: those seen longest ago, or
    never, a seventh rounded up."""
    last = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max(F.to_date("o_orderdate")).alias("last"))
    n = load(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").alias("g")).join(last, "k", "left")
    sized = n.join(n.groupBy("g").agg(F.ceil(F.count("*") / 7).alias("most")), "g")
    return temporal.first_rows(sized, ["g"], [F.col("last").asc_nulls_first(), F.col("k")], F.col("most")).select("g", "k", "last")


@query("""WITH a AS (SELECT l_suppkey AS k, l_shipdate AS d, l_orderkey AS id, l_linenumber AS nr, l_quantity AS v FROM lineitem WHERE l_returnflag = 'R' QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC, id DESC, nr DESC) = 1),
b AS (SELECT l_suppkey AS k, l_shipdate AS d, l_orderkey AS id, l_linenumber AS nr, l_quantity AS v FROM lineitem WHERE l_returnflag = 'A' QUALIFY row_number() OVER (PARTITION BY k ORDER BY d DESC, id DESC, nr DESC) = 1)
SELECT k, CAST(a.d AS DATE) AS d_left, CAST(b.d AS DATE) AS d_right, CAST(a.v AS DOUBLE) AS v_left, CAST(b.v AS DOUBLE) AS v_right FROM a FULL JOIN b USING (k)""")
def latest_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest row of each symbol in two tables side by side, told apart by suffixes."""
    li = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.to_date("l_shipdate").alias("d"), F.col("l_quantity").cast("double").alias("v"), F.struct("l_shipdate", "l_orderkey", "l_linenumber").alias("at"), "l_returnflag")
    latest = lambda flag, end: li.where(F.col("l_returnflag") == flag).groupBy("k").agg(F.max_by("d", "at").alias(f"d_{end}"), F.max_by("v", "at").alias(f"v_{end}"))
    return latest("R", "left").join(latest("A", "right"), "k", "full")
