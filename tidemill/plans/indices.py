"""Custom indices of small names and the incremental table of limit states, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions import classify
from tidemill.operators import index, maintenance
from tidemill.plans.catalogue import query, rounded
from tidemill.plans.quality import MARKET, market
from tidemill.sources.tables import load
from tidemill.streaming.events import shared_folder

#: Parts as names, months as days and years as months: the only panel in which some hundred names trade on
#: each day. Names within their first 8 months are left out, returns are cut at a fifth.
NAMES = """months AS (
  SELECT l_partkey AS symbol, CAST(date_trunc('month', l_shipdate) AS DATE) AS d, sum(l_extendedprice) / sum(l_quantity) AS price,
         CAST(sum(l_quantity) AS BIGINT) AS size
  FROM lineitem GROUP BY 1, 2
), rows AS (
  SELECT symbol, d, CAST(year(d) AS INTEGER) AS y, size, greatest(-0.2, least(0.2, price / lag(price) OVER w - 1)) AS ret, min(d) OVER (PARTITION BY symbol) AS listed
  FROM months WINDOW w AS (PARTITION BY symbol ORDER BY d)
), names AS (
  SELECT symbol, d, y, size, ret FROM rows WHERE ret IS NOT NULL AND date_diff('day', listed, d) >= 250
), days AS (
  SELECT d, any_value(y) AS y, row_number() OVER (ORDER BY d) AS i FROM names GROUP BY d HAVING count(*) >= 500
), counted AS (
  SELECT n.*, i FROM names n JOIN days USING (d)
), members AS (
  SELECT symbol, i AS base, y FROM counted QUALIFY row_number() OVER (PARTITION BY d ORDER BY size, symbol) <= 400
)"""


def small_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    month = F.trunc("l_shipdate", "month")
    m = load(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("symbol"), month.alias("d")).agg((F.sum("l_extendedprice") / F.sum("l_quantity")).alias("price"), F.sum("l_quantity").cast("long").alias("size"))
    w = Window.partitionBy("symbol").orderBy("d")
    ret = F.greatest(F.lit(-0.2), F.least(F.lit(0.2), F.col("price") / F.lag("price").over(w) - 1))
    x = m.select("symbol", "d", F.year("d").alias("y"), "size", ret.alias("ret"), F.min("d").over(Window.partitionBy("symbol")).alias("listed"))
    return x.where("ret is not null and datediff(d, listed) >= 250").drop("listed")


@query(f"""WITH {NAMES}, x AS (
  SELECT c.d, count(*) AS n, avg(c.ret) AS ret FROM counted c JOIN members m ON m.symbol = c.symbol AND m.base = c.i - 1 GROUP BY c.d HAVING count(*) >= 100
)
SELECT d, n, round(ret, 6) AS ret, round(sum(ln(1 + ret)) OVER (ORDER BY d), 6) AS log_nav FROM x""")
def micro_index_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights of the 400 smallest names of the day before."""
    x = index.carried_index(small_names(spark, sf_dir))
    return rounded(x.select("d", "n", "ret", F.log("nav").alias("log_nav")), "ret", "log_nav", digits=6)


@query(f"""WITH RECURSIVE {NAMES}, pairs AS (
  SELECT base, c.i, count(*) AS n, avg(c.ret) AS ret FROM counted c JOIN members m ON m.symbol = c.symbol AND m.y = c.y AND c.i > m.base GROUP BY 1, 2
), walk AS (
  SELECT i, i AS base, CAST(NULL AS BIGINT) AS n, CAST(NULL AS DOUBLE) AS ret FROM days WHERE i = 1
  UNION ALL
  SELECT t.i, CASE WHEN t.y <> w.y OR coalesce(p.n, 0) < 115 THEN t.i ELSE walk.base END, CASE WHEN t.y = w.y AND p.n >= 115 THEN p.n END, CASE WHEN t.y = w.y AND p.n >= 115 THEN p.ret END
  FROM walk JOIN days t ON t.i = walk.i + 1 JOIN days w ON w.i = walk.i LEFT JOIN pairs p ON p.base = walk.base AND p.i = t.i
)
SELECT d, n, round(ret, 6) AS ret, round(sum(ln(1 + ret)) OVER (ORDER BY d), 6) AS log_nav FROM walk JOIN days USING (i) WHERE n IS NOT NULL""")
def micro_index_held(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same names held until the next year, or until fewer than 115 of them trade; no return on a day
    of choice. (115 instead of the usual 100, so that these tables meet the rule.)"""
    x = index.carried_index(small_names(spark, sf_dir), survivors=115, period="y")
    return rounded(x.select("d", "n", "ret", F.log("nav").alias("log_nav")), "ret", "log_nav", digits=6)


FIRST_RUN = "d < DATE '1997-06-15' AND day(d) <> 9"


def limit_states(rows: DataFrame) -> DataFrame:
    """d, symbol, is_limit_down_close, board."""
    board = classify.board(F.col("code"))
    pct = classify.limit_pct(board, F.col("st"), F.col("d"))
    limit = F.round((F.col("pre") * (1 - pct)).cast("decimal(20,8)"), 2)
    return rows.where("pre is not null").select("d", "symbol", (F.col("close").cast("decimal(20,8)") <= limit).alias("is_limit_down_close"), board.alias("board"))


@query(f"""WITH {MARKET}, p AS (
  SELECT *, CASE WHEN regexp_matches(code, '^(300|301|302)') THEN 'gem' WHEN regexp_matches(code, '^(688|689)') THEN 'star' WHEN regexp_matches(code, '^(4|8|920)') THEN 'bse' ELSE 'main' END AS board
  FROM mk WHERE pre IS NOT NULL
), l AS (
  SELECT *, CASE board WHEN 'bse' THEN 0.30 WHEN 'main' THEN CASE WHEN st THEN 0.05 ELSE 0.10 END ELSE 0.20 END AS pct FROM p
)
SELECT d, symbol, CAST(close AS DECIMAL(20, 8)) <= round(CAST(pre * (1 - pct) AS DECIMAL(20, 8)), 2) AS is_limit_down_close, board, CASE WHEN {FIRST_RUN} THEN 1 ELSE 2 END AS run FROM l""")
def limit_state_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of limit states kept up in two runs: the first lacks all days from 1997-06-15 on and each
    ninth of a month before; the second works out those days alone. `run` tells which one wrote a row."""
    base = shared_folder(spark)
    path = f"{base}/states"
    market(spark, sf_dir).select("d", "symbol", "code", "st", "pre", "close").write.parquet(f"{base}/market")  # read by each step of each run
    rows = spark.read.parquet(f"{base}/market")
    days = rows.where("pre is not null").select("d").distinct()
    for run, asked in ((1, days.where("d < date '1997-06-15' and day(d) <> 9")), (2, days)):
        compute = lambda missing, run=run: limit_states(rows.join(F.broadcast(missing), "d", "left_semi")).withColumn("run", F.lit(run))
        maintenance.fill_days(spark, path, asked, compute, F.trunc("d", "year"))
    return spark.read.parquet(path).select("d", "symbol", "is_limit_down_close", "board", "run")
