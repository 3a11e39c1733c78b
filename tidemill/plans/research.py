"""Research queries: net value, indices, factors, share flow, regressions and table audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import series
from tidemill.plans.catalogue import BARS, FACTORS, factors, query, rounded
from tidemill.sources.tables import calendar, daily_bars, load
from tidemill.streaming import events

RETURNS = "r AS (SELECT symbol, d, amount, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark, sf_dir).select("symbol", "d", "amount", (F.col("close") / F.lag("close").over(series.by_day()) - 1).alias("r"))


@query("""WITH day AS (SELECT CAST(l_shipdate AS DATE) AS d, sum(l_extendedprice * (1 - l_discount)) AS v FROM lineitem GROUP BY 1), n AS (SELECT d, 1e6 + sum(v - (SELECT avg(v) FROM day)) OVER (ORDER BY d) / 100 AS nav FROM day),
x AS (SELECT d, nav, nav / lag(nav) OVER (ORDER BY d) - 1 AS r, nav / max(nav) OVER (ORDER BY d) - 1 AS dd, count(*) OVER () AS n, first_value(nav) OVER (ORDER BY d) AS nav0 FROM n)
SELECT count(*) AS days, round(max_by(nav, d) / min(nav0) - 1, 4) AS total, round(pow(max_by(nav, d) / min(nav0), 252.0 / (count(*) - 1)) - 1, 4) AS annual, round(stddev_samp(r) * sqrt(252), 4) AS vol, round(min(dd), 4) AS max_drawdown FROM x""")
def nav_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of one net value line; its windows run over a row a day."""
    day = load(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    w = Window.orderBy("d")
    nav = day.crossJoin(day.agg(F.avg("v").alias("mean"))).select("d", (1e6 + F.sum(F.col("v") - F.col("mean")).over(w) / 100).alias("nav"))
    x = nav.select("d", "nav", (F.col("nav") / F.lag("nav").over(w) - 1).alias("r"), (F.col("nav") / F.max("nav").over(w) - 1).alias("dd"))
    growth = F.max_by("nav", "d") / F.min_by("nav", "d")
    out = {"total": growth - 1, "annual": F.pow(growth, 252.0 / (F.count("*") - 1)) - 1, "vol": F.stddev_samp("r") * 252**0.5, "max_drawdown": F.min("dd")}
    return x.agg(F.count("*").alias("days"), *(F.round(v, 4).alias(k) for k, v in out.items()))


@query(f"""WITH {BARS}, x AS (SELECT symbol, d, close / lag(close, 20) OVER (PARTITION BY symbol ORDER BY d) - 1 AS mom FROM bars) SELECT d, symbol, round(mom, 4) AS mom FROM x WHERE mom IS NOT NULL QUALIFY row_number() OVER (PARTITION BY d ORDER BY round(mom, 9) DESC, symbol) <= 5""")
def momentum_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = daily_bars(spark, sf_dir).select("symbol", "d", (F.col("close") / F.lag("close", 20).over(series.by_day()) - 1).alias("mom")).where("mom is not null")
    w = Window.partitionBy("d").orderBy(F.desc(F.round("mom", 9)), "symbol")
    return rounded(x.withColumn("n", F.row_number().over(w)).where("n <= 5").select("d", "symbol", "mom"), "mom")


@query(f"""WITH {BARS}, {RETURNS}, m AS (SELECT symbol, date_trunc('month', d) + INTERVAL 1 MONTH AS month FROM bars GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY date_trunc('month', any_value(d)) ORDER BY round(sum(amount), 2), symbol) <= 20),
day AS (SELECT d, count(*) AS n, avg(r) AS r FROM r JOIN m ON m.symbol = r.symbol AND date_trunc('month', r.d) = m.month WHERE r IS NOT NULL GROUP BY d) SELECT d, n, round(r, 6) AS r, round(sum(ln(1 + r)) OVER (ORDER BY d), 6) AS log_level FROM day""")
def micro_index_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal weights of the 20 symbols of least turnover in the month before; daily return and log of the chained level."""
    r = returns(spark, sf_dir)
    month = F.trunc("d", "month")
    sums = r.groupBy("symbol", month.alias("m")).agg(F.round(F.sum("amount"), 2).alias("amount"))
    least = sums.withColumn("n", F.row_number().over(Window.partitionBy("m").orderBy("amount", "symbol"))).where("n <= 20")
    members = least.select("symbol", F.add_months("m", 1).alias("m"))
    day = r.where("r is not null").withColumn("m", month).join(members, ["symbol", "m"]).groupBy("d").agg(F.count("*").alias("n"), F.avg("r").alias("r"))
    level = F.sum(F.log1p("r")).over(Window.orderBy("d"))  # a row a day
    return day.select("d", "n", F.round("r", 6).alias("r"), F.round(level, 6).alias("log_level"))


@query(f"""WITH {BARS}, {FACTORS}, x AS (SELECT symbol, d, factor, lag(factor) OVER (PARTITION BY symbol ORDER BY d) AS was FROM factors) SELECT symbol, d, round(factor / was - 1, 6) AS chg, factor < was - greatest(1e-3, 1e-4 * was) AS falls FROM x WHERE abs(factor / was - 1) > 0.001""")
def factor_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = factors(daily_bars(spark, sf_dir)).withColumn("was", F.lag("factor").over(series.by_day()))
    chg = F.col("factor") / F.col("was") - 1
    return x.where(F.abs(chg) > 0.001).select("symbol", "d", F.round(chg, 6).alias("chg"), (F.col("factor") < F.col("was") - F.greatest(F.lit(1e-3), 1e-4 * F.col("was"))).alias("falls"))


@query(f"""WITH {BARS}, x AS (SELECT symbol, d, vol - lag(vol) OVER w AS step, lag(close) OVER w AS price FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)) SELECT symbol, d, round(step * price, 0) AS flow FROM x WHERE price IS NOT NULL""")
def share_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change of shares times the price before, in whole units."""
    w = series.by_day()
    flow = (F.col("vol") - F.lag("vol").over(w)) * F.lag("close").over(w)
    return daily_bars(spark, sf_dir).select("symbol", "d", F.round(flow, 0).alias("flow")).where("flow is not null")


@query(f"""WITH {BARS}, {RETURNS}, m AS (SELECT d, avg(r) AS b FROM r GROUP BY d) SELECT symbol, count(*) AS n, round(regr_slope(r, b), 4) AS slope, round(regr_intercept(r, b), 4) AS intercept, round(regr_r2(r, b), 4) AS r2 FROM r JOIN m USING (d) WHERE r IS NOT NULL GROUP BY symbol""")
def ols_market(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = returns(spark, sf_dir).where("r is not null")
    x = r.join(r.groupBy("d").agg(F.avg("r").alias("b")), "d")
    return x.groupBy("symbol").agg(F.count("*").alias("n"), F.round(F.regr_slope("r", "b"), 4).alias("slope"), F.round(F.regr_intercept("r", "b"), 4).alias("intercept"), F.round(F.regr_r2("r", "b"), 4).alias("r2"))


@query(f"""WITH {BARS}, {RETURNS} SELECT symbol, count(r) AS n, round(quantile_disc(r, 0.05), 4) AS p05, round(quantile_disc(r, 0.5), 4) AS p50, round(quantile_disc(r, 0.95), 4) AS p95, round(avg(r), 4) AS mean, round(min(r), 4) AS least, round(max(r), 4) AS most, round(stddev_samp(r), 4) AS std FROM r WHERE r IS NOT NULL GROUP BY symbol""")
def dist_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = {f"p{int(100 * q):02d}": F.expr(f"percentile_disc({q}) within group (order by r)") for q in (0.05, 0.5, 0.95)}
    rest = {"mean": F.avg("r"), "least": F.min("r"), "most": F.max("r"), "std": F.stddev_samp("r")}
    return returns(spark, sf_dir).where("r is not null").groupBy("symbol").agg(F.count("*").alias("n"), *(F.round(v, 4).alias(k) for k, v in (at | rest).items()))


@query("""WITH s AS (SELECT l_returnflag AS shard, quantile_cont(l_extendedprice, 0.001) AS lo, quantile_cont(l_extendedprice, 0.999) AS hi FROM lineitem GROUP BY 1), e AS (SELECT min(lo) AS lo, max(hi) AS hi FROM s)
SELECT l_suppkey AS symbol, count(*) AS n, CAST(sum(CASE WHEN l_extendedprice < e.lo OR l_extendedprice > e.hi THEN 1 ELSE 0 END) AS BIGINT) AS outside FROM lineitem, e GROUP BY 1""")
def scale_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows outside of the widest 0.1 to 99.9 percent range of any shard; the range is one row."""
    li = load(spark, sf_dir, "lineitem")
    ends = li.groupBy("l_returnflag").agg(F.percentile("l_extendedprice", F.array(F.lit(0.001), F.lit(0.999))).alias("p"))
    one = ends.agg(F.min(F.get("p", 0)).alias("lo"), F.max(F.get("p", 1)).alias("hi"))
    outside = ~F.col("l_extendedprice").between(F.col("lo"), F.col("hi"))
    return li.select(F.col("l_suppkey").alias("symbol"), "l_extendedprice").crossJoin(F.broadcast(one)).groupBy("symbol").agg(F.count("*").alias("n"), F.sum(outside.cast("long")).alias("outside"))


@query("SELECT CAST(l_shipdate AS DATE) AS d, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) % 5 = 0 AND count(*) >= 5")
def truncation_suspects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose row count is a multiple of a page size."""
    return load(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("d")).agg(F.count("*").alias("n")).where("n % 5 = 0 and n >= 5")


@query("""WITH c AS (SELECT max(CAST(o_orderdate AS DATE)) AS today FROM orders) SELECT l_suppkey AS symbol, max(CAST(l_shipdate AS DATE)) AS last, CAST(any_value(today) - max(CAST(l_shipdate AS DATE)) AS INTEGER) AS behind FROM lineitem, c GROUP BY 1""")
def freshness(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = load(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("symbol")).agg(F.max(F.to_date("l_shipdate")).alias("last"))
    today = calendar(spark, sf_dir).agg(F.max("d").alias("today"))  # one row
    return last.crossJoin(F.broadcast(today)).select("symbol", "last", F.datediff("today", "last").alias("behind"))


@query("SELECT CAST(ts AS DATE) AS d, event_type AS symbol, count(*) AS vol, round(sum(value), 4) AS amount, round(max(value), 4) AS high, round(min(value), 4) AS low FROM events GROUP BY 1, 2")
def stream_daybars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(events.day_bars(spark, f"{sf_dir}/events.parquet"), "amount", "high", "low")


@query("SELECT CAST(ts AS DATE) AS d, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct users of a day: the stream keeps one event of each user and day."""
    rows = events.deduped(spark, f"{sf_dir}/events.parquet", ["user_id", "ts"])
    return rows.groupBy(F.to_date("ts").alias("d")).agg(F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, max_by(event_type, (ts, event_id)) AS last_type, round(max_by(value, (ts, event_id)), 4) AS last_value, count(*) AS n FROM events GROUP BY user_id")
def stream_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's last event, kept up by a stream."""
    return rounded(events.latest_states(spark, f"{sf_dir}/events.parquet", "user_id"), "last_value")
