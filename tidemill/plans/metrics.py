"""Performance metrics, grids and walk-forward folds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.operators import series
from tidemill.plans.catalogue import BARS, query, rounded
from tidemill.sources.tables import calendar, daily_bars, load

RET = "r AS (SELECT symbol, d, close, close / lag(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS r FROM bars)"


def returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily_bars(spark, sf_dir).select("symbol", "d", "close", (F.col("close") / F.lag("close").over(series.by_day()) - 1).alias("r"))


@query(f"""WITH {BARS}, x AS (SELECT symbol, d, close AS nav, CASE WHEN lag(close) OVER w IS NULL OR lag(close) OVER w = 0 THEN 0 ELSE close / lag(close) OVER w - 1 END AS r, close / first_value(close) OVER w - 1 AS cum, close / greatest(max(close) OVER w, 0) - 1 AS dd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d))
SELECT symbol, d, round(r, 6) AS r, round(cum, 6) AS cum, round(dd, 6) AS dd FROM x""")
def nav_four(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily return (0 on the first day), cumulated return and drawdown of a net value line."""
    w = series.by_day()
    was = F.lag("close").over(w)
    r = F.when(was.isNull() | (was == 0), 0.0).otherwise(F.col("close") / was - 1)
    x = daily_bars(spark, sf_dir).select("symbol", "d", r.alias("r"), (F.col("close") / F.first("close").over(w) - 1).alias("cum"), (F.col("close") / F.greatest(F.max("close").over(w), F.lit(0.0)) - 1).alias("dd"))
    return rounded(x, "r", "cum", "dd", digits=6)


#: Stored snapshots of a net value whose fields are made to drift on some days.
SNAPSHOTS = """x AS (
  SELECT symbol, d, close, CAST(vol AS BIGINT) AS v, row_number() OVER w AS i, coalesce(close / nullif(lag(close) OVER w, 0) - 1, 0) AS r,
         close / first_value(close) OVER w - 1 AS cum, close / max(close) OVER w - 1 AS dd FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY d)
)"""
DRIFTS = {"total_value": "v % 61 = 0", "daily_return": "v % 67 = 1", "cumulative_return": "v % 71 = 2", "drawdown": "v % 73 = 3"}


@query(f"""WITH {BARS}, {SNAPSHOTS}, f AS ({' UNION ALL '.join(f"SELECT symbol, d, '{k}' AS field FROM x WHERE {c}" for k, c in DRIFTS.items())})
SELECT symbol, field, count(*) AS off, min(d) AS first_off FROM f GROUP BY symbol, field""")
def nav_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored value, return, cumulated return and drawdown of each snapshot against those worked out anew from
    cash and holdings: the fields and days that part by over 1e-9. The SQL counts the days that were made to."""
    w = series.by_day()
    cash = F.col("close") * 0.25
    made = daily_bars(spark, sf_dir).select("symbol", "d", "close", F.col("vol").cast("long").alias("v"), cash.alias("cash"), (F.col("close") - cash).alias("held"))
    was = F.lag("close").over(w)
    right = {"total_value": F.col("close"), "daily_return": F.coalesce(F.col("close") / F.nullif(was, F.lit(0.0)) - 1, F.lit(0.0)), "cumulative_return": F.col("close") / F.first("close").over(w) - 1, "drawdown": F.col("close") / F.max("close").over(w) - 1}
    stored = made.withColumns({k: right[k] + F.when(F.expr(c), 1e-6).otherwise(0.0) for k, c in DRIFTS.items()})
    total = F.col("cash") + F.col("held")
    anew = stored.withColumn("_total", total).withColumns({
        "_daily_return": F.coalesce(F.col("_total") / F.nullif(F.lag("_total").over(w), F.lit(0.0)) - 1, F.lit(0.0)),
        "_cumulative_return": F.col("_total") / F.first("_total").over(w) - 1, "_drawdown": F.col("_total") / F.greatest(F.max("_total").over(w), F.lit(0.0)) - 1, "_total_value": F.col("_total"),
    })
    fields = F.array_compact(F.array(*(F.when(F.abs(F.col(k) - F.col(f"_{k}")) > 1e-9, F.lit(k)) for k in DRIFTS)))
    return anew.select("symbol", "d", F.explode(fields).alias("field")).groupBy("symbol", "field").agg(F.count("*").alias("off"), F.min("d").alias("first_off"))


@query(f"""WITH {BARS}, {RET}, x AS (SELECT symbol, d, close, r, close / max(close) OVER (PARTITION BY symbol ORDER BY d) - 1 AS dd FROM r), a AS (SELECT symbol, count(*) AS n, max_by(close, d) / min_by(close, d) - 1 AS total, min(dd) AS dd, stddev_samp(r) AS sd FROM x GROUP BY symbol)
SELECT symbol, CASE WHEN n > 500 THEN round(pow(1 + total, 252.0 / (n - 1)) - 1, 4) END AS annual, CASE WHEN n > 500 AND dd < 0 THEN round((pow(1 + total, 252.0 / (n - 1)) - 1) / abs(dd), 4) END AS calmar, round(total, 4) AS total FROM a""")
def calmar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Growth a year against the largest drawdown; null on a short sample, the rest still given."""
    x = returns(spark, sf_dir).withColumn("dd", series.drawdown("close"))
    a = x.groupBy("symbol").agg(F.count("*").alias("n"), (F.max_by("close", "d") / F.min_by("close", "d") - 1).alias("total"), F.min("dd").alias("dd"))
    annual = F.when(F.col("n") > 500, F.pow(1 + F.col("total"), 252.0 / (F.col("n") - 1)) - 1)
    return a.select("symbol", F.round(annual, 4).alias("annual"), F.round(F.when(F.col("dd") < 0, annual / F.abs("dd")), 4).alias("calmar"), F.round("total", 4).alias("total"))


@query(f"""WITH {BARS}, {RET}, x AS (SELECT symbol, r, symbol % 4 <> 0 AND (CAST(month(d) AS INTEGER) + symbol) % 3 <> 0 AS held FROM r WHERE r IS NOT NULL), y AS (SELECT *, bool_or(held) OVER (PARTITION BY symbol) AS ever FROM x)
SELECT symbol, round(avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) FILTER (held OR NOT ever), 4) AS win_rate, count(*) FILTER (held OR NOT ever) AS days FROM y GROUP BY symbol""")
def in_market_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of rising days among those with holdings; among all where nothing is ever held."""
    held = (F.col("symbol") % 4 != 0) & ((F.month("d") + F.col("symbol")) % 3 != 0)
    y = returns(spark, sf_dir).where("r is not null").withColumn("held", held).withColumn("some", F.max("held").over(Window.partitionBy("symbol")))
    y = y.where("held or not some")
    return y.groupBy("symbol").agg(F.round(F.avg((F.col("r") > 0).cast("double")), 4).alias("win_rate"), F.count("*").alias("days"))


@query(f"""WITH {BARS}, {RET}, m AS (SELECT d, avg(r) AS b FROM r WHERE r IS NOT NULL GROUP BY d), a AS (SELECT symbol, count(*) AS n, avg(r) AS mr, avg(b) AS mb, covar_samp(r, b) / var_samp(b) AS beta FROM r JOIN m USING (d) WHERE r IS NOT NULL GROUP BY symbol)
SELECT symbol, n, round((mr - beta * mb) * 252, 4) AS alpha, round(pow(1 + mr - mb, 252) - 1, 4) AS excess_year FROM a WHERE n >= 3""")
def excess_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alpha and the yearly excess over the mean of all symbols, from three days on."""
    r = returns(spark, sf_dir).where("r is not null")
    x = r.join(r.groupBy("d").agg(F.avg("r").alias("b")), "d").groupBy("symbol").agg(F.count("*").alias("n"), F.avg("r").alias("mr"), F.avg("b").alias("mb"), (F.covar_samp("r", "b") / F.var_samp("b")).alias("beta"))
    return x.where("n >= 3").select("symbol", "n", F.round(F.expr("(mr - beta * mb) * 252"), 4).alias("alpha"), F.round(F.expr("pow(1 + mr - mb, 252) - 1"), 4).alias("excess_year"))


CRISES = [("first", "1996-03-01", "1996-09-30"), ("second", "1998-07-01", "1998-12-31"), ("wide", "1996-08-01", "1998-09-15"), ("later", "2015-06-01", "2015-09-30")]


@query(f"""WITH {BARS}, {RET}, c(name, a, e) AS (VALUES {', '.join(f"('{n}', DATE '{a}', DATE '{e}')" for n, a, e in CRISES)}) SELECT symbol, name, count(*) AS days, round(exp(sum(ln(1 + r))) - 1, 4) AS ret FROM r JOIN c ON d BETWEEN a AND e WHERE r IS NOT NULL GROUP BY 1, 2""")
def crisis_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns inside of named spans, of which a day may be in several; a span without days has no row."""
    inside = F.array_compact(F.array(*(F.when(F.col("d").between(F.lit(a).cast("date"), F.lit(e).cast("date")), n) for n, a, e in CRISES)))
    x = returns(spark, sf_dir).where("r is not null").withColumn("name", F.explode(inside))
    return x.groupBy("symbol", "name").agg(F.count("*").alias("days"), F.round(F.exp(F.sum(F.log1p("r"))) - 1, 4).alias("ret"))


@query(f"""WITH {BARS}, g AS (SELECT f, s FROM (SELECT unnest([3, 5, 10]) AS f), (SELECT unnest([10, 20, 40]) AS s) WHERE f < s), x AS (SELECT f, s, symbol, d, close / lag(close) OVER w - 1 AS r, CASE f WHEN 3 THEN avg(close) OVER (w ROWS 2 PRECEDING) WHEN 5 THEN avg(close) OVER (w ROWS 4 PRECEDING) ELSE avg(close) OVER (w ROWS 9 PRECEDING) END AS fast,
CASE s WHEN 10 THEN avg(close) OVER (w ROWS 9 PRECEDING) WHEN 20 THEN avg(close) OVER (w ROWS 19 PRECEDING) ELSE avg(close) OVER (w ROWS 39 PRECEDING) END AS slow FROM bars, g WINDOW w AS (PARTITION BY f, s, symbol ORDER BY d)), y AS (SELECT f, s, r, lag(round(fast, 9) > round(slow, 9)) OVER (PARTITION BY f, s, symbol ORDER BY d) AS held FROM x),
o AS (SELECT f, s, round(avg(r) / stddev_samp(r), 4) AS score, count(*) AS days FROM y WHERE held GROUP BY f, s) SELECT f, s, score, days, row_number() OVER (ORDER BY score DESC NULLS LAST, f, s) AS place FROM o""")
def grid_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A grid of two window lengths, each run on all symbols, ranked by the score of days held. Bars are
    read once: the grid's means are columns, the runs an array of them."""
    w, b = series.by_day(), daily_bars(spark, sf_dir)
    mean = lambda n: F.round(F.avg("close").over(series.rows_back(n - 1)), 9)
    x = b.select("symbol", "d", (F.col("close") / F.lag("close").over(w) - 1).alias("r"), *(mean(n).alias(f"m{n}") for n in (3, 5, 10, 20, 40)))
    grid = [(f, s) for f in (3, 5, 10) for s in (10, 20, 40) if f < s]
    held = x.select("r", *(F.lag(F.col(f"m{f}") > F.col(f"m{s}")).over(w).alias(f"h{f}_{s}") for f, s in grid))
    runs = F.array(*(F.struct(F.lit(f).alias("f"), F.lit(s).alias("s"), F.col(f"h{f}_{s}").alias("held")) for f, s in grid))
    o = held.select("r", F.explode(runs).alias("g")).where("g.held").groupBy("g.f", "g.s").agg(F.round(F.avg("r") / F.stddev_samp("r"), 4).alias("score"), F.count("*").alias("days"))
    place = F.row_number().over(Window.orderBy(F.desc_nulls_last("score"), "f", "s"))  # a row a grid point
    return o.withColumn("place", place.cast("long"))


@query("""WITH c AS (SELECT count(DISTINCT CAST(o_orderdate AS DATE)) AS n FROM orders), k AS (SELECT unnest(generate_series(0, 200)) AS i), f AS (SELECT i, n, 250 + 80 * i AS cut FROM k, c WHERE 250 + 80 * i + 5 + 60 <= n)
SELECT CAST(i AS BIGINT) AS fold, kind, CASE kind WHEN 'rolling' THEN cut - 250 ELSE 0 END AS train_from, cut - 10 AS train_to, cut + 5 AS test_from, cut + 65 AS test_to FROM f, (VALUES ('rolling'), ('anchored')) v(kind)""")
def folds_purged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling and anchored folds; ten days before the cut are purged, five after it are left out."""
    n = calendar(spark, sf_dir).agg(F.count("*").alias("n"))
    fold = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 315) / 80)))
    f = n.where("n >= 315").select(fold.alias("fold")).withColumn("cut", 250 + 80 * F.col("fold"))
    kinds = f.select("fold", "cut", F.explode(F.array(F.lit("rolling"), F.lit("anchored"))).alias("kind"))
    start = F.when(F.col("kind") == "rolling", F.col("cut") - 250).otherwise(F.lit(0).cast("long"))
    return kinds.select("fold", "kind", start.alias("train_from"), (F.col("cut") - 10).alias("train_to"), (F.col("cut") + 5).alias("test_from"), (F.col("cut") + 65).alias("test_to"))


@query(f"""WITH {BARS}, {RET}, p AS (SELECT symbol, r, row_number() OVER (PARTITION BY symbol ORDER BY d) - 1 AS i FROM r), o AS (SELECT symbol, (i - 310) // 60 AS fold, exp(sum(ln(1 + r))) - 1 AS ret FROM p WHERE i >= 310 AND r IS NOT NULL GROUP BY 1, 2)
SELECT fold, count(*) AS n, round(avg(ret), 4) AS mean, round(median(ret), 4) AS mid, round(min(ret), 4) AS least, round(max(ret), 4) AS most, round(stddev_samp(ret), 4) AS sd FROM o GROUP BY fold""")
def oos_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Out-of-sample returns of each fold after a warm-up, over all symbols."""
    p = returns(spark, sf_dir).withColumn("i", F.row_number().over(series.by_day()) - 1).where("i >= 310 and r is not null")
    o = p.groupBy("symbol", F.expr("(i - 310) div 60").alias("fold")).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("ret"))
    made = {"mean": F.avg("ret"), "mid": F.median("ret"), "least": F.min("ret"), "most": F.max("ret"), "sd": F.stddev_samp("ret")}
    return o.groupBy("fold").agg(F.count("*").alias("n"), *(F.round(e, 4).alias(k) for k, e in made.items()))


@query(f"""WITH {BARS}, {RET}, m AS (SELECT symbol, CAST(year(d) AS INTEGER) AS y, month(d) AS m, exp(sum(ln(1 + r))) - 1 AS ret FROM r WHERE r IS NOT NULL GROUP BY 1, 2, 3) SELECT symbol, y, {', '.join(f'round(max(ret) FILTER (m = {i}), 4) AS m{i}' for i in range(1, 13))} FROM m GROUP BY symbol, y""")
def month_heatmap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly returns, a row a year and a column a month."""
    m = returns(spark, sf_dir).where("r is not null").groupBy("symbol", F.year("d").alias("y"), F.month("d").alias("m")).agg((F.exp(F.sum(F.log1p("r"))) - 1).alias("ret"))
    p = m.groupBy("symbol", "y").pivot("m", list(range(1, 13))).agg(F.first("ret"))
    return p.select("symbol", "y", *(F.round(F.col(str(i)), 4).alias(f"m{i}") for i in range(1, 13)))


@query("""WITH r AS (SELECT o_custkey AS run, count(*) AS orders, count(*) FILTER (o_orderstatus = 'F') AS fills, sum(CASE WHEN o_orderstatus = 'P' THEN 1 ELSE 0 END) AS odd FROM orders GROUP BY 1)
SELECT run, CASE WHEN orders < 5 THEN 'unknown' WHEN fills = 0 THEN 'empty' WHEN fills * 4 < orders OR odd > 1 THEN 'suspect' ELSE 'ok' END AS verdict FROM r""")
def run_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run's counts say about it."""
    some = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    r = load(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run")).agg(F.count("*").alias("n"), some("F").alias("fills"), some("P").alias("odd"))
    return r.select("run", F.when(F.col("n") < 5, "unknown").when(F.col("fills") == 0, "empty").when((F.col("fills") * 4 < F.col("n")) | (F.col("odd") > 1), "suspect").otherwise("ok").alias("verdict"))


@query(f"""WITH {BARS}, {RET}, a AS (SELECT symbol, round(avg(r), 6) AS stored FROM r WHERE symbol % 7 <> 0 GROUP BY symbol), b AS (SELECT symbol, round(avg(r) + CASE WHEN symbol % 5 = 0 THEN 0.01 ELSE 0 END, 6) AS fresh FROM r GROUP BY symbol)
SELECT b.symbol, CASE WHEN a.symbol IS NULL THEN 'missing' WHEN abs(stored - fresh) > 1e-5 THEN 'differs' ELSE 'same' END AS verdict FROM b LEFT JOIN a USING (symbol)""")
def metrics_verified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics worked out again, against those that were stored."""
    x = returns(spark, sf_dir).groupBy("symbol").agg(F.avg("r").alias("m"))
    a = x.where("symbol % 7 <> 0").select("symbol", F.round("m", 6).alias("stored"))
    b = x.select("symbol", F.round(F.col("m") + F.when(F.col("symbol") % 5 == 0, 0.01).otherwise(0.0), 6).alias("fresh"))
    verdict = F.when(F.col("stored").isNull(), "missing").when(F.abs(F.col("stored") - F.col("fresh")) > 1e-5, "differs").otherwise("same")
    return b.join(a, "symbol", "left").select("symbol", verdict.alias("verdict"))


@query("""WITH h AS (SELECT o_custkey AS run, CAST(o_orderdate AS DATE) AS d, l_suppkey AS symbol, CAST(sum(l_quantity) AS BIGINT) AS q FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3), g AS (SELECT DISTINCT l_suppkey AS symbol, DATE '1997-01-01' + CAST(l_suppkey * 5 AS INTEGER) AS gone FROM lineitem)
SELECT run, count(*) AS held_after, CAST(sum(q) AS BIGINT) AS shares, min(d) AS since FROM h JOIN g USING (symbol) WHERE d > gone GROUP BY run""")
def delisted_holdings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Holdings kept as a map of a day, laid out in rows, after their symbol was gone."""
    o = load(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("run"), F.to_date("o_orderdate").alias("d"))
    h = load(spark, sf_dir, "lineitem").join(o, "l_orderkey").groupBy("run", "d", F.col("l_suppkey").alias("symbol")).agg(F.sum("l_quantity").cast("long").alias("q"))
    maps = h.groupBy("run", "d").agg(F.map_from_entries(F.collect_list(F.struct("symbol", "q"))).alias("held"))  # one customer's day
    x = maps.select("run", "d", F.explode("held").alias("symbol", "q")).where(F.col("d") > F.date_add(F.lit("1997-01-01").cast("date"), (F.col("symbol") * 5).cast("int")))
    return x.groupBy("run").agg(F.count("*").alias("held_after"), F.sum("q").alias("shares"), F.min("d").alias("since"))
