"""The pool of actively managed funds: ten ordered filters and what each leaves."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Kinds of funds, words of passive, graded and foreign funds, and the bounds of the filters.
EQUITY_TYPES = ("股票型", "混合型")
PASSIVE_TYPES = ("被动指数型", "增强指数型")
PASSIVE_WORDS = "联接|ETF|指数|LOF|MSCI|中证|国证|沪深|恒生|标普|纳指"
GRADED_CODE, GRADED_WORD = r"^(15|16|167|150)\d", "分级"
FOREIGN_WORDS = "FOF|QDII|美元|纳斯达克|标普|全球|海外"
LEAST_SIZE, LEAST_VOL, LEAST_ROWS, ONE_INDEX = 2.0, 0.08, 250, 0.99
SKIP_DAYS, VOL_ROWS, VOL_RETURNS, JUMP, YEAR = 90, 120, 100, 0.25, 245

STEPS = ("all", "equity", "active", "not graded", "not foreign", "has a table", "size", "volatility", "one share class", "history")


def benchmark_weights(benchmark: Column) -> Column:
    """The shares up to 100 that a benchmark names, one for each part between plus signs."""
    parts = F.split(F.coalesce(benchmark, F.lit("")), r"[+＋]")
    share = lambda p: F.regexp_extract(p, r"(\d+(?:\.\d+)?)\s*%", 1).try_cast("double")
    return F.filter(F.transform(parts, share), lambda w: w.isNotNull() & (w <= 100))


def class_key(management: Column, name: Column) -> Column:
    """Manager and stem of the name: without brackets and the letters of the share class."""
    stem = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\(.*?\)", ""), r"[-–—]?([A-Z]{1,2})$", "")
    return F.concat_ws("|", F.coalesce(management, F.lit("")), F.trim(stem))


def nav_statistics(navs: DataFrame) -> DataFrame:
    """code, n_rows, size (of the last row that has one, in units of 10**8), vol of navs (code, d, net_asset,
    adj_nav, unit_nav).

    vol is taken from adj_nav where over 20 are there, else from unit_nav: of the values above 0 from 90 days after
    the first on, without returns of a quarter and more; null for under 120 values or 100 returns."""
    from pyspark.sql import Window

    counts = navs.groupBy("code").agg(F.count("*").alias("n_rows"), F.count("adj_nav").alias("_adj"), (F.max_by("net_asset", F.when(F.col("net_asset").isNotNull(), F.col("d"))) / 1e8).alias("size"))
    value = F.when(F.col("_adj") > 20, F.col("adj_nav")).otherwise(F.col("unit_nav"))
    every = Window.partitionBy("code")
    v = navs.join(counts.select("code", "_adj"), "code").select("code", "d", value.alias("v")).where("d is not null and v > 0")
    v = v.withColumns({"_n": F.count("*").over(every), "_first": F.min("d").over(every)}).where((F.col("_n") >= VOL_ROWS) & (F.datediff("d", "_first") >= SKIP_DAYS))
    r = v.withColumn("r", F.col("v") / F.lag("v").over(every.orderBy("d")) - 1).where(F.abs("r") < JUMP)
    vol = r.groupBy("code").agg(F.when(F.count("*") >= VOL_RETURNS, F.stddev_samp("r") * YEAR**0.5).alias("vol"))
    return counts.drop("_adj").join(vol, "code", "left")


def funnel(funds: DataFrame) -> DataFrame:
    """funds with `passed`, the number of the last filter that each passes (0 to 9), in this order.

    funds: code, name, fund_type, invest_type, management, benchmark, has_any, size, vol, n_rows. An unknown size
    or volatility passes. Of the share classes that reach the eighth filter the smallest code stays."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    weights = benchmark_weights(F.col("benchmark"))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    one_index = (F.size(weights) == 1) & (F.array_max(weights) / F.nullif(total, F.lit(0.0)) >= ONE_INDEX)
    passive = text("invest_type").isin(*PASSIVE_TYPES) | text("name").rlike(PASSIVE_WORDS) | F.coalesce(one_index, F.lit(False))
    tests = [
        text("fund_type").isin(*EQUITY_TYPES), ~passive, ~(F.col("code").rlike(GRADED_CODE) & text("name").contains(GRADED_WORD)), ~text("name").rlike(FOREIGN_WORDS),
        F.coalesce("has_any", F.lit(False)), F.col("size").isNull() | (F.col("size") >= LEAST_SIZE), F.col("vol").isNull() | (F.col("vol") >= LEAST_VOL),
    ]
    passed = F.lit(len(tests))
    for i in reversed(range(len(tests))):
        passed = F.when(~tests[i], i).otherwise(passed)
    x = funds.withColumns({"passed": passed, "_key": class_key(F.col("management"), F.col("name"))})
    first = x.where(F.col("passed") == len(tests)).groupBy("_key").agg(F.min("code").alias("_first"))
    met = x.join(first, "_key", "left")
    last = F.when((F.col("passed") < len(tests)) | (F.col("code") != F.col("_first")), F.col("passed")).when(F.coalesce("n_rows", F.lit(0)) >= LEAST_ROWS, 9).otherwise(8)
    return met.withColumn("passed", last).drop("_key", "_first")


def funnel_counts(pool: DataFrame) -> DataFrame:
    """number, step, n: how many funds each filter leaves; a row for each, zeros included."""
    steps = F.array(*(F.struct(F.lit(i).alias("number"), F.lit(s).alias("step"), F.count_if(F.col("passed") >= i).alias("n")) for i, s in enumerate(STEPS)))
    return pool.agg(steps.alias("s")).select(F.explode("s").alias("s")).select("s.*")
