"""Indicators along a symbol's days; every function adds columns by windows on one partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_day():
    return Window.partitionBy("symbol").orderBy("d")


def rows_back(first: int, last: int = 0):
    return by_day().rowsBetween(-first, -last)


def full(value: Column, n: int, last: int = 0) -> Column:
    """value, or null until n rows are there."""
    return F.when(F.count(F.lit(1)).over(rows_back(n - 1 + last, last)) == n, value)


def moving_mean(c: str, n: int, last: int = 0) -> Column:
    return full(F.avg(c).over(rows_back(n - 1 + last, last)), n, last)


def change_pct(c: str, n: int) -> Column:
    return (F.col(c) / F.lag(c, n).over(by_day()) - 1) * 100


def volume_ratio(c: str, short: int = 5, long: int = 20) -> Column:
    """Mean of the last `short` rows over the mean of those before them up to `long`; 1 if that is 0.
    Sums are divided once, so whole volumes give the same ratio in any order of rows."""
    before = full(F.sum(c).over(rows_back(long - 1, short)), long - short, short)
    return F.when(before == 0, 1.0).otherwise(full(F.sum(c).over(rows_back(short - 1)), short) * ((long - short) / short) / before)


def rsi(bars: DataFrame, n: int = 14) -> DataFrame:
    """Mean gain against mean loss, each over its own days only; no loss counts as 1e-9."""
    step = bars.withColumn("_s", F.col("close") - F.lag("close").over(by_day()))
    w = rows_back(n - 1)
    up = F.coalesce(F.avg(F.when(F.col("_s") > 0, F.col("_s"))).over(w), F.lit(0.0))
    down = F.coalesce(F.avg(F.when(F.col("_s") < 0, -F.col("_s"))).over(w), F.lit(1e-9))
    return step.withColumn("rsi", F.when(F.count("_s").over(w) == n, 100 - 100 / (1 + up / down))).drop("_s")


def bollinger(bars: DataFrame, n: int = 20, k: float = 2.0) -> DataFrame:
    mid, dev = moving_mean("close", n), full(F.stddev_pop("close").over(rows_back(n - 1)), n)
    return bars.withColumns({"mid": mid, "upper": mid + k * dev, "lower": mid - k * dev})


def stochastic(bars: DataFrame, n: int = 14) -> DataFrame:
    """RSV of the last n rows; 50 on a flat range."""
    low, high = F.min("low").over(rows_back(n - 1)), F.max("high").over(rows_back(n - 1))
    return bars.withColumn("rsv", full(F.when(high == low, 50.0).otherwise((F.col("close") - low) / (high - low) * 100), n))


def folded(bars: DataFrame, value: str, start: Column, step) -> DataFrame:
    """symbol and the fold of `step(state, x)` over its values in day order, from `start` on."""
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("d", value))), lambda r: r[value])
    return bars.groupBy("symbol").agg(ordered.alias("_x")).select("symbol", F.aggregate("_x", start, step).alias("state"))


def ema_step(period: int):
    k = 2 / (period + 1)
    return lambda s, x: F.when(s.isNull(), x).otherwise(s * (1 - k) + x * k)


def smoothed(rows: DataFrame, made: dict[str, tuple[str, float]]) -> DataFrame:
    """rows with columns that smooth another from a symbol's first day on: name to (column, weight of the
    new value). A group is one symbol's days, a row for each."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    def run(pdf):
        pdf = pdf.sort_values("d")
        return pdf.assign(**{name: pdf[c].ewm(alpha=a, adjust=False).mean() for name, (c, a) in made.items()})

    return rows.groupBy("symbol").applyInPandas(run, StructType([*rows.schema, *(StructField(name, DoubleType()) for name in made)]))


def macd(bars: DataFrame) -> DataFrame:
    """dif, dea and histogram of each symbol's last day; each average starts at its first value."""
    empty = F.struct(*(F.lit(None).cast("double").alias(c) for c in ("fast", "slow", "dea")))

    def step(s, x):
        fast, slow = ema_step(12)(s["fast"], x), ema_step(26)(s["slow"], x)
        return F.struct(fast.alias("fast"), slow.alias("slow"), ema_step(9)(s["dea"], fast - slow).alias("dea"))

    out = folded(bars, "close", empty, step)
    dif = F.col("state.fast") - F.col("state.slow")
    return out.select("symbol", dif.alias("dif"), F.col("state.dea").alias("dea"), (2 * (dif - F.col("state.dea"))).alias("hist"))


def divergence(rows: DataFrame, price: str, other: str, n: int = 20) -> DataFrame:
    """top: price at a new high while the other is below 0.9 of its high; bottom: the mirror with 1.1."""
    before = rows_back(n - 1, 1)
    top = (F.col(price) >= F.max(price).over(before)) & (F.col(other) < F.max(other).over(before) * 0.9)
    bottom = (F.col(price) <= F.min(price).over(before)) & (F.col(other) > F.min(other).over(before) * 1.1)
    return rows.withColumn("signal", F.when(F.count(F.lit(1)).over(rows_back(n - 1)) < n, "none").when(top, "top").when(bottom, "bottom").otherwise("none"))


def drawdown(c: str) -> Column:
    return F.col(c) / F.max(c).over(by_day().rowsBetween(Window.unboundedPreceding, 0)) - 1
