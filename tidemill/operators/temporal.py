"""Joins over time without nested loops: as-of, interval, band and forward joins, and islands."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_joins(left: DataFrame, right: DataFrame, by: str, on: str, value: str, asked: dict[str, dict], parts: int | None = None) -> DataFrame:
    """left with a column for each name in `asked`: `value` of the last right row at or before `on`, by these options.

    strict: before; forward: the first at or after. tolerance_days: farther rows give null. first_as_fallback:
    before the first row, its value; default: for keys without rows. Both sides are laid on one time line
    for all names: one shuffle on `by`, to `parts` partitions if that is given, and a sort for each direction."""
    side = lambda how: 2 if how.get("strict", False) != how.get("forward", False) else 0  # noqa: E731  right rows lie before left rows of their moment, or after them
    kinds = sorted({side(how) for how in asked.values()})
    fallback = any(how.get("first_as_fallback") for how in asked.values())
    line = left.withColumns({"_v": F.lit(None).cast(dict(right.dtypes)[value]), "_kind": F.lit(1)})
    rows = right.select(by, on, F.col(value).alias("_v"), F.explode(F.array(*map(F.lit, kinds))).alias("_kind"))
    line = line.unionByName(rows, allowMissingColumns=True)
    if parts:
        line = line.repartition(parts, by)
    w = Window.partitionBy(by)
    found, names = {}, {}
    for name, how in asked.items():
        order = (F.desc(on), F.desc("_kind")) if how.get("forward") else (on, "_kind")
        near = F.when(F.col("_kind") == side(how), F.struct("_v", F.col(on).alias("_t")))
        names[name] = f"_found{len(names)}"
        found[names[name]] = F.last(near, ignorenulls=True).over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    if fallback:
        found["_least"] = F.first(F.when(F.col("_kind") == kinds[0], F.col("_v")), ignorenulls=True).over(w.orderBy(on, "_kind").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    out, values = line.withColumns(found).where("_kind = 1"), []
    for name, how in asked.items():
        v = F.col(names[name])["_v"]
        if how.get("tolerance_days") is not None:
            v = F.when(F.abs(F.datediff(F.col(on), F.col(names[name])["_t"])) <= how["tolerance_days"], v)
        if how.get("first_as_fallback"):
            v = F.coalesce(v, F.col("_least"))
        if how.get("default") is not None:
            v = F.coalesce(v, F.lit(how["default"]))
        values.append(v.alias(name))
    return out.select(*left.columns, *values)


def asof_join(left: DataFrame, right: DataFrame, by: str, on: str, value: str, **how) -> DataFrame:
    """asof_joins for one column, named as the value."""
    return asof_joins(left, right, by, on, value, {value: how})


def interval_join(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str, bin_days: int = 32) -> DataFrame:
    """Points inside [start, end) of spans with the same key; a null end is open. Spans are cut at
    bins of days so that the join has an equality on the bin and scans no pairs across bins."""
    last = points.agg(F.max(at)).first()[0]
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date"))
    upto = F.coalesce(F.col(end), F.date_add(F.lit(last).cast("date"), 1))
    cut = spans.where(F.col(start) < upto).withColumn("_bin", F.explode(F.sequence(F.floor(day(F.col(start)) / bin_days), F.floor((day(upto) - 1) / bin_days))))
    p = points.withColumn("_bin", F.floor(day(F.col(at)) / bin_days))
    return p.join(cut, [by, "_bin"]).where((F.col(at) >= F.col(start)) & (F.col(end).isNull() | (F.col(at) < F.col(end)))).drop("_bin")


def interval_counts(points: DataFrame, spans: DataFrame, by: str, at: str, start: str, end: str) -> DataFrame:
    """points with `n`, how many spans [start, end) of their key hold them: spans open and close on the
    same line as the points, and a running sum counts the open ones. No pair is formed."""
    line = points.withColumns({"_step": F.lit(0), "_kind": F.lit(1)})
    for c, step in ((start, 1), (end, -1)):
        line = line.unionByName(spans.where(F.col(c).isNotNull()).select(F.col(by), F.col(c).alias(at), F.lit(step).alias("_step"), F.lit(0).alias("_kind")), allowMissingColumns=True)
    w = Window.partitionBy(by).orderBy(at, "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return line.withColumn("n", F.sum("_step").over(w)).where("_kind = 1").select(*points.columns, "n")


def nearest_before(left: DataFrame, right: DataFrame, by: str, on: str, other: str, days: int, order: list[Column]) -> DataFrame:
    """For each left row the nearest right row of its key at most `days` earlier; of right rows of one
    day the first by `order`. One line of both sides, so repeated left rows all stay; rows without a
    near one are left out."""
    carried = [c for c in right.columns if c != by]
    one = latest_by(right, [by, other], order).select(by, F.col(other).alias(on), F.struct(*carried).alias("_near"))
    x = asof_join(left, one, by, on, "_near", tolerance_days=days).where("_near is not null")
    return x.select(*left.columns, *(F.col("_near")[c].alias(c) for c in carried))


def islands(rows: DataFrame, by: str, start: str, end: str, gap_days: int) -> DataFrame:
    """by, start, end, parts: runs of spans of which each begins at most gap_days after the latest end so far."""
    w = Window.partitionBy(by).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    fresh = rows.withColumn("_new", F.when(reach.isNull() | (F.datediff(F.col(start), reach) > gap_days), 1).otherwise(0))
    return fresh.withColumn("_island", F.sum("_new").over(w)).groupBy(by, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("parts")).drop("_island")


def latest_by(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row a key: the first in `order`, which must be total."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def first_rows(rows: DataFrame, by: list[str], order: list[Column], k: int | Column) -> DataFrame:
    """The first k rows of each key in `order`, which must be total. Each task keeps the first k of its own
    rows before any key is brought together, so that no task sorts all rows of a key."""
    local = rows.withColumn("_part", F.spark_partition_id())
    for keys in ([*by, "_part"], by):
        local = local.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= k).drop("_n")
    return local.drop("_part")


def later_days(rows: DataFrame, days: DataFrame, after: str, day: str) -> DataFrame:
    """rows with every later day of a calendar: days are numbered once, and a row spans a sequence of
    numbers, so nothing is compared in pairs. The calendar, a row a day, is numbered in one window."""
    numbered = days.select(F.col(day), F.row_number().over(Window.orderBy(day)).alias("_i"))
    line = numbered.select(F.col(day).alias(after), "_i").unionByName(rows.select(after).distinct().withColumn("_i", F.lit(None).cast("int")))
    upto = line.select(after, F.coalesce(F.max("_i").over(Window.orderBy(after)), F.lit(0)).alias("_at")).distinct().groupBy(after).agg(F.max("_at").alias("_at"))
    last = numbered.agg(F.max("_i").alias("_n"))
    spread = rows.join(upto, after).crossJoin(F.broadcast(last)).where("_at < _n").withColumn("_i", F.explode(F.sequence(F.col("_at") + 1, F.col("_n"))))
    return spread.join(numbered, "_i").drop("_i", "_at", "_n")


def ratio_band(left: DataFrame, right: DataFrame, by: str, at: str, ratio: str, days: int, gap: float) -> DataFrame:
    """Pairs of one key at most `days` apart whose ratios (above 0) part by at most `gap` of the left one:
    left's columns, and right's as `other_<name>`, but for the key.

    Cells of both measures are as wide as their tolerance, so a row meets the rows of its own and the
    neighbouring cells alone; logarithms of ratios make the width the same for all. Right rows go to
    nine cells, the bounds themselves are tested on the values."""
    day = lambda c: F.unix_date(F.col(c).cast("date"))
    width = -math.log1p(-gap) * (1 + 1e-9)  # |ln r - ln s| is at most this
    cell = lambda t, r: (F.floor(t / (days + 1)), F.floor(F.log(r) / width))
    l_day, l_ratio = cell(day(at), F.col(ratio))
    r_day, r_ratio = cell(day(f"other_{at}"), F.col(f"other_{ratio}"))
    near = F.array(*(F.struct((r_day + i).alias("_day"), (r_ratio + j).alias("_ratio")) for i in (-1, 0, 1) for j in (-1, 0, 1)))
    a = left.where(F.col(ratio) > 0).withColumns({"_day": l_day, "_ratio": l_ratio})
    b = right.select(by, *(F.col(c).alias(f"other_{c}") for c in right.columns if c != by)).where(F.col(f"other_{ratio}") > 0)
    b = b.withColumn("_near", F.explode(near)).select("*", "_near.*").drop("_near")
    met = a.join(b, [by, "_day", "_ratio"]).drop("_day", "_ratio")
    return met.where((F.abs(F.datediff(at, f"other_{at}")) <= days) & (F.abs(F.col(f"other_{ratio}") - F.col(ratio)) / F.col(ratio) <= gap))
