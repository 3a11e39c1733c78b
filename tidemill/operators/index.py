"""Custom indices of the smallest names, with membership carried from day to day."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def smallest(rows: DataFrame, by: str, measure: str, tie: str, k: int) -> DataFrame:
    """The k rows of each `by` with the least measure (above 0), ties by `tie`, without sorting a group.

    A histogram of powers of 2**(1/16) is counted by partial aggregation; its bins up to the k-th row are
    taken whole, and only the rows of the bin that holds it are ranked. Those are ranked in as many parts
    as they were read in first, so that equal measures don't meet in one task but for k rows a part."""
    binned = rows.withColumn("_bin", F.floor(F.log2(F.col(measure)) * 16))
    counts = binned.groupBy(by, "_bin").agg(F.count("*").alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy(by).orderBy("_bin"))  # a row a bin
    cut = counts.withColumn("_upto", upto).where(F.col("_upto") - F.col("_n") < k).select(by, "_bin", (F.lit(k) - F.col("_upto") + F.col("_n")).alias("_need"), (F.col("_upto") <= k).alias("_whole"))
    met = binned.join(cut, [by, "_bin"])
    border = met.where("not _whole").withColumn("_part", F.spark_partition_id())
    for keys in ([by, "_bin", "_part"], [by, "_bin"]):
        border = border.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(measure, tie))).where("_rank <= _need").drop("_rank")
    return met.where("_whole").select(*rows.columns).unionByName(border.select(*rows.columns))


def carried_index(rows: DataFrame, k: int = 400, least: int = 500, survivors: int = 100, period: str | None = None) -> DataFrame:
    """d, ret, n, nav of an index of the k smallest names. rows: d, symbol, size (above 0), ret; with a
    column `period` (not falling with d), members change only on its first day.

    Days of fewer than `least` names don't count. Without period a day holds the names that were
    smallest on the counted day before. With it, the names of the last choice: on a period's first day
    they are chosen anew, without a return; a day on which fewer than `survivors` of them trade has no
    return either, and chooses anew. Membership of every counted day meets the rows of its period, so
    a period's choices need one fold over its pairs of days and no loop over days.
    """
    sizes = rows.groupBy("d", *([period] if period else [])).agg(F.count("*").alias("_names")).where(F.col("_names") >= least)
    w = Window.orderBy("d")  # a row a day
    days = sizes.select("d", F.row_number().over(w).alias("_i"), (F.col(period) if period else F.lit(0)).alias("_p"))
    counted = rows.select("d", "symbol", "size", "ret").join(days, "d")
    members = smallest(counted, "d", "size", "symbol", k).select("symbol", F.col("_i").alias("_base"), "_p")
    mean = [F.count("*").alias("n"), F.avg("ret").alias("ret")]
    if not period:
        held = counted.join(members.select("symbol", (F.col("_base") + 1).alias("_i")), ["symbol", "_i"])
        kept = held.groupBy("d").agg(*mean).where(F.col("n") >= survivors)
    else:
        pairs = counted.join(members, ["symbol", "_p"]).where("_i > _base").groupBy("_p", "_base", "_i").agg(*mean)
        table = pairs.groupBy("_p").agg(F.map_from_entries(F.collect_list(F.struct(F.struct("_base", "_i"), F.struct("n", "ret")))).alias("_met"))
        told = days.groupBy("_p").agg(F.array_sort(F.collect_list("_i")).alias("_days")).join(table, "_p", "left")

        def step(state, i):
            own = F.try_element_at(F.col("_met"), F.struct(state["base"].alias("_base"), i.alias("_i")))
            good = F.coalesce(own["n"] >= survivors, F.lit(False))
            row = F.struct(i.alias("_i"), own["n"].alias("n"), own["ret"].alias("ret"))
            return F.struct(F.when(good, state["base"]).otherwise(i).alias("base"), F.when(good, F.concat(state["out"], F.array(row))).otherwise(state["out"]).alias("out"))

        start = F.struct(F.element_at("_days", 1).alias("base"), F.array().cast("array<struct<_i:int,n:bigint,ret:double>>").alias("out"))
        walked = F.aggregate(F.slice("_days", 2, F.greatest(F.size("_days") - 1, F.lit(0))), start, step, lambda s: s["out"])
        kept = told.select(F.explode(walked).alias("x")).select("x.*").join(days, "_i").select("d", "n", "ret")
    return kept.select("d", "ret", "n", F.exp(F.sum(F.log1p("ret")).over(w)).alias("nav"))
