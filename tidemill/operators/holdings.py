"""Holdings from fills: running average cost, and lots first in, first out, through consolidations.

A sale past the holdings counts for what is held; the rest is dropped at its moment. What is held is the
running sum of fills reflected at 0, so both come from a running minimum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.operators.scan import affine_pair
from tidemill.operators.simulate import fifo_pairs


def reflected(fills: DataFrame) -> DataFrame:
    """fills (symbol, seq, sell, qty) with was and held, the shares before and after each, and done, the
    shares that it moves."""
    w = Window.partitionBy("symbol").orderBy("seq")
    net = F.sum(F.when(F.col("sell"), -F.col("qty")).otherwise(F.col("qty"))).over(w)
    x = fills.withColumn("_net", net).withColumn("held", F.col("_net") - F.least(F.lit(0), F.min("_net").over(w)))
    was = F.coalesce(F.lag("held").over(w), F.lit(0).cast(dict(x.dtypes)["held"]))
    return x.withColumn("was", was).withColumn("done", F.abs(F.col("held") - F.col("was"))).drop("_net")


def running_cost(fills: DataFrame) -> DataFrame:
    """fills (symbol, seq, sell, qty, price, fee) with was, held, done, avg_cost (of a held share, fees of
    purchases included; 0 without holdings) and realized (gains of sales so far, less their fees).

    A purchase mixes its cost in, a sale keeps the average: the whole cost and the gains so far are walked
    together, in the order that the windows have sorted."""
    x = reflected(fills)
    sells = F.col("sell") & (F.col("done") > 0)
    share = F.col("done") / F.when(F.col("was") > 0, F.col("was")).otherwise(1)
    a = F.when(F.col("sell"), F.when(F.col("held") == 0, 0.0).otherwise(1 - share)).otherwise(1.0)
    b = F.when(F.col("sell"), 0.0).otherwise(F.col("price") * F.col("qty") + F.col("fee"))
    fee = F.col("fee") * F.col("done") / F.nullif("qty", F.lit(0))
    gain = (F.lit(1.0), F.when(sells, -share).otherwise(0.0), F.when(sells, F.col("price") * F.col("done") - fee).otherwise(0.0))
    x = affine_pair(x, ["symbol"], [F.col("seq")], (a, b), gain, ("_cost", "_gains"))
    after = F.when(F.col("held") == 0, 0.0).otherwise((F.col("_cost") * a + b) / F.nullif("held", F.lit(0)))
    return x.withColumn("avg_cost", after).withColumn("realized", F.col("_gains") + F.when(sells, gain[2] - F.col("_cost") * share).otherwise(0.0)).drop("_cost", "_gains")


def fifo_trades(fills: DataFrame, events: DataFrame) -> DataFrame:
    """symbol, buy_id, sell_id, qty, cost, price, pnl: each sale with the oldest shares left.

    fills: symbol, seq, d, sell, qty, price, fee; events: symbol, ex, ratio, applied before the fills of
    their day. An event turns what is left of a lot to whole shares of qty * ratio at cost / ratio; a lot
    that would vanish keeps one share at its cost. Fees are shared by quantity, those of a purchase over its
    shares as they are then. Fills between two events of a symbol are paired at once, by windows; the plan
    has a step for each event of the symbol that has most.
    """
    w = Window.partitionBy("symbol").orderBy("ex")
    numbered = events.where("ratio > 0 and ratio <> 1").select("symbol", "ex", "ratio", F.row_number().over(w).alias("epoch"))
    most = numbered.agg(F.max("epoch")).first()[0] or 0
    line = fills.select("symbol", "seq", F.col("d").alias("_at"), F.lit(1).alias("_kind"), "sell", F.col("qty").cast("long").alias("qty"), F.col("price").cast("double").alias("price"), F.col("fee").cast("double").alias("fee"))
    marks = numbered.select("symbol", F.col("ex").alias("_at"), F.lit(0).alias("_kind"), F.col("epoch").alias("_epoch"))
    both = line.withColumn("_epoch", F.lit(None).cast("int")).unionByName(marks, allowMissingColumns=True)
    passed = F.coalesce(F.max("_epoch").over(Window.partitionBy("symbol").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    laid = both.withColumn("epoch", passed).where("_kind = 1").drop("_at", "_kind", "_epoch")
    lots, out = None, None
    for k in range(most + 1):
        own = laid.where(F.col("epoch") == k)
        bought = own.where("not sell").select("symbol", "seq", F.col("qty").alias("left"), F.col("price").alias("cost"), F.col("qty").cast("double").alias("whole"), "fee")
        lots = bought if lots is None else lots.unionByName(bought)
        sold = own.where("sell").select("symbol", F.col("seq").alias("sell_id"), F.col("qty").alias("sell_qty"), "price", F.col("fee").alias("sell_fee"))
        moves = lots.select("symbol", "seq", F.lit(False).alias("sell"), F.col("left").alias("qty")).unionByName(own.where("sell").select("symbol", "seq", "sell", "qty"))
        side = F.when(F.col("sell"), "sell").otherwise("buy")
        pairs = fifo_pairs(reflected(moves).where("done > 0").select("symbol", F.col("seq").alias("fill_id"), side.alias("side"), F.col("done").alias("qty")))
        pairs = pairs.where("sell_id is not null and buy_id is not null")
        t = pairs.join(lots.withColumnRenamed("seq", "buy_id"), ["symbol", "buy_id"]).join(sold, ["symbol", "sell_id"])
        qty = F.col("qty")
        pnl = F.col("price") * qty - F.col("sell_fee") * qty / F.col("sell_qty") - F.col("cost") * qty - F.col("fee") * qty / F.col("whole")
        t = t.select("symbol", "buy_id", "sell_id", "qty", "cost", "price", pnl.alias("pnl"))
        out = t if out is None else out.unionByName(t)
        if k < most:
            gone = pairs.groupBy("symbol", F.col("buy_id").alias("seq")).agg(F.sum("qty").alias("_gone"))
            rest = lots.join(gone, ["symbol", "seq"], "left").withColumn("left", F.col("left") - F.coalesce("_gone", F.lit(0))).where("left > 0")
            met = rest.join(numbered.where(F.col("epoch") == k + 1).select("symbol", "ratio"), "symbol")
            raw = F.floor(F.col("left") * F.col("ratio"))
            turned = {"left": F.greatest(raw, F.lit(1)), "cost": F.when(raw > 0, F.col("cost") / F.col("ratio")).otherwise(F.col("cost")), "whole": F.when(raw > 0, F.col("whole") * F.col("ratio")).otherwise(1.0)}
            lots = met.select("symbol", "seq", *(e.alias(c) for c, e in turned.items()), "fee")
    return out
