"""Footers, file trees and layouts of tables, with the SQL of what SQL can see."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.catalogue import query
from tidemill.sources import footers, layouts
from tidemill.sources.tables import load
from tidemill.streaming.events import shared_folder

BOUNDS = {"orders": ["o_orderkey", "o_orderdate", "o_orderstatus"], "lineitem": ["l_suppkey", "l_shipdate", "l_returnflag"], "documents": ["doc_id", "n_chars", "lang"], "labels": ["doc_id", "toxic"]}


def bounds_sql() -> str:
    text = lambda c: f"CAST(CAST({c} AS DATE) AS VARCHAR)" if "date" in c else f"CAST({c} AS VARCHAR)"
    return " UNION ALL ".join(
        f"SELECT '{t}' AS tab, '{c}' AS col, count(*) AS n, count(*) - count({c}) AS nulls, {text(f'min({c})')} AS least, {text(f'max({c})')} AS most FROM {t}" for t, cs in BOUNDS.items() for c in cs
    )


@query(bounds_sql())
def footer_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, nulls and bounds of columns from the files' footers, without reading the columns."""
    short = lambda v: F.when(F.col("column").endswith("date"), F.substring(v, 1, 10)).otherwise(F.col(v))
    each = [
        footers.column_bounds(spark, f"{sf_dir}/{t}.parquet", cs).select(F.lit(t).alias("tab"), F.col("column").alias("col"), F.col("rows").alias("n"), "nulls", short("least").alias("least"), short("most").alias("most"))
        for t, cs in BOUNDS.items()
    ]
    return reduce(DataFrame.unionByName, each)


@query(" UNION ALL ".join(f"SELECT '{t}' AS tab, count(*) AS n, {k} AS columns FROM {t}" for t, k in (("orders", 6), ("part", 6), ("region", 2), ("labels", 3), ("benchmark", 2))))
def footer_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and columns of tables, from footers."""
    each = [footers.footers(spark, f"{sf_dir}/{t}.parquet").withColumn("tab", F.lit(t)) for t in ("orders", "part", "region", "labels", "benchmark")]
    one = reduce(DataFrame.unionByName, each).groupBy("tab", "path", "row_group").agg(F.max("rows").alias("rows"), F.count_distinct("column").alias("columns"))
    return one.groupBy("tab").agg(F.sum("rows").alias("n"), F.max("columns").cast("int").alias("columns"))


@query()
def tree_marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Marks of all folders of the tables' files. Without SQL: it does not see files; tested on made trees."""
    return footers.folders(footers.tree(spark, sf_dir))


LAYOUT_ROWS = """SELECT layout, CAST(count(*) AS BIGINT) AS n, min(o_orderkey) AS least, CAST(min(o_orderdate) AS DATE) AS a, CAST(max(o_orderdate) AS DATE) AS e
FROM orders, (SELECT unnest(['by_year', 'by_code', 'single']) AS layout) WHERE o_orderpriority = '2-HIGH' AND o_orderdate BETWEEN DATE '1996-03-05' AND DATE '1998-02-01' GROUP BY layout"""


@query(LAYOUT_ROWS)
def layouts_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of one priority and of some days, read from three layouts of the same table."""
    o = load(spark, sf_dir, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("trade_date"), F.col("o_orderpriority").alias("ts_code"))
    base, out = shared_folder(spark), []
    files = {
        "by_year": [(f"{y}.parquet", F.year("trade_date") == y) for y in range(1992, 2000)],
        "by_code": [(f"{p}.X.parquet", F.col("ts_code") == p) for p in ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")],
        "single": [("orders.parquet", F.lit(True))],
    }
    for kind, parts in files.items():
        for name, test in parts:
            o.where(test).withColumn("ts_code", F.concat("ts_code", F.lit(".X"))).write.parquet(f"{base}/{kind}_staged/{name}")
        layouts.gathered(spark, f"{base}/{kind}_staged", f"{base}/{kind}")
        found = layouts.layout(spark, f"{base}/{kind}")
        x = layouts.read_table(spark, f"{base}/{kind}", "2-HIGH.X", "1996-03-05", "1998-02-01")
        out.append(x.agg(F.lit(found.kind).alias("layout"), F.count("*").alias("n"), F.min("o_orderkey").alias("least"), F.min("trade_date").alias("a"), F.max("trade_date").alias("e")))
    return reduce(DataFrame.unionByName, out)
