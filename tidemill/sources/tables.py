"""Table registry, range reads with pruning, and daily bars over the transactional tables."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class TableMeta:
    """Where a table's date and keys are, and factors from stored to contract units."""

    name: str
    date: str | None = None
    keys: tuple[str, ...] = ()
    units: dict[str, float] = field(default_factory=dict)


REGISTRY = {m.name: m for m in (TableMeta("orders", "o_orderdate", ("o_orderkey",)), TableMeta("lineitem", "l_shipdate", ()), TableMeta("events", "ts", ("event_id",)))}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    units = REGISTRY[name].units if name in REGISTRY else {}
    return df.withColumns({c: F.col(c) * x for c, x in units.items()}) if units else df


def read_range(spark: SparkSession, sf_dir: str, name: str, start: str, end: str, columns: list[str] | None = None, where: dict[str, list] | None = None) -> DataFrame:
    """Rows between two days, both included; both bounds reach the scan. Predicates on columns that
    the table lacks are left out, and a `year` partition, if there, is pruned."""
    df, date = load(spark, sf_dir, name), REGISTRY[name].date
    df = df.where((F.col(date) >= F.lit(start).cast("timestamp")) & (F.col(date) < F.date_add(F.lit(end).cast("date"), 1).cast("timestamp")))
    if "year" in df.columns:
        df = df.where(F.col("year").between(int(start[:4]), int(end[:4])))
    for c, values in (where or {}).items():
        if c in df.columns:
            df = df.where(F.col(c).isin(values))
    return df.select(*[c for c in columns if c in df.columns]) if columns else df


WIDER = {T.ByteType: 0, T.ShortType: 1, T.IntegerType: 2, T.LongType: 3, T.FloatType: 4, T.DoubleType: 5}


def common_schema(frames: list[DataFrame]) -> dict[str, T.DataType]:
    """One type a column: nulls take the other type, unlike numbers become double; else an error."""
    out: dict[str, T.DataType] = {}
    for f in frames:
        for s in f.schema:
            was = out.get(s.name, T.NullType())
            if isinstance(was, T.NullType) or was == s.dataType:
                out[s.name] = s.dataType
            elif isinstance(s.dataType, T.NullType):
                continue
            elif type(was) in WIDER and type(s.dataType) in WIDER:
                out[s.name] = T.DoubleType()
            else:
                raise TypeError(f"column {s.name}: {was.simpleString()} and {s.dataType.simpleString()}")
    return out


def union_all(frames: list[DataFrame]) -> DataFrame:
    """Bag union of frames whose columns differ in order, width or null type."""
    schema = common_schema(frames)
    aligned = [f.select(*(F.col(c).cast(t).alias(c) if c in f.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items())) for f in frames]
    return reduce(DataFrame.unionByName, aligned)


def parts_of(spark: SparkSession, sf_dir: str, name: str, rows: int = 500_000) -> int:
    """Shuffle partitions of at most about `rows` rows of a table each, so that a task's sorts don't grow with the
    table. Rows are counted by the footers of its files."""
    return max(spark.sparkContext.defaultParallelism, -(-load(spark, sf_dir, name).count() // rows))


def daily_bars(spark: SparkSession, sf_dir: str, parts: int | None = None) -> DataFrame:
    """symbol, d, close, high, low, vol, amount: a supplier's shipments of a day as a bar. With parts, lines are
    dealt by symbol to so many partitions beforehand, and windows by symbol need no shuffle of their own."""
    price = F.col("l_extendedprice") / F.col("l_quantity")
    lines = load(spark, sf_dir, "lineitem").withColumn("symbol", F.col("l_suppkey"))
    return (
        (lines.repartition(parts, "symbol") if parts else lines)
        .groupBy("symbol", F.to_date("l_shipdate").alias("d"))
        .agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("close"), F.round(F.max(price), 6).alias("high"), F.round(F.min(price), 6).alias("low"), F.sum("l_quantity").cast("double").alias("vol"), F.round(F.sum("l_extendedprice"), 2).alias("amount"))
    )


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("d")).distinct()
