"""Keyed upserts, differences of keyed sets, merges of repeated keys, and partitioned writes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def upsert(existing: DataFrame, new: DataFrame, keys: list[str] | None, order: list | None = None) -> DataFrame:
    """Union where the last row of a key wins: new before existing, then by `order`, then by a digest of the
    row, so that the same one of rows without an order is kept. Without keys, whole rows are compared."""
    both = existing.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    if not keys:
        return both.drop("_new").distinct()
    w = Window.partitionBy(*keys).orderBy(F.desc("_new"), *(order or []), F.xxhash64(*(f"`{c}`" for c in new.columns)))
    return both.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_new")


def _path(spark, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark, path: str) -> bool:
    where, files = _path(spark, path)
    return files.exists(where)


def remove(spark, path: str) -> None:
    where, files = _path(spark, path)
    files.delete(where, True)


def upsert_by_year(spark, path: str, new: DataFrame, keys: list[str], date: str) -> None:
    """Upsert into a table partitioned by year; only years that `new` touches are rewritten, from a
    staged copy that is removed afterwards. A missing date column or a null date is an error."""
    if date not in new.columns:
        raise ValueError(f"no column {date}")
    new = new.withColumn("year", F.year(date))
    if new.where(F.col("year").isNull()).limit(1).count():
        raise ValueError(f"null in {date}")
    if not exists(spark, path):
        new.write.partitionBy("year").parquet(path)
        return
    years = [r.year for r in new.select("year").distinct().collect()]  # a row a year
    old = spark.read.parquet(path).where(F.col("year").isin(years)).select(new.columns)
    replace_partitions(spark, path, upsert(old, new, keys), "year")


def replace_partitions(spark, path: str, rows: DataFrame, by: str) -> None:
    """Rewrite the partitions that rows have, through a staged copy."""
    staged = f"{path}_staged"
    try:
        rows.write.mode("overwrite").parquet(staged)
        spark.read.parquet(staged).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)
    finally:
        remove(spark, staged)


def upsert_grouped(spark, path: str, new: DataFrame, group: str, keys: list[str]) -> None:
    """Upsert into a table with a partition for each value of `group`; a table laid out by year is refused."""
    if exists(spark, path):
        old = spark.read.parquet(path)
        if "year" in old.columns and group != "year":
            raise ValueError("the table is laid out by year")
        touched = new.select(group).distinct()
        rows = upsert(old.join(F.broadcast(touched) if touched.count() < 100_000 else touched, group, "left_semi").select(new.columns), new, keys)
        replace_partitions(spark, path, rows, group)
    else:
        new.write.partitionBy(group).parquet(path)


def to_year_partitions(spark, path: str, target: str, dates: list[str], dry_run: bool = False) -> int:
    """Lay a table out by the year of the first of `dates` that is not null; a copy with another number
    of rows is removed and an error raised. Gives the rows; dry_run counts alone."""
    rows = spark.read.parquet(path)
    year = F.coalesce(*(F.year(c) for c in dates if c in rows.columns))
    n = rows.count()
    if dry_run:
        return n
    if rows.where(year.isNull()).limit(1).count():
        raise ValueError("a row without a year")
    rows.withColumn("year", year).write.partitionBy("year").parquet(target)
    if spark.read.parquet(target).count() != n:
        remove(spark, target)
        raise ValueError("the copy has another number of rows")
    return n


def aligned(frames: list[DataFrame]) -> list[DataFrame]:
    """The frames with one order of columns and one type for each, as common_schema decides."""
    from tidemill.sources.tables import common_schema

    schema = common_schema(frames)
    return [f.select(*(F.col(c).cast(t).alias(c) if c in f.columns else F.lit(None).cast(t).alias(c) for c, t in schema.items())) for f in frames]


def normalized(rows: DataFrame, names: dict[str, str], date: str, day=None) -> DataFrame:
    """Source rows renamed, with a day put in where they lack one, without null days and repeats."""
    out = rows.withColumnsRenamed(names)
    if date not in out.columns:
        out = out.withColumn(date, F.lit(day).cast("date"))
    return out.where(F.col(date).isNotNull()).distinct()


def changes(old: DataFrame, new: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """keys and `change`: added, removed or touched; equal keys with equal values (nulls too) are left out."""
    a = old.select(*keys, F.struct(*values).alias("_a"))
    b = new.select(*keys, F.struct(*values).alias("_b"))
    kind = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(~F.col("_a").eqNullSafe(F.col("_b")), "touched")
    return a.join(b, keys, "full").select(*keys, kind.alias("change")).where("change is not null")


def merge_keys(rows: DataFrame, keys: list[str], order: str, last: bool = False) -> DataFrame:
    """One row a key; of each other column the first (last) value that is not null, in `order`."""
    pick = F.max_by if last else F.min_by
    others = [c for c in rows.columns if c not in keys and c != order]
    return rows.groupBy(*keys).agg(*(pick(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in others))


def without_siblings(rows: DataFrame, clean: DataFrame, keys: list[str], values: list[str], malformed) -> DataFrame:
    """rows without the malformed ones that clean holds with equal keys and values, nulls equal."""
    a, b = rows.where(malformed), clean.select(*keys, *values).distinct()
    cond = [a[k] == b[k] for k in keys] + [a[v].eqNullSafe(b[v]) for v in values]
    return rows.where(~malformed).unionByName(a.join(b, cond, "left_anti"))


def fill_days(spark, path: str, days: DataFrame, compute, unit) -> int:
    """Work out the days of `days` (d) that the table at path lacks, and only those; how many there were.

    compute(missing days) gives their rows, with d. The table is partitioned by `unit`, an expression of d;
    only partitions with missing days are rewritten, with what they held, from a staged copy, so a run that
    breaks off or comes again leaves the same table."""
    held = spark.read.parquet(path) if exists(spark, path) else None
    missing = days.select("d").distinct()
    if held is not None:
        missing = missing.join(held.select("d").distinct(), "d", "left_anti")
    units = [r.unit for r in missing.groupBy(unit.alias("unit")).count().collect()]  # a row a partition
    if not units:
        return 0
    rows = compute(missing).withColumn("unit", unit)
    if held is not None:
        rows = held.where(F.col("unit").isin(units)).select(rows.columns).unionByName(rows)
    count = missing.count()
    replace_partitions(spark, path, rows, "unit")
    return count


def replace_table(spark, path: str, rows: DataFrame, fewer: bool = False) -> None:
    """Rewrite the table at path, through a staged copy. Fewer rows than it holds are an error unless allowed."""
    staged = f"{path}_staged"
    try:
        rows.write.mode("overwrite").parquet(staged)
        new = spark.read.parquet(staged)
        if not fewer and exists(spark, path) and (was := spark.read.parquet(path).count()) > (now := new.count()):
            raise ValueError(f"{now} rows would replace {was}")
        new.write.mode("overwrite").parquet(path)
    finally:
        remove(spark, staged)


def merge_append(spark, path: str, new: DataFrame, keys: list[str], sort_by: list[str] | None = None, keep: str = "last") -> dict:
    """Merge rows by key into the table at path: rows (after), added, changed and whether it was written.

    keep="last" lets new rows replace old ones, and of new rows of one key the last by sort_by; "first" keeps
    the old row, and of new ones the first. A merge that changes no value writes nothing."""
    by = [F.desc_nulls_last(c) if keep == "last" else F.asc_nulls_first(c) for c in sort_by or []]
    fresh = upsert(new.limit(0), new, keys, by)
    if not exists(spark, path):
        fresh.write.parquet(path)
        n = spark.read.parquet(path).count()
        return {"rows": n, "added": n, "changed": 0, "written": n > 0}
    old = spark.read.parquet(path).select(new.columns)
    values = [c for c in new.columns if c not in keys]
    pair = lambda df, name: df.select(*keys, F.struct(*values).alias(name))
    both = pair(old, "_old").join(pair(fresh, "_new"), keys, "full")
    differs = F.col("_old").isNotNull() & F.col("_new").isNotNull() & ~F.col("_old").eqNullSafe(F.col("_new"))
    n = both.agg(F.count("*").alias("rows"), F.count_if(F.col("_old").isNull()).alias("added"), F.count_if(differs).alias("changed")).first()
    changed = n.changed if keep == "last" else 0
    if not n.added and not changed:
        return {"rows": n.rows, "added": 0, "changed": 0, "written": False}
    order = ("_new", "_old") if keep == "last" else ("_old", "_new")
    replace_table(spark, path, both.select(*keys, F.coalesce(*order).alias("_x")).select(*keys, "_x.*").select(new.columns))
    return {"rows": n.rows, "added": n.added, "changed": changed, "written": True}
