"""Tables whatever their files are laid out by: files of a year, of a code, or any files. A year's or a code's
rows may be several files <name>-<number>.parquet, as `gathered` leaves them of a large table."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

YEAR_FILE, CODE_FILE, PART = re.compile(r"\d{4}(-\d+)?\.parquet"), re.compile(r".+\..+\.parquet"), re.compile(r"-\d+$")


@dataclass(frozen=True)
class Layout:
    """kind: by_year, by_code, single or none; mixed: year files beside others, of which a reader of one kind
    would miss some."""

    kind: str
    years: tuple[int, ...] = ()
    codes: tuple[str, ...] = ()
    others: tuple[str, ...] = ()

    @property
    def mixed(self) -> bool:
        return bool(self.years) and bool(self.codes or self.others)


def file_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the Parquet files in a folder, by the store's own listing; none where there is no folder."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(where) or not files.getFileStatus(where).isDirectory():
        return []
    return sorted(s.getPath().getName() for s in files.listStatus(where) if s.isFile() and s.getPath().getName().endswith(".parquet"))


def code_names(file: str) -> set[str]:
    """The codes whose rows a file may hold: its name, and its name without the number of a part."""
    name = file.removesuffix(".parquet")
    return {name, PART.sub("", name)}


def layout(spark: SparkSession, path: str) -> Layout:
    names = file_names(spark, path)
    in_years = [n for n in names if YEAR_FILE.fullmatch(n)]
    years = tuple(sorted({int(n[:4]) for n in in_years}))
    codes = tuple(sorted({min(code_names(n), key=len) for n in names if CODE_FILE.fullmatch(n)}))
    others = tuple(n for n in names if not YEAR_FILE.fullmatch(n) and not CODE_FILE.fullmatch(n))
    kind = "none" if not names else "by_year" if len(in_years) == len(names) else "by_code" if codes else "single"
    return Layout(kind, years, codes, others)


def read_file(spark: SparkSession, path: str, columns: list[str] | None = None) -> DataFrame | None:
    """One file, or None where it is missing. Columns that it lacks are left out."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return None
    df = spark.read.parquet(path)
    return df.select(*(f"`{c}`" for c in columns if c in df.columns)) if columns else df


def read_table(spark: SparkSession, path: str, code: str | list[str] | None = None, start: str | None = None, end: str | None = None, code_column: str = "ts_code", date_column: str = "trade_date", columns: list[str] | None = None) -> DataFrame | None:
    """Rows of some codes and days, both bounds included, or None where nothing can hold any.

    Files that can't hold a row are not read: years out of range, other codes. Of mixed files all are. Both
    conditions reach the scan; one on a column that the table lacks is left out, and so are columns that it lacks.
    Dates are days, or texts of eight digits."""
    found = layout(spark, path)
    codes = [code] if isinstance(code, str) else code
    if found.kind == "none" or (codes is not None and not codes):
        return None
    names = file_names(spark, path)
    if found.kind == "by_year":
        names = [n for n in names if (start is None or int(n[:4]) >= int(start[:4])) and (end is None or int(n[:4]) <= int(end[:4]))]
    elif found.kind == "by_code" and codes is not None and not found.mixed:
        names = [n for n in names if code_names(n) & set(codes) or n in found.others]
    if not names:
        return None
    df = spark.read.option("mergeSchema", True).parquet(*(f"{path}/{n}" for n in names))
    if codes is not None and code_column in df.columns:
        df = df.where(F.col(code_column) == codes[0] if len(codes) == 1 else F.col(code_column).isin(codes))
    if date_column in df.columns:
        text = dict(df.dtypes)[date_column] == "string"
        bound = lambda d: F.lit(d.replace("-", "")) if text else F.lit(d if "-" in d else f"{d[:4]}-{d[4:6]}-{d[6:]}").cast("date")
        df = df.where(F.col(date_column) >= bound(start)) if start else df
        df = df.where(F.col(date_column) <= bound(end)) if end else df
    return df.select(*(c for c in columns if c in df.columns)) if columns else df


def gathered(spark: SparkSession, staged: str, path: str) -> None:
    """Tables staged/<name> of Spark as files path/<name>: each of one part, renamed in the store. A table of
    several parts gives <name less .parquet>-<number>.parquet; one without rows gives none."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = where(staged).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(where(path))
    for table in files.listStatus(where(staged)):
        name = table.getPath().getName()
        parts = [s.getPath() for s in files.listStatus(table.getPath()) if s.getPath().getName().startswith("part-")]
        for i, part in enumerate(parts):
            files.rename(part, where(path, name if len(parts) == 1 else f"{name.removesuffix('.parquet')}-{i}.parquet"))
