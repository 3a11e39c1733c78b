"""Recursions along a line: a task walks its rows in order and keeps the state from batch to batch.

Rows are brought together and sorted by a window that marks the first row of each group. Nothing is collected
by group, so a task holds a batch and one state, however long a group is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def walk(rows: DataFrame, by: list[str], order: list[Column], steps: list[Column], made: dict[str, T.DataType], fold: Callable, chunk: int = 8192) -> DataFrame:
    """rows with the columns `made`, along `order` within `by`. fold(state, first, *steps) gets the state that
    the rows before left, and lists: whether a row begins a group, and the steps of at most `chunk` rows; it
    returns the state after them and a list for each column made."""
    from pyspark.sql.pandas.types import to_arrow_type

    w, n = Window.partitionBy(*by).orderBy(*order), len(rows.columns)
    line = rows.select(*(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rows.columns)), (F.row_number().over(w) == 1).alias("_first"), *(c.alias(f"_step{i}") for i, c in enumerate(steps)))
    names, kinds = [*rows.columns, *made], [to_arrow_type(t) for t in made.values()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for batch in batches:
            for a in range(0, batch.num_rows, chunk):
                part = batch.slice(a, chunk).columns
                state, *out = fold(state, *(c.to_pylist() for c in part[n:]))
                yield pa.RecordBatch.from_arrays([*part[:n], *map(pa.array, out, kinds)], names)

    return line.mapInArrow(run, T.StructType([*rows.schema, *(T.StructField(c, t) for c, t in made.items())]))


def affine_scan(rows: DataFrame, by: list[str], order: list[Column], a: Column, b: Column, before: str, start: float = 0.0, chunk: int = 8192) -> DataFrame:
    """rows with `before` of the recursion x := a * x + b. Where a is 0 the state before does not count, null or not."""

    def fold(x, first, a, b):
        out = []
        for new, m, n in zip(first, a, b):
            x = start if new else x
            out.append(x)
            x = n if m == 0 else None if x is None or m is None or n is None else x * m + n
        return x, out

    return walk(rows, by, order, [a.cast("double"), b.cast("double")], {before: T.DoubleType()}, fold, chunk)


def affine_pair(rows: DataFrame, by: list[str], order: list[Column], x: tuple[Column, Column], y: tuple[Column, Column, Column], before: tuple[str, str], start: tuple[float, float] = (0.0, 0.0), chunk: int = 8192) -> DataFrame:
    """rows with both values before each of the recursion x := a * x + b, y := c * y + e * x + f, where the
    second takes x as it was before the row. Where a, c or e is 0 its value does not count, null or not."""

    def fold(state, first, a, b, c, e, f):
        now, then = state or start
        xs, ys = [], []
        for new, m, n, p, q, r in zip(first, a, b, c, e, f):
            if new:
                now, then = start
            xs.append(now)
            ys.append(then)
            if now is None or then is None or None in (m, n, p, q, r):
                left = 0.0 if p == 0 else None if then is None or p is None else then * p
                right = r if q == 0 else None if now is None or q is None or r is None else now * q + r
                then = None if left is None or right is None else left + right
                now = n if m == 0 else None if now is None or m is None or n is None else now * m + n
            else:
                now, then = now * m + n, then * p + now * q + r
        return (now, then), xs, ys

    return walk(rows, by, order, [v.cast("double") for v in (*x, *y)], dict.fromkeys(before, T.DoubleType()), fold, chunk)


def state_scan(rows: DataFrame, by: list[str], order: list[Column], step: Column, before: str, start: int = 0, chunk: int = 8192) -> DataFrame:
    """rows with `before`, the state of a machine of few states; step is the array of each state's next one."""

    def fold(x, first, step):
        out = []
        for new, m in zip(first, step):
            x = start if new else x
            out.append(x)
            x = m[x] if x is not None and m is not None and 0 <= x < len(m) else None
        return x, out

    return walk(rows, by, order, [step], {before: T.IntegerType()}, fold, chunk)
