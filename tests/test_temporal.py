"""Band joins and first rows against all pairs and plain sorting."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import maintenance, temporal


@pytest.mark.parametrize("days, gap", [(0, 0.01), (10, 0.01), (3, 0.5), (30, 0.001)])
def test_ratio_band(spark, days, gap):
    rng = random.Random(days)
    side = lambda n: [(rng.choice("ab"), dt.date(2019, 12, 25) + dt.timedelta(rng.randint(0, 40)), rng.choice([0.5, 0.505, 0.495, 0.5 * (1 + gap), 0.5 * (1 - gap), rng.uniform(0.4, 0.6), 7.0, 0.0, -1.0]), i) for i in range(n)]
    a, b = side(120), side(120)
    fields = "k string, d date, q double, i int"
    got = sorted((r.i, r.other_i) for r in temporal.ratio_band(spark.createDataFrame(a, fields), spark.createDataFrame(b, fields), "k", "d", "q", days, gap).collect())
    want = sorted((x[3], y[3]) for x in a for y in b if x[0] == y[0] and x[2] > 0 and y[2] > 0 and abs((x[1] - y[1]).days) <= days and abs(y[2] - x[2]) / x[2] <= gap)
    assert got == want and want


def test_first_rows(spark):
    rng = random.Random(3)
    rows = [(rng.choice("abc"), rng.randint(0, 9), i) for i in range(500)]
    frame = spark.createDataFrame(rows, "k string, v int, i int").repartition(7)
    got = sorted(map(tuple, temporal.first_rows(frame, ["k"], [F.desc("v"), F.col("i")], 5).collect()))
    assert got == sorted(r for k in "abc" for r in sorted((x for x in rows if x[0] == k), key=lambda r: (-r[1], r[2]))[:5])
    assert temporal.first_rows(frame.limit(0), ["k"], [F.col("i")], 5).collect() == []


def test_merge_append(spark, tmp_path):
    path, fields = f"{tmp_path}/t", "k long, d string, v string"
    frame = lambda *rows: spark.createDataFrame(list(rows), fields)
    merge = lambda rows, **kw: maintenance.merge_append(spark, path, frame(*rows), ["k"], **kw)
    held = lambda: sorted(map(tuple, spark.read.parquet(path).collect()))
    assert merge([(1, "a", "x"), (2, "a", "y"), (2, "b", "z")], sort_by=["d"]) == {"rows": 2, "added": 2, "changed": 0, "written": True}
    assert held() == [(1, "a", "x"), (2, "b", "z")]
    stamps = {f: f.stat().st_mtime_ns for f in tmp_path.glob("t/*.parquet")}
    assert merge([(1, "a", "x")]) == {"rows": 2, "added": 0, "changed": 0, "written": False}
    assert {f: f.stat().st_mtime_ns for f in tmp_path.glob("t/*.parquet")} == stamps  # not touched
    assert merge([(1, "c", "new"), (3, "c", None)], keep="first") == {"rows": 3, "added": 1, "changed": 0, "written": True}
    assert held() == [(1, "a", "x"), (2, "b", "z"), (3, "c", None)]
    assert merge([(3, "c", None), (1, "c", "new")]) == {"rows": 3, "added": 0, "changed": 1, "written": True}
    assert held() == [(1, "c", "new"), (2, "b", "z"), (3, "c", None)]
    twice = [merge([(4, "e", "p"), (4, "e", "q")][::s])["rows"] and held()[-1] for s in (1, -1)]
    assert twice[0] == twice[1]  # the same of two rows without an order
    with pytest.raises(ValueError):
        maintenance.replace_table(spark, path, frame((1, "a", "x")))
    maintenance.replace_table(spark, path, frame((1, "a", "x")), fewer=True)
    assert held() == [(1, "a", "x")]


def test_asof_variants_lie_on_one_line(spark):
    left = spark.createDataFrame([(k, i) for k in (1, 2, 3) for i in range(9)], "k int, d int")
    right = spark.createDataFrame([(1, 2, 0.2), (1, 5, 0.5), (2, 0, 1.0), (2, 8, 1.8)], "k int, d int, v double")
    asked = {"at": {}, "strict": {"strict": True}, "ahead": {"forward": True}, "after": {"forward": True, "strict": True}, "filled": {"first_as_fallback": True, "default": 9.0}}
    found = temporal.asof_joins(left, right, "k", "d", "v", asked, 3)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2
    for r in found.collect():
        own = [(d, v) for k, d, v in ((1, 2, 0.2), (1, 5, 0.5), (2, 0, 1.0), (2, 8, 1.8)) if k == r.k]
        last, first = lambda x: x[-1][1] if x else None, lambda x: x[0][1] if x else None
        at = last([x for x in own if x[0] <= r.d])
        want = (at, last([x for x in own if x[0] < r.d]), first([x for x in own if x[0] >= r.d]), first([x for x in own if x[0] > r.d]), at or first(own) or 9.0)
        assert (r["at"], r.strict, r.ahead, r.after, r.filled) == want
