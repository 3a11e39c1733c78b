"""Every analytics query against its SQL in DuckDB, and hand-made cases for some operators."""

import datetime as dt
import math

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.operators import inference, maintenance, simulate, temporal
from tidemill.plans import actions, audits, catalogue, factors, indicators, indices, metrics, pools, quality, reads, research, trading, trials  # noqa: F401  register their queries
from tidemill.sources.tables import union_all

SF = "/root/testdata/sf0.001"
LARGER = {"micro_index_daily", "micro_index_held", "four_factor_ols"}  # need some hundred names a month, or symbols each day


def plain(rows):
    same = lambda x: None if isinstance(x, float) and math.isnan(x) else round(float(x), 3) + 0.0 if isinstance(x, float) else x
    return sorted((tuple(same(x) for x in r) for r in rows), key=str)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_against_sql(spark, name):
    sf = SF.replace("0.001", "0.01") if name in LARGER else SF
    df = catalogue.QUERIES[name](spark, sf)
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in ("orders", "lineitem", "part", "region", "nation", "events", "customer", "supplier", "documents", "labels", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    want = con.execute(catalogue.ORACLE_SQL[name])
    columns = [c[0] for c in want.description]
    assert sorted(columns) == sorted(df.columns)
    got, want = plain(map(tuple, df.select(columns).collect())), plain(want.fetchall())
    assert len(got) == len(want) and len(got) > 0
    wrong = [(a, b) for a, b in zip(got, want) if not all(x == y or isinstance(x, float) and isinstance(y, float) and abs(x - y) < 2e-3 * max(1, abs(x)) for x, y in zip(a, b))]
    assert not wrong, wrong[:3]


def test_fifo(spark):
    rows = [("s", 1, "buy", 100), ("s", 2, "buy", 50), ("s", 3, "sell", 120), ("s", 4, "buy", 10), ("s", 5, "sell", 40)]
    got = simulate.fifo_pairs(spark.createDataFrame(rows, "symbol string, fill_id long, side string, qty long")).collect()
    assert sorted((r.buy_id, r.sell_id, r.qty) for r in got) == [(1, 3, 100), (2, 3, 20), (2, 5, 30), (4, 5, 10)]


def test_equal_weight_runs(spark):
    """Day by day in plain Python: last prices, whole lots on a month's first day, fees."""
    con = duckdb.connect()
    bars = con.execute(f"SELECT s_nationkey, l_suppkey, CAST(l_shipdate AS DATE), round(sum(l_extendedprice) / sum(l_quantity), 6) FROM '{SF}/lineitem.parquet' JOIN '{SF}/supplier.parquet' ON s_suppkey = l_suppkey GROUP BY 1, 2, 3 ORDER BY 1, 3, 2").fetchall()
    want = {}
    for run in {b[0] for b in bars}:
        money, held, last, month = 1e6, {}, {}, None
        own = [b for b in bars if b[0] == run]
        for d in sorted({b[2] for b in own}):
            last |= {b[1]: b[3] for b in own if b[2] == d}
            if (d.year, d.month) != month:
                month, value = (d.year, d.month), money + sum(held.get(s, 0) * p for s, p in last.items())
                for s, p in last.items():
                    target = value / len(last) / p // 100 * 100
                    trade = target - held.get(s, 0)
                    money -= trade * p + (max(5.0, abs(trade * p) * 2.5e-4) if trade else 0) + max(0.0, -trade * p) * 0.001
                    held[s] = target
            want[run, d] = money + sum(held[s] * last[s] for s in held)
    got = {(r.run_id, r.d): r.nav for r in catalogue.QUERIES["equal_weight_runs"](spark, SF).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 0.02 for k in want)


def test_resampling(spark):
    """Seeded draws: the same twice; ends around the mean; a clear mean is rare under sign flips."""
    rows = spark.createDataFrame([(s, dt.date(2020, 1, 1) + dt.timedelta(i), (0.5 if s == 1 else 0.0) + math.sin(i * 7.3)) for s in (1, 2) for i in range(300)], "symbol long, d date, r double")
    a, b = ([{r.symbol: r for r in inference.bootstrap_mean(rows, 400, 7).collect()} for _ in range(2)])
    assert a == b and all(r.lo < r.mean < r.hi for r in a.values())
    spread = 0.7071 / 300**0.5
    assert all(abs((r.hi - r.lo) / (2 * 1.645 * spread) - 1) < 0.2 for r in a.values())
    p = {r.symbol: r for r in inference.sign_test(rows, 400, 7).collect()}
    assert p[1].p < 0.01 and p[1].place > 0.99 and p[2].p > 0.1


def test_nearest_keeps_repeated_rows(spark):
    a = spark.createDataFrame([(1, dt.date(2020, 1, 9))] * 2 + [(2, dt.date(2020, 1, 9))], "k long, d date")
    b = spark.createDataFrame([(1, dt.date(2020, 1, 7), "x"), (1, dt.date(2020, 1, 7), "w"), (1, dt.date(2020, 1, 1), "y"), (2, dt.date(2020, 1, 10), "z")], "k long, od date, v string")
    got = temporal.nearest_before(a, b, "k", "d", "od", 5, [F.col("v")]).collect()
    assert [tuple(r) for r in got] == [(1, dt.date(2020, 1, 9), dt.date(2020, 1, 7), "w")] * 2


def test_table_upkeep(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", dt.date(2020, 1, 1)), (2, "b", None)], "k long, g string, d date").withColumn("e", F.lit(dt.date(2021, 5, 1)))
    rows.write.parquet(f"{tmp_path}/flat")
    assert maintenance.to_year_partitions(spark, f"{tmp_path}/flat", f"{tmp_path}/years", ["d", "e"], dry_run=True) == 2
    assert maintenance.to_year_partitions(spark, f"{tmp_path}/flat", f"{tmp_path}/years", ["d", "e"]) == 2
    assert sorted(r.year for r in spark.read.parquet(f"{tmp_path}/years").collect()) == [2020, 2021]
    with pytest.raises(ValueError):
        maintenance.to_year_partitions(spark, f"{tmp_path}/flat", f"{tmp_path}/none", ["d"])
    with pytest.raises(ValueError):
        maintenance.upsert_grouped(spark, f"{tmp_path}/years", rows.select("k", "g"), "g", ["k"])
    for part in ([(1, "a", 1), (2, "b", 2)], [(1, "a", 3)]):
        maintenance.upsert_grouped(spark, f"{tmp_path}/groups", spark.createDataFrame(part, "k long, g string, v long"), "g", ["k"])
    assert sorted((r.k, r.v) for r in spark.read.parquet(f"{tmp_path}/groups").collect()) == [(1, 3), (2, 2)]
    assert not maintenance.exists(spark, f"{tmp_path}/groups_staged")
    a, b = maintenance.aligned([spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([(2.5,)], "n double")])
    assert a.schema == b.schema and b.collect()[0].s is None
    source = spark.createDataFrame([(1, "x"), (1, "x"), (2, "y")], "code long, name string")
    assert sorted(map(tuple, maintenance.normalized(source, {"code": "k"}, "d", "2020-02-03").collect())) == [(1, "x", dt.date(2020, 2, 3)), (2, "y", dt.date(2020, 2, 3))]


def test_upsert_by_year(spark, tmp_path):
    day = lambda y, v: (dt.date(y, 1, 2), v)
    for rows in ([day(2020, 1), day(2021, 2)], [day(2021, 3), day(2022, 4)]):
        maintenance.upsert_by_year(spark, f"{tmp_path}/t", spark.createDataFrame(rows, "d date, v long"), ["d"], "d")
    assert sorted(r.v for r in spark.read.parquet(f"{tmp_path}/t").collect()) == [1, 3, 4]
    with pytest.raises(ValueError):
        maintenance.upsert_by_year(spark, f"{tmp_path}/t", spark.createDataFrame([(None, 1)], "d date, v long"), ["d"], "d")


def test_union_all(spark):
    a, b = spark.createDataFrame([(1, "x")], "n int, s string"), spark.createDataFrame([("y", 2.5)], "s string, n double")
    assert sorted(map(tuple, union_all([a, b]).collect())) == [(1.0, "x"), (2.5, "y")]
    with pytest.raises(TypeError):
        union_all([a, spark.createDataFrame([(1,)], "s int")])
