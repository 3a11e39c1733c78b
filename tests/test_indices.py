"""Carried membership and incremental tables against plain loops."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import index, maintenance


def looped(rows, k, least, survivors, monthly):
    """The rules day by day."""
    days = {}
    for d, p, s, size, ret in rows:
        days.setdefault(d, []).append((size, s, ret, p))
    out, held, period, nav = [], None, None, 1.0
    for d in sorted(days):
        own = days[d]
        if len(own) < least:
            continue
        chosen, p = {s for _, s, *_ in sorted(own)[:k]}, own[0][3]
        if held is None or monthly and p != period:
            held, period = chosen, p
            continue
        met = [r for _, s, r, _ in own if s in held]
        if len(met) < survivors:
            held = chosen
            continue
        nav *= 1 + sum(met) / len(met)
        out.append((d, round(sum(met) / len(met), 9), len(met), round(nav, 9)))
        if not monthly:
            held = chosen
    return out


def panel(seed, days=40):
    rng = random.Random(seed)
    out = []
    for i in range(days):
        n = rng.choice([3, 20, 40, 60])
        for s in rng.sample(range(80), n):
            out.append((dt.date(2020, 1, 1) + dt.timedelta(i), i // 7, s, rng.choice([1, 2, 2, 2, 3, 1000, 10**9]) * (1 + s % 3), rng.uniform(-0.2, 0.2)))
    return out


@pytest.mark.parametrize("seed", range(3))
def test_carried_index(spark, seed):
    rows = panel(seed)
    frame = spark.createDataFrame(rows, "d date, p int, symbol long, size long, ret double").repartition(6)
    for monthly in (False, True):
        for k, least, survivors in ((10, 15, 3), (10, 15, 6), (30, 1, 1), (200, 5, 2)):
            got = index.carried_index(frame, k, least, survivors, "p" if monthly else None).orderBy("d").collect()
            want = looped(rows, k, least, survivors, monthly)
            assert [(r.d, round(r.ret, 9), r.n, round(r.nav, 9)) for r in got] == want
    assert want and index.carried_index(frame.where("ret > 5"), 5, 5, 5, "p").collect() == []


def test_smallest(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([1e-9, 0.5, 7.0, 7.0, 7.0, 7.1, 1e12])) for g in range(4) for i in range(300 * g + 3)]
    frame = spark.createDataFrame(rows, "g int, i long, v double").repartition(9)
    for k in (1, 5, 100, 5000):
        got = sorted(map(tuple, index.smallest(frame, "g", "v", "i", k).collect()))
        assert got == sorted(r for g in range(4) for r in sorted((x for x in rows if x[0] == g), key=lambda r: (r[2], r[1]))[:k])


def test_fill_days(spark, tmp_path):
    path, day = f"{tmp_path}/t", lambda m, d: dt.date(2020, m, d)
    days = [day(m, d) for m in (1, 2, 3) for d in range(1, 11)]
    asked = []

    def compute(missing, mark):
        asked.append(sorted(r.d for r in missing.collect()))
        return missing.select("d", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("symbol")).withColumn("mark", F.lit(mark))

    unit = F.trunc("d", "month")
    frame = lambda some: spark.createDataFrame([(d,) for d in some], "d date")
    first = [d for d in days if d.month < 3 and d.day != 4]
    assert maintenance.fill_days(spark, path, frame(first), lambda m: compute(m, 1), unit) == 18
    files = {str(f): f.stat().st_mtime_ns for f in tmp_path.glob("t/unit=2020-0[12]*/*.parquet")}
    late = [d for d in days if d != day(2, 4)]  # January and March have gaps, February has none asked for
    assert maintenance.fill_days(spark, path, frame(late), lambda m: compute(m, 2), unit) == 11
    assert asked == [first, [day(1, 4), *(day(3, d) for d in range(1, 11))]]
    kept = {str(f): f.stat().st_mtime_ns for f in tmp_path.glob("t/unit=2020-02*/*.parquet")}
    assert kept == {k: v for k, v in files.items() if "2020-02" in k}  # untouched
    rows = spark.read.parquet(path).collect()
    assert sorted((r.d, r.symbol, r.mark) for r in rows) == sorted((d, s, 1 if d in first else 2) for d in late for s in "ab")
    assert maintenance.fill_days(spark, path, frame(late), lambda m: compute(m, 3), unit) == 0 and len(asked) == 2
    assert maintenance.fill_days(spark, path, frame([]), lambda m: compute(m, 3), unit) == 0
    assert not maintenance.exists(spark, f"{path}_staged")


def test_limit_states_read_the_market_once(spark, monkeypatch):
    """Both runs read the market as it was written once, not the lines it is made of."""
    from tidemill.plans import indices

    fill, seen = indices.maintenance.fill_days, []

    def watched(spark, path, days, compute, unit):
        seen.extend(f for x in (days, compute(days)) for f in x.inputFiles())
        return fill(spark, path, days, compute, unit)

    monkeypatch.setattr(indices.maintenance, "fill_days", watched)
    assert {r.run for r in indices.limit_state_table(spark, "/root/testdata/sf0.001").select("run").distinct().collect()} == {1, 2}
    assert seen and all("/market/" in f for f in seen)
