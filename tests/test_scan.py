"""Scans, running cost and lots against plain loops."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import holdings, scan, simulate


@pytest.mark.parametrize("chunk", [1, 2, 5, 256])
def test_affine_scan(spark, chunk):
    rng = random.Random(chunk)
    n = {"a": 23, "b": 1, None: 9}
    rows = [(g, i, rng.choice([0.0, 0.5, 1.0, -0.7]), rng.uniform(-1, 1), f"{g}{i}") for g, k in n.items() for i in range(k)]
    frame = spark.createDataFrame(rows, "g string, i int, a double, b double, `x.y` string").repartition(5)
    got = {(r.g, r.i): (r.x, r["x.y"]) for r in scan.affine_scan(frame, ["g"], [F.col("i")], F.col("a"), F.col("b"), "x", 2.0, chunk).collect()}
    assert len(got) == 33
    for g in n:
        x = 2.0
        for _, i, a, b, name in sorted(r for r in rows if r[0] == g):
            assert abs(got[g, i][0] - x) < 1e-12 and got[g, i][1] == name
            x = a * x + b


def walked(raws, confirm, recovery):
    phase, n, out = "IDLE", 0, []
    for raw in raws:
        n += 1
        if raw == "CRISIS" or (raw == "WATCH" and phase != "IDLE"):
            phase, n, now = "CONFIRM", 0, "CRISIS"
        elif raw == "WATCH":
            phase, n, now = "IDLE", 0, "WATCH"
        elif phase == "CONFIRM" and n < confirm:
            now = "CRISIS"
        elif phase == "CONFIRM":
            phase, n, now = "RECOVERY", 0, "RECOVERY"
        elif phase == "RECOVERY" and n < recovery:
            now = "RECOVERY"
        else:
            phase, n, now = "IDLE", 0, "NORMAL"
        out.append(now)
    return out


@pytest.mark.parametrize("confirm, recovery", [(3, 3), (1, 1), (2, 5)])
def test_liquidity_states(spark, confirm, recovery):
    rng = random.Random(confirm)
    raws = {m: rng.choices(["NORMAL", "WATCH", "CRISIS"], [6, 1, 1], k=700 if m == "x" else 30) for m in ("x", "y")}
    rows = [(m, dt.date(2020, 1, 1) + dt.timedelta(i), r) for m, own in raws.items() for i, r in enumerate(own)]
    frame = spark.createDataFrame(rows, "market string, d date, raw string").repartition(3)
    got = simulate.liquidity_states(frame, confirm, recovery, by="market").orderBy("market", "d").collect()
    for m in raws:
        assert [r.status for r in got if r.market == m] == walked(raws[m], confirm, recovery)
    one = simulate.liquidity_states(frame.where("market = 'y'").drop("market"), confirm, recovery).orderBy("d").collect()
    assert [r.status for r in one] == walked(raws["y"], confirm, recovery) and one[0].asDict().keys() == {"d", "raw", "status"}


def random_fills(seed):
    rng = random.Random(seed)
    out = []
    for s in range(4):
        for i in range(rng.randint(1, 60)):
            out.append((s, i, dt.date(2020, 1, 1) + dt.timedelta(i // 3), rng.random() < 0.55, rng.choice([1, 7, 100, 300]), round(rng.uniform(1, 20), 2), round(rng.uniform(0, 5), 2)))
    return out


FILL = "symbol long, seq long, d date, sell boolean, qty long, price double, fee double"


@pytest.mark.parametrize("seed", range(3))
def test_running_cost(spark, seed):
    rows = random_fills(seed)
    got = {(r.symbol, r.seq): r for r in holdings.running_cost(spark.createDataFrame(rows, FILL).repartition(4)).collect()}
    for s in range(4):
        held, avg, realized = 0, 0.0, 0.0
        for _, i, _, sell, q, p, fee in (r for r in rows if r[0] == s):
            if sell:
                done = min(held, q)
                realized += (p - avg) * done - fee * done / q
                held -= done
                avg = avg if held else 0.0
            else:
                avg, held = (avg * held + p * q + fee) / (held + q), held + q
            r = got[s, i]
            assert r.held == held and np.allclose([r.avg_cost, r.realized], [avg, realized], atol=1e-7)


def looped_trades(rows, events):
    out = []
    for s in {r[0] for r in rows}:
        lots, marks = [], sorted(e for e in events if e[0] == s and e[2] > 0 and e[2] != 1)
        for _, i, d, sell, q, p, fee in (r for r in rows if r[0] == s):
            while marks and marks[0][1] <= d:
                ratio = marks.pop(0)[2]
                for lot in lots:
                    raw = int(lot[1] * ratio)
                    if raw <= 0:
                        lot[1], lot[3] = 1, 1.0
                    else:
                        lot[1], lot[2], lot[3] = raw, lot[2] / ratio, lot[3] * ratio
            if not sell:
                lots.append([i, q, p, float(q), fee])
                continue
            left = q
            while left and lots:
                lot = lots[0]
                n = min(left, lot[1])
                out.append((s, lot[0], i, n, lot[2], p, p * n - fee * n / q - lot[2] * n - lot[4] * n / lot[3]))
                left, lot[1] = left - n, lot[1] - n
                if not lot[1]:
                    lots.pop(0)
    return sorted(out)


@pytest.mark.parametrize("seed", range(2))
def test_fifo_trades(spark, seed):
    rows = random_fills(10 + seed)
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    events = [(0, day(4), 0.1), (0, day(9), 0.003), (1, day(0), 2.5), (1, day(5), 1.0), (2, day(6), 0.37), (2, day(7), 3.0), (9, day(1), 0.5)]
    frame, marks = spark.createDataFrame(rows, FILL).repartition(4), spark.createDataFrame(events, "symbol long, ex date, ratio double")
    for own, e in ((marks, events), (marks.where("symbol > 50"), [])):
        got = sorted(tuple(r) for r in holdings.fifo_trades(frame, own).collect())
        want = looped_trades(rows, e)
        assert [g[:4] for g in got] == [w[:4] for w in want] and want
        assert np.allclose([g[4:] for g in got], [w[4:] for w in want], atol=1e-7)


def test_fifo_pairs_in_one_shuffle(spark):
    """Fills without shares, equal bounds and purchases left over pair as a loop does; no join, one shuffle."""
    from tidemill.operators import simulate

    rows = [("a", 1, "buy", 5), ("a", 2, "buy", 0), ("a", 3, "buy", 7), ("a", 4, "sell", 5), ("a", 5, "sell", 0), ("a", 6, "sell", 3), ("a", 7, "buy", 9), ("b", 1, "buy", 4)]
    pairs = simulate.fifo_pairs(spark.createDataFrame(rows, "symbol string, fill_id long, side string, qty long"))
    assert sorted(map(tuple, pairs.collect())) == [("a", 1, 4, 5), ("a", 3, 6, 3)]
    plan = pairs.select("*")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_affine_pair_takes_one_pass(spark):
    rows = [(g, i, float(i % 5) - 1.5, None if (g, i) == ("b", 3) else 0.25 * i) for g in ("a", "b") for i in range(40)]
    frame = spark.createDataFrame(rows, "g string, i int, a double, b double").repartition(3)
    a = F.when(F.col("i") % 7 == 0, 0.0).otherwise(F.col("a") / 2)
    found = scan.affine_pair(frame, ["g"], [F.col("i")], (a, F.col("b")), (F.lit(0.5), F.col("a"), F.lit(1.0)), ("x", "y"), (2.0, 3.0), 4)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    got = {(r.g, r.i): (r.x, r.y) for r in found.collect()}
    assert got["b", 4][0] is None and got["b", 5][1] is None and got["b", 8][0] is not None  # a null goes on until a map leaves the state out
    for g in ("a", "b"):
        x, y = 2.0, 3.0
        for _, i, m, n in (r for r in rows if r[0] == g):
            if g == "b" and i > 3:
                break
            assert np.allclose(got[g, i], (x, y), atol=1e-12)
            x, y = (0.0 if i % 7 == 0 else m / 2 * x) + (n or 0.0), 0.5 * y + m * x + 1


def test_kdj_shuffles_once(spark):
    from tidemill.plans.indicators import kdj

    plan = kdj(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


def test_positions_shuffle_once(spark):
    from tidemill.plans.trading import positions

    plan = positions(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
