"""Significance and resampling against plain Python."""

import datetime as dt
import math
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemill.operators import inference as I
from tidemill.plans.trials import near_points

NORMAL = statistics.NormalDist()


def test_normal_law(spark):
    z = [i / 7 for i in range(-70, 71)] + [0.0, 1e-9, 7.0710678, 7.08, -7.08]
    for r in spark.createDataFrame([(x,) for x in z], "z double").select("z", I.normal_cdf(F.col("z")).alias("p")).collect():
        assert abs(r.p - 0.5 * math.erfc(-r.z / 2**0.5)) < 1e-13
    p = [1e-9, 0.001, 0.02425, 0.03, 0.5, 0.9, 0.97575, 0.99, 0.999999, 0.0, 1.0]
    for r in spark.createDataFrame([(x,) for x in p], "p double").select("p", I.normal_quantile(F.col("p")).alias("z")).collect():
        assert r.z is None if r.p in (0.0, 1.0) else abs(r.z - NORMAL.inv_cdf(r.p)) < 1e-8


def series(seed, n, shift=0.0):
    rng = np.random.default_rng(seed)
    return [float(x) for x in rng.standard_t(5, n) * 0.01 + shift]


def frame(spark, groups):
    rows = [(g, dt.date(2020, 1, 1) + dt.timedelta(i), v) for g, own in groups.items() for i, v in enumerate(own)]
    return spark.createDataFrame(rows, "g string, d date, r double").repartition(5)


@pytest.mark.parametrize("trials", [1, 2, 10, 1000])
def test_significance(spark, trials):
    groups = {"a": series(1, 300, 0.001), "b": series(2, 40, -0.002), "short": [0.1, 0.2], "still": [0.01] * 9, "n": [None, float("nan"), 0.1, 0.2, 0.4]}
    found = {r.g: r for r in I.significance(I.sharpe_moments(frame(spark, groups), ["g"], "r"), F.lit(trials)).collect()}
    assert found["short"].psr is None and found["short"].n == 2 and found["n"].n == 3
    assert found["still"].psr is None or abs(found["still"].sr) > 1e6  # a deviation of rounding alone
    for g in ("a", "b"):
        x = groups[g]
        n, m = len(x), sum(x) / len(x)
        m2, m3, m4 = (sum((v - m) ** k for v in x) / n for k in (2, 3, 4))
        sr, skew, kurt = m / m2**0.5, m3 / m2**1.5, m4 / m2**2
        se = math.sqrt((1 - skew * sr + (kurt - 1) / 4 * sr * sr) / (n - 1))
        best = 0.0 if trials == 1 else se * ((1 - I.EULER) * NORMAL.inv_cdf(1 - 1 / trials) + I.EULER * NORMAL.inv_cdf(1 - 1 / (trials * math.e)))
        assert np.allclose([found[g].sr, found[g].se, found[g].psr, found[g].dsr], [sr, se, NORMAL.cdf(sr / se), NORMAL.cdf((sr - best) / se)], atol=1e-8)


def test_near_points():
    assert near_points(3, 40) == [("fast", 2), ("fast", 4), ("slow", 36), ("slow", 44), ("slow", 32), ("slow", 48), ("slow", 26), ("slow", 54)]
    assert near_points(1, 10)[:1] == [("slow", 9)]


def bits(key, rep):
    """The draw of a key and replicate in whole numbers."""
    mask = (1 << 64) - 1
    x = (key + rep * 0x9E3779B97F4A7C15) & mask
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return x ^ (x >> 31)


def poisson(u):
    k, p, total = 0, math.exp(-1), math.exp(-1)
    while u >= total and k < 20:
        k += 1
        p /= k
        total += p
    return k


def nearest(values, q):
    return sorted(values)[max(0, math.ceil(q * len(values)) - 1)]


def sharpe(w, x):
    n = sum(w)
    m = sum(a * b for a, b in zip(w, x)) / n
    return m / math.sqrt((sum(a * b * b for a, b in zip(w, x)) - n * m * m) / (n - 1)) * 252**0.5


def test_bootstrap(spark):
    rows = frame(spark, {"a": series(3, 120, 0.002), "b": series(4, 60), None: series(5, 30), "gone": [-1.0, 0.5, 0.2]})
    keyed = rows.select("g", "d", "r", F.xxhash64("g", "d", F.lit(7)).alias("k")).collect()
    for mb in (64, 0):
        sums = I.replicate_sums(rows, "g", "r", ["g", "d"], 60, 7, "poisson", mb)
        again = sums.count()
        found = {(r.g, r.statistic): r for r in I.intervals(sums, "g").collect()}
        assert again == 4 * 61 and len(found) == 12
        for g in ("a", "b", None):
            own = [r for r in keyed if r.g == g]
            x = [r.r for r in own]
            w = [[1] * len(x)] + [[poisson((bits(r.k & ((1 << 64) - 1), rep) >> 11) / 2**53) for r in own] for rep in range(1, 61)]
            made = {
                "mean": [sum(a * b for a, b in zip(v, x)) / sum(v) for v in w],
                "sharpe": [sharpe(v, x) for v in w],
                "annual": [math.prod((1 + b) ** a for a, b in zip(v, x)) ** (252 / sum(v)) - 1 for v in w],
            }
            for s, v in made.items():
                r = found[g, s]
                want = [v[0], *(nearest(v[1:], q) for q in (0.05, 0.5, 0.95, 0.025, 0.975))]
                assert np.allclose([r.observed, r.p05, r.p50, r.p95, r.lo, r.hi], want, rtol=1e-5, atol=1e-7), (g, s)
                assert r.crosses_zero == (want[4] <= 0 <= want[5])
        assert found["gone", "annual"].observed is None and found["gone", "mean"].observed is not None
    assert not found["a", "mean"].crosses_zero or found["b", "mean"].crosses_zero


def test_sign_flips(spark):
    rows = frame(spark, {"a": series(6, 80, 0.004), "b": series(7, 80)})
    keyed = rows.select("g", "d", "r", F.xxhash64("g", "d", F.lit(9)).alias("k")).collect()
    for r in I.sign_flips(rows, "g", "r", ["g", "d"], 100, 9).collect():
        own = [x for x in keyed if x.g == r.g]
        null = []
        for rep in range(1, 101):
            x = [v.r * (-1 if bits(v.k & ((1 << 64) - 1), rep) >> 63 else 1) for v in own]
            null.append(sharpe([1] * len(x), x))
        seen = sharpe([1] * len(own), [v.r for v in own])
        assert abs(r.observed - seen) < 1e-4 and abs(r.p - np.mean(np.abs(null) >= abs(seen))) < 0.011 and abs(r.place - np.mean(np.array(null) < seen)) < 0.011


def fall(x):
    nav = peak = 1.0
    worst = 0.0
    for v in x:
        nav *= 1 + v
        peak = max(peak, nav)
        worst = min(worst, nav / peak - 1)
    return worst


def test_order(spark):
    """Own order first; the others are permutations, spread as shuffles of Python's own are."""
    x = sorted(series(8, 40))
    rows = frame(spark, {"a": x})
    found = {r.rep: r.v for r in I.shuffled_drawdowns(rows, "g", "r", "d", 300, 1).collect()}
    assert len(found) == 301 and abs(found[0] - fall(x)) < 1e-9
    rng = np.random.default_rng(1)
    other = [fall(rng.permutation(x)) for _ in range(2000)]
    assert abs(np.median([v for k, v in found.items() if k]) - np.median(other)) < 0.15 * abs(np.median(other))
    p = I.order_test(rows, "g", "r", "d", 300, 1).first()
    assert p.p == 0.0 and p.place == 0.0  # all losses first is the worst order
    order = spark.createDataFrame([("a", dt.date(2020, 1, i + 1), i) for i in range(12)], "g string, d date, i int")
    orders = {tuple(r.i for r in order.orderBy(F.xxhash64("g", "d", F.lit(rep), F.lit(1))).collect()) for rep in range(8)}
    assert len(orders) == 8


def test_order_is_that_of_the_hashes(spark):
    """The same orders as windows over rows repeated by replicate have; and no step repeats rows before a shuffle."""
    rows = frame(spark, {"a": series(8, 40), None: series(9, 25), "gone": [-1.5, 0.2, -1.0]})
    found = {(r.g, r.rep): r.v for r in I.shuffled_drawdowns(rows, "g", "r", "d", 12, 7).collect()}
    laid = rows.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(12)))).withColumn("h", F.when(F.col("rep") > 0, F.xxhash64("g", "d", "rep", F.lit(7)))).orderBy("g", "rep", "h", "d").collect()
    want = {k: fall([max(r.r, -1 + 1e-12) for r in laid if (r.g, r.rep) == k]) for k in {(r.g, r.rep) for r in laid}}
    assert found.keys() == want.keys() and all(abs(found[k] - want[k]) < 1e-9 for k in want)
    plan = I.shuffled_drawdowns(rows, "g", "r", "d", 12, 7)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and "Window" not in plan


def test_weights():
    """Poisson numbers by table equal those by search, at the bounds of numbers too; whole numbers are cut and put together."""
    edges = (I.POISSON[:18] * 2**53).astype(np.uint64)
    bits = np.concatenate([np.random.default_rng(1).integers(0, 2**64, 200_000, np.uint64), *((edges + np.uint64(k)) << np.uint64(11) for k in (0, 1)), (edges - np.uint64(1)) << np.uint64(11)])
    assert np.array_equal(I.weights(bits, "poisson"), [np.searchsorted(I.POISSON, float(b >> np.uint64(11)) / 2**53, "right") for b in bits])
    x = np.array([0, 1, -1, 2**40 + 7, -(2**45) - 3, 2**62, -(2**62) + 1])
    assert np.array_equal(I.put_together(np.stack(I.pieces(x))), x)


def test_random_holdings(spark):
    pool = frame(spark, {"a": series(9, 500)}).drop("g")
    v = [r.sharpe for r in I.random_holdings(pool, "d", "r", 100, 400, 5).collect()]
    own = series(9, 500)
    mean, sd = np.mean(own) / np.std(own) * 252**0.5, (252 / 100) ** 0.5
    assert len(v) == 400 and abs(np.mean(v) - mean) < 4 * sd / 20 and 0.8 < np.std(v) / sd < 1.25
    assert sorted(v) == sorted(r.sharpe for r in I.random_holdings(pool, "d", "r", 100, 400, 5).collect())
    assert I.random_holdings(pool.where("r > 9"), "d", "r", 5, 3, 1).collect() == []


def test_strategy_returns_spread_days_alone(spark):
    from tidemill.plans.trials import strategy_returns

    plan = strategy_returns(spark, "/root/testdata/sf0.001", [(3, 10), (5, 20)])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning(symbol") == 1
    assert plan.index("Generate explode") < plan.index("HashAggregate")  # rows are spread after they are added up
