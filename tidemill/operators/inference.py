"""Normal law, significance of Sharpe ratios among many trials, and seeded resampling.

Resampling never multiplies the data by the number of replicates: a task adds each row's part to the
sums of all replicates of its group, as arrays, and only these sums are shuffled. Draws are hashes of a
row's key and the replicate's number, so a task that runs again draws the same. Sums are whole numbers
(units of 2**-32), so they don't hang on the order of rows. The order of days, where it counts, is
shuffled by sorting each replicate's hashes.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Coefficients, from the highest power down, of the rational approximations to the normal
#: law (to 1e-15, |z| < 7.07) and to its quantiles (to 1.2e-9), and Euler's constant.
LAW_OVER = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
LAW_UNDER = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
LAW_END = 7.07106781186547
MIDDLE_OVER = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239e00)
MIDDLE_UNDER = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
TAIL_OVER = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e00, -2.549732539343734e00, 4.374664141464968e00, 2.938163982698783e00)
TAIL_UNDER = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e00, 3.754408661907416e00, 1.0)
TAIL = 0.02425
EULER = 0.5772156649015329


def polynomial(x: Column, coefficients: tuple) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + c
    return out


def normal_cdf(z: Column) -> Column:
    x = F.abs(z)
    near = polynomial(x, LAW_OVER) / polynomial(x, LAW_UNDER)
    far = 1 / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65))))) / 2.506628274631
    tail = F.exp(-x * x / 2) * F.when(x < LAW_END, near).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def normal_quantile(p: Column) -> Column:
    """The value that a share p of the normal law lies below; null outside of (0, 1)."""
    tail = lambda q: polynomial(q, TAIL_OVER) / polynomial(q, TAIL_UNDER)
    q = p - 0.5
    middle = polynomial(q * q, MIDDLE_OVER) * q / polynomial(q * q, MIDDLE_UNDER)
    low, high = F.sqrt(-2 * F.log(p)), F.sqrt(-2 * F.log(1 - p))
    return F.when((p <= 0) | (p >= 1), None).when(p < TAIL, tail(low)).when(p > 1 - TAIL, -tail(high)).otherwise(middle)


def sharpe_moments(rows: DataFrame, by: list[str], r: str) -> DataFrame:
    """by, n, sr (mean over population deviation), skew, kurt (3 for the normal law), in one aggregate;
    null but for n where fewer than three returns or none that differ are there."""
    m = rows.dropna(subset=[r]).groupBy(*by).agg(F.count("*").alias("n"), F.avg(r).alias("mean"), F.stddev_pop(r).alias("sd"), F.skewness(r).alias("skew"), (F.kurtosis(r) + 3).alias("kurt"))
    known = (F.col("n") >= 3) & (F.col("sd") > 0)
    return m.select(*by, "n", *(F.when(known, e).alias(c) for c, e in {"sr": F.col("mean") / F.nullif("sd", F.lit(0.0)), "skew": F.col("skew"), "kurt": F.col("kurt")}.items()))


def sharpe_error() -> Column:
    """Standard error of sr by its moments; null where its square is not positive."""
    square = (1 - F.col("skew") * F.col("sr") + (F.col("kurt") - 1) / 4 * F.col("sr") * F.col("sr")) / F.nullif(F.col("n") - 1, F.lit(0))
    return F.when(square > 0, F.sqrt(square))


def best_by_chance(error: Column, trials: Column) -> Column:
    """Expected largest Sharpe ratio of trials that have none; 0 for a single one."""
    n = trials.cast("double")
    largest = (1 - EULER) * normal_quantile(1 - 1 / n) + EULER * normal_quantile(1 - 1 / (n * math.e))
    return F.when(n <= 1, 0.0).otherwise(error * largest)


def significance(moments: DataFrame, trials: Column) -> DataFrame:
    """moments (n, sr, skew, kurt) with se, psr, the chance that the true ratio is above 0, and dsr, above
    the best that so many trials have by chance."""
    m = moments.withColumn("se", sharpe_error())
    return m.withColumns({"psr": normal_cdf(F.col("sr") / F.col("se")), "dsr": normal_cdf((F.col("sr") - best_by_chance(F.col("se"), trials)) / F.col("se"))})


# ---------------------------------------------------------------- resampling

UNIT = float(1 << 32)


def drawn(key: np.ndarray, replicates: np.ndarray) -> np.ndarray:
    """64 seeded bits for every key (rows) and replicate (columns)."""
    x = key.view(np.uint64)[:, None] + (replicates.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(20)])
#: For the first 16 of 53 bits the Poisson number that they leave, or -1 where the other bits decide.
LEAST, MOST = (np.searchsorted(POISSON, (np.arange(1 << 16) * float(1 << 37) + rest) / float(1 << 53), "right") for rest in (0, (1 << 37) - 1))
COUNTS = np.where(LEAST == MOST, LEAST, -1).astype(np.float64)


def weights(bits: np.ndarray, scheme: str) -> np.ndarray:
    """How often a row counts: a Poisson number of mean 1 (`poisson`), or 1 or -1 (`sign`)."""
    if scheme == "poisson":
        out = COUNTS[bits >> np.uint64(48)]
        open_ = out < 0
        if open_.any():
            out[open_] = np.searchsorted(POISSON, (bits[open_] >> np.uint64(11)) / float(1 << 53), "right")
        return out
    return 1.0 - 2.0 * (bits >> np.uint64(63))


PIECE = 21


def pieces(whole: np.ndarray) -> list[np.ndarray]:
    """Three floats that add up to a whole number, of which sums over a block are exact."""
    low = (1 << PIECE) - 1
    return [(whole & low).astype(np.float64), ((whole >> PIECE) & low).astype(np.float64), (whole >> 2 * PIECE).astype(np.float64)]


def put_together(sums: np.ndarray) -> np.ndarray:
    x = sums.astype(np.int64)
    return x[0] + (x[1] << PIECE) + (x[2] << 2 * PIECE)


def replicate_sums(rows: DataFrame, by: str, r: str, key: list[str], times: int, seed: int, scheme: str, held_mb: int = 64) -> DataFrame:
    """by, rep, w, r, rr, log: for every replicate the sums of the weights, of the weighted returns and the
    logarithms of their growth, and of their squares, for which signs don't count. Replicate 0 is the rows themselves. A group with a
    return of -1 or less has no log. A task holds held_mb of sums at most, then sends them."""
    kind = dict(rows.dtypes)[by]
    reps = np.arange(times + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}

        def flush():
            for g, sums in held.items():
                yield pa.RecordBatch.from_pydict({
                    "group": pa.array([g] * len(reps), types), "rep": pa.array(reps, pa.int32()), **{c: pa.array(v) for c, v in zip(("w", "r", "rr", "log", "dead"), sums)},
                })
            held.clear()

        for batch in batches:
            types = batch.schema.field("group").type
            groups, values, keys = batch.column("group"), batch.column("value").to_numpy(zero_copy_only=False), batch.column("key").to_numpy(zero_copy_only=False)
            codes = groups.dictionary_encode()
            names, code = codes.dictionary.to_pylist(), codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            names.append(None)
            order = np.argsort(code, kind="stable")
            step = max(1, (1 << 16) // len(reps))  # a block's weights stay in the cache
            for a in range(0, len(order), step):
                at = order[a : a + step]
                w = weights(drawn(keys[at], reps), scheme)
                w[:, 0] = 1
                v = values[at]
                alive = v > -1
                whole = [np.round(p * UNIT).astype(np.int64) for p in (v, v * v, np.log1p(np.where(alive, v, 0.0)))]
                columns = np.stack([np.ones(len(v)), (~alive).astype(np.float64), *(x for p in whole for x in pieces(p))])
                ends = [*np.flatnonzero(np.diff(code[at])) + 1, len(at)]
                for b, e in zip([0, *ends], ends):
                    sums = columns[:, b:e] @ w[b:e]
                    if scheme == "sign":  # a square, or a dead row, has no sign
                        sums[[1, 5, 6, 7]] = sums[[1, 5, 6, 7], :1]
                    own = np.stack([sums[0].astype(np.int64), *(put_together(sums[i : i + 3]) for i in (2, 5, 8)), sums[1].astype(np.int64)])
                    name = names[code[at[b]]]
                    held[name] = held[name] + own if name in held else own
                if len(held) * len(reps) * 40 > held_mb << 20:
                    yield from flush()
        yield from flush()

    keyed = rows.dropna(subset=[r]).select(F.col(by).alias("group"), F.col(r).cast("double").alias("value"), F.xxhash64(*key, F.lit(seed)).alias("key"))
    parts = keyed.sortWithinPartitions("group").mapInArrow(run, f"group {kind}, rep int, w long, r long, rr long, log long, dead long")
    sums = parts.groupBy("group", "rep").agg(*(F.sum(c).alias(c) for c in ("w", "r", "rr", "log", "dead")))
    unit = lambda c: F.col(c) / UNIT
    return sums.select(F.col("group").alias(by), "rep", "w", unit("r").alias("r"), unit("rr").alias("rr"), F.when(F.col("dead") == 0, unit("log")).alias("log"))


def statistics(sums: DataFrame, n: Column, year: int = 252) -> DataFrame:
    """sums with the yearly sharpe and annual return of n returns; null where they have none."""
    mean = F.col("r") / F.nullif(n, F.lit(0))
    var = (F.col("rr") - F.col("r") * mean) / F.nullif(n - 1, F.lit(0))
    sharpe = F.when((n >= 2) & (var > 0), mean / F.sqrt(F.greatest(var, F.lit(1e-300))) * year**0.5)
    return sums.withColumns({"mean": mean, "sharpe": sharpe, "annual": F.exp(F.col("log") * year / F.nullif(n, F.lit(0))) - 1})


def rank_at(value: str, q: float) -> Column:
    """Nearest rank: the least value that a share q does not exceed."""
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {value})")


def intervals(sums: DataFrame, by: str, alpha: float = 0.05, year: int = 252) -> DataFrame:
    """by, statistic, observed, p05, p50, p95, lo, hi, crosses_zero of the replicates in sums."""
    x = statistics(sums, F.col("w"), year)
    each = x.select(by, "rep", F.explode(F.array(*(F.struct(F.lit(s).alias("statistic"), F.col(s).alias("v")) for s in ("mean", "sharpe", "annual")))).alias("x")).select(by, "rep", "x.*")
    told = each.withColumn("draw", F.when(F.col("rep") > 0, F.col("v")))
    ends = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "lo": alpha / 2, "hi": 1 - alpha / 2}
    out = told.groupBy(by, "statistic").agg(F.max(F.when(F.col("rep") == 0, F.col("v"))).alias("observed"), *(rank_at("draw", q).alias(c) for c, q in ends.items()))
    return out.withColumn("crosses_zero", (F.col("lo") <= 0) & (F.col("hi") >= 0))


def bootstrap(rows: DataFrame, by: str, r: str, key: list[str], times: int, seed: int, alpha: float = 0.05) -> DataFrame:
    """Intervals of mean, Sharpe ratio and annual return by rows that count a Poisson number of times."""
    return intervals(replicate_sums(rows, by, r, key, times, seed, "poisson"), by, alpha)


def sign_flips(rows: DataFrame, by: str, r: str, key: list[str], times: int, seed: int, statistic: str = "sharpe") -> DataFrame:
    """by, observed, p, place: two-sided share of replicates with random signs that are as far from 0, and
    the share below the observed value."""
    n = F.max(F.when(F.col("rep") == 0, F.col("w"))).over(Window.partitionBy(by))
    x = statistics(replicate_sums(rows, by, r, key, times, seed, "sign").withColumn("n", n), F.col("n")).select(by, "rep", F.col(statistic).alias("v"))
    return compared(x, by)


def compared(x: DataFrame, by: str) -> DataFrame:
    """by, observed, p, place of replicates (rep, v) against replicate 0."""
    own = x.withColumn("observed", F.max(F.when(F.col("rep") == 0, F.col("v"))).over(Window.partitionBy(by))).where("rep > 0 and v is not null")
    share = lambda test: F.avg(test.cast("double"))
    return own.groupBy(by).agg(F.first("observed").alias("observed"), share(F.abs("v") >= F.abs("observed")).alias("p"), share(F.col("v") < F.col("observed")).alias("place"))


def hashed_on(key: np.ndarray, number: int) -> np.ndarray:
    """Spark's xxhash64 of one more int, from that of the columns before it."""
    x = key.view(np.uint64) + np.uint64(0x27D4EB2F165667C5 + 4)
    x ^= np.uint64((number & 0xFFFFFFFF) * 0x9E3779B185EBCA87 & (1 << 64) - 1)
    x = ((x << np.uint64(23)) | (x >> np.uint64(41))) * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(0x165667B19E3779F9)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC2B2AE3D27D4EB4F)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x165667B19E3779F9)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def shuffled_drawdowns(rows: DataFrame, by: str, r: str, day: str, times: int, seed: int) -> DataFrame:
    """by, rep, v: the largest drawdown of each replicate's order of days, replicate 0 in their own order.

    The order is that of xxhash64(by, day, rep, seed). Days are shuffled once, not by replicate: a task holds
    the days of one group, and orders them for one replicate after another."""
    step = F.log1p(F.greatest(F.col(r).cast("double"), F.lit(-1 + 1e-12)))
    keyed = rows.dropna(subset=[r]).select(F.col(by).alias("group"), F.col(day).alias("day"), F.xxhash64(by, day).alias("key"), step.alias("step"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("day", "ascending"), ("step", "ascending")])
        keys, steps = table["key"].to_numpy(), table["step"].to_numpy()
        worst = np.empty(times + 1)
        for rep in range(times + 1):
            nav = np.cumsum(steps[np.argsort(hashed_on(hashed_on(keys, rep), seed), kind="stable")] if rep else steps)
            worst[rep] = np.exp(np.min(nav - np.maximum(np.maximum.accumulate(nav), 0.0))) - 1
        return pa.table({"group": pa.array([table["group"][0].as_py()] * len(worst), table.schema.field("group").type), "rep": pa.array(range(times + 1), pa.int32()), "v": worst})

    return keyed.groupBy("group").applyInArrow(run, f"group {dict(rows.dtypes)[by]}, rep int, v double").withColumnRenamed("group", by)


def order_test(rows: DataFrame, by: str, r: str, day: str, times: int, seed: int) -> DataFrame:
    """by, observed, p, place of the largest drawdown among shuffled orders of days."""
    return compared(shuffled_drawdowns(rows, by, r, day, times, seed), by)


def random_holdings(pool: DataFrame, day: str, r: str, n_hold: int, times: int, seed: int) -> DataFrame:
    """rep, sharpe: Sharpe ratios of n_hold days drawn with repeats from a pool, a row a day."""
    numbered = pool.dropna(subset=[r]).select(F.col(r).alias("v"), (F.row_number().over(Window.orderBy(day)) - 1).alias("i"))  # a row a day
    size = numbered.agg(F.count("*").alias("size"))
    picks = pool.sparkSession.range(1, times + 1).select(F.col("id").cast("int").alias("rep")).crossJoin(F.broadcast(size)).where("size > 0")
    picks = picks.withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(n_hold)))).withColumn("i", F.pmod(F.xxhash64("rep", "j", F.lit(seed)), F.col("size")))
    m = picks.join(numbered, "i").groupBy("rep").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("sd"))
    return m.select("rep", F.when(F.col("sd") > 0, F.col("mean") / F.nullif("sd", F.lit(0.0)) * 252**0.5).alias("sharpe"))


def bootstrap_mean(rows: DataFrame, times: int, seed: int) -> DataFrame:
    """symbol, mean, lo, hi: the mean return with its 5 and 95 percent points."""
    x = bootstrap(rows, "symbol", "r", ["symbol", "d"], times, seed).where("statistic = 'mean'")
    return x.select("symbol", F.col("observed").alias("mean"), F.col("p05").alias("lo"), F.col("p95").alias("hi"))


def sign_test(rows: DataFrame, times: int, seed: int) -> DataFrame:
    """symbol, mean, p, place of the mean return under random signs."""
    return sign_flips(rows, "symbol", "r", ["symbol", "d"], times, seed, "mean").withColumnRenamed("observed", "mean")
