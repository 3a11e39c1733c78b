"""Step functions and code rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def steps(c: Column, bounds: list[float], values: list) -> Column:
    """values[i] for the first bound that c reaches, the last value below all; null stays null."""
    out = F.when(c.isNull(), F.lit(None))
    for b, v in zip(bounds, values):
        out = out.when(c >= b, F.lit(v))
    return out.otherwise(F.lit(values[-1]))


def beta_score(chg: Column, vr: Column, day: Column) -> Column:
    """Trend, volume and day votes added up, held in [-6, 6]; a null gives no vote."""
    sign = lambda c, big, small: F.when(F.abs(c) > big, 2 * F.signum(c)).when(F.abs(c) > small, F.signum(c)).otherwise(0)
    volume = F.when(vr > 1.05, F.signum(chg)).when((vr < 0.95), F.lit(-1) * F.abs(F.signum(chg))).otherwise(0)
    total = sum((F.coalesce(x, F.lit(0)) for x in (sign(chg, 1.5, 0.3), volume, sign(day, 4, 2))), F.lit(0))
    return F.greatest(F.lit(-6), F.least(F.lit(6), total)).cast("int")


def quadrant(chg: Column, vr: Column) -> Column:
    """State of price against volume; fixed bounds, the first test that holds decides."""
    heavy, light = vr > 1.05, vr < 0.95
    return (
        F.when(chg.isNull() | vr.isNull(), "none").when(heavy & (chg > 2), "rising").when(heavy & (chg >= -2), "building").when(heavy, "falling")
        .when(light & (chg > 2), "thin rise").when(chg > 0.5, "rising").when(chg < -0.5, "falling").when(vr > 1.0, "building").when(vr < 1.0, "falling").otherwise("none")
    )


def beta_status(b: Column) -> Column:
    """State of a single score; fixed bounds."""
    return F.coalesce(steps(b, [3, 1, -1, -3], ["strong", "firm", "neutral", "soft", "weak"]), F.lit("unknown"))


def composite_status(b: Column) -> Column:
    """State of the composite score; fixed bounds."""
    return F.coalesce(steps(b, [6, 3, 1, -1, -6], ["strong", "leaning long", "neutral to long", "neutral", "leaning short", "weak"]), F.lit("unknown"))


# Bounds and shares of the composite score.
COMPOSITE_BOUNDS = [6, 3, 1, -1, -3, -6]
COMPOSITE_SHARES = [115, 105, 95, 90, 75, 55, 40]


def composite_position(b: Column) -> Column:
    return F.coalesce(steps(b, COMPOSITE_BOUNDS, COMPOSITE_SHARES), F.lit(90)).cast("int")


def leverage_heat(b: Column) -> Column:
    return F.when(b.isNull() | (b <= 0), 0.0).otherwise(F.round(F.least(F.lit(2.0), F.greatest(F.lit(-1.0), b / 20 * 2 - 1)), 1))


def board(code: Column) -> Column:
    """Market board of a six-digit code."""
    return F.when(code.rlike("^(300|301|302)"), "gem").when(code.rlike("^(688|689)"), "star").when(code.rlike("^(4|8|920)"), "bse").otherwise("main")


def limit_pct(board_: Column, st: Column, day: Column) -> Column:
    """Daily price limit; the ST limit of the main board widens on 2026-07-06."""
    narrow = st & (day < F.lit("2026-07-06").cast("date"))
    return F.when(board_ == "bse", 0.30).when(board_.isin("gem", "star"), 0.20).when(narrow, 0.05).otherwise(0.10)


def exchange_code(digits: Column) -> Column:
    """Six digits with the suffix of their exchange."""
    code = F.lpad(digits, 6, "0")
    return F.concat(code, F.when(code.rlike("^[569]"), ".SH").when(code.rlike("^(4|8)"), ".BJ").otherwise(".SZ"))


def touches_up(close: Column, limit: Column) -> Column:
    return F.coalesce((limit > 0) & (close >= limit * (1 - 1e-4)), F.lit(False))


def touches_down(close: Column, limit: Column) -> Column:
    return F.coalesce((limit > 0) & (close <= limit * (1 + 1e-4)), F.lit(False))


# Code prefixes of indices and stocks, days from which fund limits widened.
INDEX_PREFIX = "^(399|93|H3|98)"
STOCK_PREFIX = "^(600|601|603|605|688|689|900|00|30|20|43|83|87|92)"
STAR_FUNDS_FROM, GROWTH_FUNDS_FROM = "2019-07-22", "2020-08-24"


def daily_table(symbol: Column) -> Column:
    """Table of a symbol: index, stock or fund; a leading T of a delisted code does not count."""
    code, suffix = F.regexp_replace(F.substring_index(symbol, ".", 1), r"^T(?=\d{6}$)", ""), F.substring_index(symbol, ".", -1)
    index = suffix.isin("CSI", "CNI") | code.rlike(INDEX_PREFIX) | (code.startswith("000") & (suffix == "SH"))
    return F.when(index, "index").when(code.rlike(STOCK_PREFIX), "stock").otherwise("fund")


def is_fund(code: Column, suffix: Column) -> Column:
    return F.when(suffix == "SH", code.startswith("5")).when(suffix == "SZ", code.rlike("^1[5678]")).otherwise(F.lit(False))


def fund_kind(code: Column, suffix: Column) -> Column:
    sh, sz = suffix == "SH", suffix == "SZ"
    etf = (sh & code.rlike("^5[1235689]")) | (sz & code.rlike("^15[89]"))
    return F.when(suffix == "OF", "outside").when(etf, "ETF").when((sh & code.startswith("50")) | (sz & code.rlike("^1[68]")), "LOF").otherwise("other")


# Words of funds that invest abroad, in money, gold and bonds, and the code prefixes that stand in for them.
ABROAD_WORDS = "恒生|港股|纳斯达克|标普|道琼斯|日经|德国|法国|亚太|中概|海外|跨境|QDII|美国|香港"
MONEY_WORDS, GOLD_WORDS, BOND_WORDS = "货币|现金", "黄金|金ETF", "债"
ABROAD_CODE, BOND_CODE = "513", "511"


def fund_subclass(code: Column, name: Column) -> Column:
    """By words of the name in this order, then by the code; all but stock funds can be sold on the day they are bought."""
    text = F.coalesce(name, F.lit(""))
    return (
        F.when(text.rlike(ABROAD_WORDS), "foreign").when(text.rlike(MONEY_WORDS), "money").when(text.rlike(GOLD_WORDS), "gold").when(text.rlike(BOND_WORDS), "bond")
        .when(code.startswith(ABROAD_CODE), "foreign").when(code.startswith(BOND_CODE), "bond").otherwise("stock")
    )


def liquidity_class(index: Column, small: Column, down: Column, ratio: Column, t: dict) -> tuple[Column, Column]:
    """State of a day and the tests that fired, as texts. index and small are changes in percent, null where unknown:
    their tests don't fire then. A crisis has the crisis tests alone."""
    told = lambda tests: F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), k) for k, c in tests.items())))
    crisis = told({
        f"down>={t['down_crisis']}": down >= t["down_crisis"], f"small<={t['small_crisis']}": small <= t["small_crisis"],
        f"index<={t['index_crisis']} and ratio>={t['ratio_crisis']}": (index <= t["index_crisis"]) & (ratio >= t["ratio_crisis"]),
    })
    watch = told({
        f"index<={t['index_watch']}": index <= t["index_watch"], f"down>={t['down_watch']}": down >= t["down_watch"],
        f"ratio>={t['ratio_watch']}": ratio >= t["ratio_watch"], f"small<={t['small_watch']}": small <= t["small_watch"],
    })
    state = F.when(F.size(crisis) > 0, "CRISIS").when(F.size(watch) > 0, "WATCH").otherwise("NORMAL")
    return state, F.when(F.size(crisis) > 0, crisis).otherwise(watch)


def fund_limit(equity: Column, follows: Column, day: Column) -> Column:
    since = lambda x: day >= F.lit(x).cast("date")
    wide = (follows.contains("star") & since(STAR_FUNDS_FROM)) | (follows.contains("growth") & since(GROWTH_FUNDS_FROM))
    return F.when(equity & wide, 0.2).otherwise(0.1)
