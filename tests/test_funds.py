"""The fund pool against its rules, fund by fund."""

import datetime as dt
import math
import random
import re
import statistics

from tidemill.operators import funds

FUND = "code string, name string, fund_type string, invest_type string, management string, benchmark string, has_any boolean, size double, vol double, n_rows long"


def walked(rows):
    """Filters one after another on a list, as the rules are written."""
    left, reached = sorted(rows), {r[0]: 0 for r in rows}

    def weights(b):
        found = [re.search(r"(\d+(?:\.\d+)?)\s*%", p) for p in re.split(r"[+＋]", b or "")]
        return [float(m.group(1)) for m in found if m and float(m.group(1)) <= 100]

    def passive(r):
        w = weights(r[5])
        return (r[3] or "") in funds.PASSIVE_TYPES or re.search(funds.PASSIVE_WORDS, r[1] or "") or (len(w) == 1 and w[0] > 0)

    tests = [
        lambda r: (r[2] or "") in funds.EQUITY_TYPES, lambda r: not passive(r), lambda r: not (re.match(funds.GRADED_CODE, r[0]) and "分级" in (r[1] or "")),
        lambda r: not re.search(funds.FOREIGN_WORDS, r[1] or ""), lambda r: bool(r[6]), lambda r: r[7] is None or r[7] >= 2, lambda r: r[8] is None or r[8] >= 0.08,
    ]
    for i, test in enumerate(tests, 1):
        left = [r for r in left if test(r)]
        reached |= {r[0]: i for r in left}
    seen, first = set(), []
    for r in left:
        key = (r[4] or "", re.sub(r"[-–—]?([A-Z]{1,2})$", "", re.sub(r"\(.*?\)", "", r[1] or "")).strip())
        if key not in seen:
            seen.add(key)
            first.append(r)
    reached |= {r[0]: 8 for r in first} | {r[0]: 9 for r in first if (r[9] or 0) >= 250}
    return reached


def test_funnel(spark):
    rng = random.Random(2)
    pick = rng.choice
    rows = []
    for i in range(600):
        name = pick(["成长", "价值", "中证500", "分级", "QDII", "全球", "Ab"]) + pick(["", "A", "-C", "(旧)B", "H"]) if rng.random() < 0.9 else None
        rows.append((f"{pick(['150', '16', '00', '51'])}{i:04d}.OF", name, pick(["股票型", "混合型", "债券型", None]), pick([None, "成长型", "成长型", "被动指数型"]), pick([None, "m", "n"]),
                     pick([None, "", "a*95%+b*5%", "a*100%", "x 150%＋y*0.5 %", "none"]), pick([True, True, None, False]), pick([None, 1.99, 2.0, 50.0]), pick([None, 0.08, 0.0799, 0.3]), pick([None, 249, 250, 900])))
    got = {r.code: r.passed for r in funds.funnel(spark.createDataFrame(rows, FUND).repartition(4)).collect()}
    want = walked(rows)
    assert got == want and set(want.values()) == set(range(10))
    counts = [(r.number, r.n) for r in funds.funnel_counts(funds.funnel(spark.createDataFrame(rows, FUND))).collect()]
    assert counts == [(i, sum(v >= i for v in want.values())) for i in range(10)]
    assert [r.n for r in funds.funnel_counts(funds.funnel(spark.createDataFrame([], FUND))).collect()] == [0] * 10


def test_nav_statistics(spark):
    rng = random.Random(5)
    day = lambda i: dt.date(2020, 1, 1) + dt.timedelta(i)
    rows, want = [], {}
    for code, n, adj in (("long", 260, True), ("unit", 260, False), ("short", 119, True), ("few", 150, True)):
        values, v = [], 1.0
        for i in range(n):
            v *= 1 + rng.uniform(-0.02, 0.021) + (0.5 if i == 200 else 0)
            values.append(v)
            rows.append((code, day(i), 3e8 + i if i % 2 else None, v if adj else (v if i < 20 else None), v * 2 if i != 130 else -1.0))
        used = [(i, x) for i, x in enumerate(values)] if adj else [(i, 2 * x) for i, x in enumerate(values) if i != 130]
        late = [x for i, x in used if i >= 90]
        r = [b / a - 1 for a, b in zip(late, late[1:])]
        r = [x for x in r if abs(x) < 0.25]
        want[code] = statistics.stdev(r) * math.sqrt(245) if len(used) >= 120 and len(r) >= 100 else None
    got = {r.code: r for r in funds.nav_statistics(spark.createDataFrame(rows, "code string, d date, net_asset double, adj_nav double, unit_nav double").repartition(3)).collect()}
    for code, v in want.items():
        assert (got[code].vol is None) == (v is None) and (v is None or abs(got[code].vol - v) < 1e-9)
    assert want["long"] and want["unit"] and want["short"] is None and want["few"] is None
    assert got["long"].n_rows == 260 and abs(got["long"].size - (3e8 + 259) / 1e8) < 1e-9
