"""Least squares and orthogonal factors against numpy."""

import math

import numpy as np
import pytest

from tidemill.operators import regress

XS = ["a", "b.c", "c", "e"]


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(300, 4)) * [0.01, 3.0, 1e-4, 0.02] + [0.001, 2.0, 0.0, -0.01]
    x[:, 3] += 0.7 * x[:, 0]
    rows = []
    for g in range(5):
        y = 0.0004 * g + x @ np.array([0.5 * g, 0.01, -3.0, 0.2]) + rng.normal(size=300) * 0.01
        rows += [(g, *map(float, x[i]), float(y[i])) for i in range(300 - 20 * g)]
    rows += [(0, None, 1.0, 1.0, 1.0, 1.0), (0, 1.0, 1.0, math.nan, 1.0, 1.0), (1, 1.0, 1.0, 1.0, 1.0, None)]
    return rows, spark.createDataFrame(rows, "g int, a double, `b.c` double, c double, e double, y double").repartition(7)


def whole(rows, g):
    return np.array([r[1:] for r in rows if r[0] == g and all(v is not None and v == v for v in r)])


def test_ols(panel):
    rows, frame = panel
    frame = frame.withColumnRenamed("b.c", "bc")
    xs = ["a", "bc", "c", "e"]
    found = {r.g: r for r in regress.ols(frame, ["g"], "y", xs, least=240).collect()}
    assert set(found) == {0, 1, 2, 3}  # the last has 220 rows
    for g, r in found.items():
        m = whole(rows, g)
        x, y = np.column_stack([np.ones(len(m)), m[:, :4]]), m[:, 4]
        b = np.linalg.lstsq(x, y, rcond=None)[0]
        rest = y - x @ b
        error = math.sqrt(rest @ rest / (len(m) - 5) * np.linalg.inv(x.T @ x)[0, 0])
        want = [len(m), b[0] * 245, (1 + b[0]) ** 245 - 1, b[0] / error, 1 - rest.var() / y.var(), *b[1:], *(np.corrcoef(m[:, i], y)[0, 1] for i in range(4))]
        assert np.allclose([r[c] for c in r.asDict() if c != "g"], want, rtol=1e-6)


def test_dependent_factors(panel):
    rows, frame = panel
    twice = frame.withColumn("z", frame["a"] * 2 + 1).withColumn("still", frame["a"] * 0)
    for xs in (["a", "z"], ["a", "still"]):
        found = regress.ols(twice, ["g"], "y", xs, least=240).collect()
        assert len(found) == 4 and all(r.alpha_lin is None and r.t is None and r[f"beta_{xs[0]}"] is None and r.n >= 240 for r in found)
        assert all(r.cor_a is not None for r in found)


def test_orthogonal(panel):
    rows, frame = panel
    frame = frame.withColumnRenamed("b.c", "bc").drop("y")
    xs = ["a", "bc", "c", "e"]
    got = np.array([[np.nan if v is None else v for v in r[1:]] for r in regress.orthogonal(frame.where("g = 2"), xs).collect()])
    m = whole(rows, 2)[:, :4]
    z = (m - m.mean(0)) / m.std(0)
    w, v = np.linalg.eigh(np.corrcoef(z.T))
    want = z @ (v @ np.diag(w**-0.5) @ v.T)
    assert np.allclose(np.corrcoef(got.T), np.eye(4), atol=1e-9)
    assert np.allclose(got[np.argsort(got[:, 0])], want[np.argsort(want[:, 0])], atol=1e-8)
    assert np.all(np.diag(np.corrcoef(np.hstack([got[np.argsort(got[:, 0])], z[np.argsort(want[:, 0])]]).T)[:4, 4:]) > 0.75)  # each near to itself


def test_no_rows(panel, spark):
    frame = panel[1].withColumnRenamed("b.c", "bc")
    assert regress.orthogonal(frame.where("g > 90"), ["a", "bc"]).collect() == []
    assert regress.ols(frame.where("g > 90"), ["g"], "y", ["a", "bc"]).collect() == []
    still = regress.orthogonal(frame.withColumn("a", frame["a"] * 0), ["a", "bc"]).first()
    assert still.a is None and still.bc is None
