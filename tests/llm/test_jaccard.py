"""Operator 6 against all pairs."""

import random
import re

import numpy as np
import pytest

from tidemill.llm import jaccard
from tidemill.llm.jaccard import linked, rooted


def corpus():
    r = random.Random(8)
    words = [f"w{i}" for i in range(60)]
    rows = []
    for g in range(8):
        base = r.choices(words, k=r.randint(20, 160))
        for _ in range(r.choice([1, 2, 6, 12])):
            w = base[:]
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = r.choice(words)
            rows.append(" ".join(w + r.choices(words, k=r.choice([0, 0, 1, 3]))).replace("w1", r.choice(["w1", "W1"])))
    rows += [None, "", " \t", "a", "A", "a b", "a  b", "b a", "x y z", "x y z x y z", rows[0], rows[0]]
    r.shuffle(rows)
    return [(1000 - 3 * i, t) for i, t in enumerate(rows)]


def brute(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = frozenset(tuple(w[a : a + k]) for a in range(max(1, len(w) - k + 1))) if w else frozenset()
    label = {i: i for i in sets}
    linked_to = {i: set() for i in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                if sets[a] != sets[b]:
                    linked_to[a].add(sets[b])
                    linked_to[b].add(sets[a])
                x, y = label[a], label[b]
                label = {i: min(x, y) if v in (x, y) else v for i, v in label.items()}
    return sorted((i, len(sets[i]), label[i], len(linked_to[i])) for i in sets)


@pytest.mark.parametrize(("k", "percent", "block_mb", "limit"), [(3, 90, 4.0, 4000), (3, 90, 0.002, 3), (5, 80, 0.01, 5)])
def test_links(spark, k, percent, block_mb, limit):
    rows = corpus()
    docs = spark.createDataFrame([(*x, "c") for x in rows], "doc_id long, text string, label string").repartition(3)
    got = sorted(map(tuple, linked(docs, k, percent, block_mb, limit).collect()))
    assert got == brute(rows, k, percent)


def test_odd_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d"), (5, "a b c d"), (5, "a b c d"), (7, None)], "doc_id long, text string")
    assert sorted(map(str, (tuple(r)[:3] for r in linked(docs).collect()))) == sorted(map(str, [(None, 2, None), (5, 2, 5), (5, 2, 5), (7, 0, 7)]))
    assert linked(docs.limit(0)).collect() == []


@pytest.mark.parametrize("parts", [1, 3])
def test_repeated_ids(spark, parts):
    """Rows that share a doc_id but not their text keep their own links, in one block or in several."""
    a, b = "one two three four five six seven", "red green blue white black grey pink"
    docs = spark.createDataFrame([(3, a), (5, a), (5, b), (9, b)], "doc_id long, text string").repartition(parts)
    got = sorted(map(tuple, linked(docs).collect()))
    assert got == [(3, 5, 3, 0), (5, 5, 3, 0), (5, 5, 5, 0), (9, 5, 5, 0)]


def test_few_long_sets(spark, monkeypatch):
    """A group of few but long sets is split by its shingles; no task holds more than two parts of it."""
    r = random.Random(4)
    base = [f"v{r.randrange(400)}" for _ in range(600)]
    rows = [(i, " ".join(base[:i] + ["new"] + base[i:])) for i in range(40)] + [(100 + i, " ".join(r.choices(base, k=50))) for i in range(5)]
    inner = jaccard.link_group

    def bounded(sets, part, percent):
        assert sum(map(len, sets)) < 14_000
        return inner(sets, part, percent)

    monkeypatch.setattr(jaccard, "link_group", bounded)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(map(tuple, linked(docs, 3, 90, 0.01, shingles=4000).collect()))
    assert got == brute(rows, 3, 90)


def test_split_by_shingles(spark):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(map(tuple, linked(docs, 3, 90, 0.002, shingles=150).collect())) == brute(rows, 3, 90)


def test_rooted():
    """Fewer edges, the same components."""
    rng = np.random.default_rng(2)
    for n, m in ((1, 0), (5, 3), (400, 150), (300, 900), (2000, 1999)):
        edges = rng.integers(0, n, (m, 2)) * 7 if m < 1999 else np.stack([np.arange(1, n), np.arange(n - 1)], 1)
        label = {int(x): int(x) for x in edges.ravel()}
        changed = True
        while changed:
            changed = False
            for a, b in edges.tolist():
                low = min(label[a], label[b])
                changed |= label[a] != low or label[b] != low
                label[a] = label[b] = low
        assert {(a, b) for a, b in rooted(edges).tolist()} == {(a, b) for a, b in label.items() if a != b}
