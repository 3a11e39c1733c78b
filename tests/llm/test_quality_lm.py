"""Operators 7 and 10 against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from tidemill.llm.lm import Automaton, Grams, scores
from tidemill.llm.quality import BASE, base_failed, judged, labelled_rows, learn

from pyspark.sql import functions as F

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def some_texts(n=120):
    r = random.Random(4)
    words = [f"wörd{i}" for i in range(30)] + ["A", "B#", "***", "x|y"]
    out = [r.choice([" ", "\n", "\t ", "  "]).join(r.choices(words, k=r.randint(0, 200))) for _ in range(n)]
    return out + [None, "", " \n", "a b", "one\ntwo\none\n\n \none", "ha " * 300, " ".join(map(str, range(400))) * 2, "\x0b\x0ca\rb", "  \x85", "é" * 5000]


def counts(text):
    w = SPACE.findall(text or "")
    lines = [x for x in (text or "").split("\n") if SPACE.search(x)]
    seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep)


def test_base_counts_and_rules(spark):
    texts = some_texts()
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, n_words string")
    rules = [[("symbols_per_word", ">=", 0.12), ("words", "<", 150.0)], [("distinct_share", ">=", 0.9)]]
    out = judged(docs, rules).select("doc_id", *(F.col("_m")[c].alias(c) for c in BASE), base_failed().alias("f"), "_kept")
    for r in out.collect():
        want = counts(texts[r.doc_id])
        assert tuple(r)[1:6] == want, texts[r.doc_id]
        failed = want[0] < 50 or 100 * want[4] > 50 * want[0]
        distinct = len(set(SPACE.findall(texts[r.doc_id] or "")))
        rejected = want[0] and ((want[2] / want[0] >= 0.12 and want[0] < 150) or distinct / want[0] >= 0.9)
        assert (r.f, r._kept) == (failed, not failed and not rejected)


def test_learning(spark):
    r = random.Random(1)
    vocabulary = [f"{a}{b}{c}" for a in "bdfg" for b in "aeiou" for c in "mnrst"]
    good = [" ".join(r.choices(vocabulary, k=200)) for _ in range(300)]
    bad = [" ".join(w + "$$" for w in r.choices(vocabulary, k=150)) for _ in range(60)] + [" ".join(r.choices(vocabulary, k=150)).upper() for _ in range(60)]
    rows = [(i, t) for i, t in enumerate(good + bad)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 300)) for i, _ in rows] + [(9999, 0), (1, None), (None, 0)], "doc_id long, quality int")
    rules = learn(labelled_rows(docs, labels, 1000))
    kept = {x.doc_id for x in judged(docs, rules).where("_kept").select("doc_id").collect()}
    assert rules and len(kept & set(range(300))) >= 297 and not kept - set(range(300))
    assert learn(labelled_rows(docs, labels.limit(0), 1000)) == []
    assert judged(docs.limit(0), rules).count() == 0


def test_lm(spark):
    texts = some_texts(60) + ["the the THE the cat", "the cat"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(3, texts[3]), (None, "the dog")]
    got = sorted(map(tuple, scores(spark.createDataFrame([(*x, 1.0) for x in rows], "doc_id long, text string, score double").repartition(3), block_mb=0.01).collect()), key=str)
    words = lambda t: [*SPACE.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), "</s>"]
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    one, two, three, starts = Counter(), Counter(), Counter(), 0
    for i, t in rows:
        if not out(i):
            w = words(t)
            starts += 1
            one.update(w)
            two.update(zip(["<s>", *w], w))
            three.update(zip(["<s>", *w], w, w[1:]))
    n, v, mu, nu = sum(one.values()), len(one), 100.0, 4.0
    want = []
    for i, t in rows:
        w = words(t)
        p = [(one[x] + 1) / (n + v + 1) for x in w]
        s = [(two[h, x] + mu * q) / ((starts if h == "<s>" else one[h]) + mu) for h, x, q in zip(["<s>", *w], w, p)]
        s[1:] = [(three[g, h, x] + nu * q) / (two[g, h] + nu) for g, h, x, q in zip(["<s>", *w], w, w[1:], s[1:])]
        want.append((i, out(i), len(w), sum(one[x] > 0 for x in w), n, sum(map(math.log10, p)), sum(map(math.log10, s))))
    want.sort(key=str)
    for a, b in zip(sorted(got, key=lambda x: (str(x[0]), x[2])), sorted(want, key=lambda x: (str(x[0]), x[2]))):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-6 and abs(a[6] - b[6]) < 1e-6
    assert len(got) == len(want)
    assert scores(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_automaton():
    """Stretches of any length give the same weights; the weights of a state's arcs, with failure, sum to 1."""
    texts = [t.encode() for t in some_texts(30) if t] + [b"a b a b c", b""]
    g = Grams(list(range(len(texts))), texts, 9, 7)
    total = g.times.astype(float)
    known = int((g.keys & np.uint64(3) == 0).sum())
    a = Automaton(g, total, int(g.counts.sum()), len(texts), known, (3.0, 2.0))
    whole = a.read(g.counts, 10**6)
    assert all(np.allclose(whole, a.read(g.counts, n)) for n in (2, 3, 7, 64))
    words, last = np.arange(a.width), np.cumsum(g.counts) - 1
    ends = {*g.word[last].tolist(), *g.pair[last].tolist()}  # nothing follows the end
    for state in [a.empty, a.start, *np.random.default_rng(1).integers(0, a.start, 200)]:
        if state >= a.start or g.keys[state] & np.uint64(3) < 2 and state not in ends:
            reached, weight = a.step(np.full(a.width, state), words)
            assert np.isclose((10**weight).sum() + 1 / (g.counts.sum() + known + 1) * 10 ** unseen(a, state), 1), state


def unseen(a, state):
    """Log-weight of the failure arcs from a state to the empty history."""
    out = 0.0
    while state != a.empty:
        out, state = out + a.lost[state], a.fail[state]
    return out


def test_only_labelled_rows_are_measured(spark, monkeypatch):
    """No filter by counts goes below the join, where it would count the words of every document."""
    from tidemill.llm import quality

    plans = []
    monkeypatch.setattr(quality, "written", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or df)
    docs = spark.createDataFrame([(i, "a b c " * 40) for i in range(9)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    quality.labelled_rows(docs, labels, 10)
    below = plans[0][plans[0].index("Join ") :]
    assert "split(" not in below and "split(" in plans[0]
