"""Operators 8 and 9 on made texts with known labels."""

import random

from tidemill.llm.language import learned, predicted, spans
from tidemill.llm.toxicity import LabelModel, fitted, op8_toxicity, scored, stratum

VOCABULARY = {"xx": [a + b for a in ("ba", "do", "ki") for b in ("lan", "mor", "tis", "vek", "zul")], "yy": [a + b for a in ("sché", "grö", "wü") for b in ("nçht", "pfü", "rxë")], "zz": [a + b for a in ("ма", "ло") for b in ("кот", "рин", "дуб")]}


def test_toxicity(spark):
    r = random.Random(2)
    bad = ["vile", "nasty", "rotten", "foul"]
    rows, labels = [], []
    for i in range(900):
        words = r.choices([f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwx"], k=60)
        toxic = i % 6 == 0
        for w in r.sample(bad, r.randint(1, 4)) if toxic else []:
            words[r.randrange(60)] = w.upper() + "!" if i % 4 else w
        rows.append((i, " ".join(words), "x"))
        labels.append((i, int(toxic)))
    docs = spark.createDataFrame(rows + [(1000, None, "x"), (1001, "", "x"), (1002, "vile " * 3000, "x")], "doc_id long, text string, score string")
    train = spark.createDataFrame([x for x in labels if x[0] < 600] + [(5, None), (None, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x.score for x in scored(docs, *fitted(docs.where("doc_id < 600"), train)).collect()}
    right = sum((got[i] >= 0.5) == bool(t) for i, t in labels if i >= 600)
    assert len(got) == 903 and right >= 295 and got[1000] == got[1001] < 0.5 < got[1002] and all(0 <= s <= 1 for s in got.values())
    assert {x.score for x in scored(docs, *fitted(docs, train.limit(0))).collect()} and scored(docs.limit(0), 0.0, {}, [0] * 4).count() == 0


def test_label_model():
    """Posteriors by enumeration of the classes; the fit does not lose likelihood and finds the made class."""
    import numpy as np

    g = np.random.default_rng(5)
    y = g.random(6000) < 0.2
    votes = np.stack([np.where(y, g.random(6000) < p, g.random(6000) < q) for p, q in ((0.7, 0.02), (0.6, 0.03), (0.65, 0.01), (0.3, 0.25))], 1).astype(int)
    votes = np.c_[votes, votes[:, 3] ^ (g.random(6000) < 0.1)]  # a voter that mostly follows another
    kinds, count = np.unique(votes, axis=0, return_counts=True)
    strata = np.zeros(len(kinds), int)
    fits = [LabelModel(kinds, strata, count.astype(float), 0.1, 3, rounds, trust=0.0) for rounds in (2, 6, 12, 40)]

    def joint(m, v):
        """P(class, votes) of one pattern, voter by voter."""
        out = [1 - m.prior, m.prior]
        for c in (0, 1):
            for i, x in enumerate(v):
                p = m.table[c, 0, v[m.parent[i]] if m.parent[i] >= 0 else 0, i]
                out[c] *= p if x else 1 - p
        return out

    for m in fits:
        both = np.array([joint(m, v) for v in kinds])
        assert np.allclose(m.posterior(kinds, strata), both[:, 1] / both.sum(1))
    whole = [sum(n * np.log(sum(joint(m, v))) for v, n in zip(kinds, count)) for m in fits]
    assert whole[0] <= whole[1] + 1 and whole[2] <= whole[3] + 1
    m = fits[-1]
    assert m.parent[4] == 3 or m.parent[3] == 4  # the tree joins the two that go together
    found = dict(zip(map(tuple, kinds.tolist()), m.posterior(kinds, strata)))
    right = np.mean([(found[tuple(v)] >= 0.5) == t for v, t in zip(votes.tolist(), y)])
    assert right > 0.93 and abs(m.prior - y.mean()) < 0.05
    assert [stratum(n) for n in (0, 31, 32, 63, 64, 511, 512, 10**6)] == [0, 0, 1, 1, 2, 4, 5, 5]


def test_toxicity_query(spark, tmp_path):
    """The registered query: columns, held-out rows by the hash of the id, predictions by the score."""
    import zlib

    r = random.Random(4)
    rows, labels = [], []
    for i in range(400):
        words = r.choices([f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrstuvwx"], k=50)
        toxic = int(i % 5 == 0)
        if toxic:
            words[3:5] = ["vile", "rotten"]
        rows.append((i, " ".join(words)))
        labels.append((i, 1, toxic))
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    df = op8_toxicity(spark, str(tmp_path))
    assert dict(df.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    got = {x.doc_id: x for x in df.collect()}
    assert all(x.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and x.predicted == int(x.score >= 0.5) for i, x in got.items())
    assert sum(got[i].predicted == t for i, _, t in labels) >= 396


def test_language_by_hand(spark):
    """Word scores, path and share recomputed from the counts in plain Python."""
    import math
    import zlib
    from collections import Counter

    r = random.Random(9)
    train = [(i, " ".join(r.choices(VOCABULARY[lang], k=12)), lang) for i in range(60) for lang in [("xx", "yy", "zz")[i % 3]]]
    asked = [(100, "balan domor grönçht kitis"), (101, "макот лорин balan"), (102, "schépfü"), (103, "q")]
    docs = spark.createDataFrame(train, "doc_id long, text string, lang string")
    model = learned(docs, sample=6000, penalty=3.0)
    slots = lambda w: [zlib.crc32(f"^{w}$"[i : i + 3].encode()) % (1 << 16) for i in range(len(w))]
    counts = {x: Counter() for x in ("xx", "yy", "zz")}
    for _, t, lang in train:
        for w in t.lower().split():
            counts[lang].update(slots(w))
    allowed = lambda w: ["zz"] if w[0] > "\u0400" else ["xx", "yy"]

    def scores_of(w):
        raw = [sum(math.log((counts[x][s] + 0.1) / sum(counts[y][s] + 0.1 for y in counts)) for s in slots(w)) if x in allowed(w) else -math.inf for x in ("xx", "yy", "zz")]
        top = max(raw)
        norm = math.log(sum(math.exp(v - top) for v in raw))
        return [max(v - top - norm, -50) for v in raw]

    for x in predicted(spark.createDataFrame(asked, "doc_id long, text string"), model).collect():
        words = dict(asked)[x.doc_id].split()
        path = plain_viterbi([scores_of(w) for w in words], 3.0)
        best = min(range(3), key=lambda i: (-path.count(i), i))
        assert (x.lang_pred, round(x.score, 9)) == (("xx", "yy", "zz")[best], round(path.count(best) / len(words), 9)), x


def test_rare_language_is_learned(spark):
    rows = [(i, "balan domor kitis", "xx") for i in range(500)] + [(1000, "schépfü grönçht würxë", "yy")]
    model = learned(spark.createDataFrame(rows, "doc_id long, text string, lang string"), sample=40)
    assert model.names == ["xx", "yy"]


def test_language(spark):
    r = random.Random(6)
    rows = [(i, " ".join(r.choices(VOCABULARY[lang], k=r.randint(3, 80))), lang) for i in range(240) for lang in [("xx", "yy", "zz")[i % 3]]]
    mixed = " ".join(r.choices(VOCABULARY["xx"], k=40) + r.choices(VOCABULARY["yy"], k=50) + r.choices(VOCABULARY["zz"], k=30))
    odd = [(900, None, "xx"), (901, "", None), (902, "12 ,; --", "yy"), (903, mixed, None), (904, "Ωmega", "zz"), (905, "vek " * 20000, None)]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    model = learned(docs.where("doc_id < 150"))
    got = {x.doc_id: (x.lang_pred, x.score) for x in predicted(docs, model).collect()}
    assert sum(got[i][0] == lang for i, _, lang in rows) == len(rows)
    assert got[900] == got[901] == got[902] == ("und", 0.0) and got[903][0] == "yy" and got[905] == ("xx", 1.0)
    assert [(x.first_word, x.n_words, x.lang) for x in spans(docs.where("doc_id = 903"), model).orderBy("first_word").collect()] == [(0, 40, "xx"), (40, 50, "yy"), (90, 30, "zz")]
    assert {x.lang_pred for x in predicted(docs, learned(docs.limit(0))).collect()} == {"und"}


def test_path_shortcut_is_exact(spark):
    import numpy as np

    from tidemill.llm.language import LanguageModel

    g = np.random.default_rng(3)
    model = LanguageModel({n: np.ones(1 << 16) for n in "abc"}, {}, 2.5)
    for _ in range(200):
        counts = g.integers(1, 9, 6)
        score = np.log(g.dirichlet([0.3] * 3, counts.sum()) + 1e-9)
        path, a = model.paths(score, counts), 0
        for n in counts:
            own = score[a : a + n]
            value = lambda p: own[np.arange(n), p].sum() - 2.5 * (p[1:] != p[:-1]).sum()  # noqa: B023, E731
            assert value(path[a : a + n]) >= value(model.viterbi(own)) - 1e-9
            assert (model.viterbi(own) == plain_viterbi(own, 2.5)).all()
            a += n
        assert (model.viterbi(score, counts) == np.concatenate([plain_viterbi(score[e - n : e], 2.5) for n, e in zip(counts, counts.cumsum())])).all()


def plain_viterbi(score, penalty):
    total, back = [list(score[0])], []
    for row in score[1:]:
        last = total[-1]
        top = max(range(len(last)), key=lambda i: last[i])
        back.append([top if last[top] - penalty > x else i for i, x in enumerate(last)])
        total.append([last[j] - penalty * (j != i) + row[i] for i, j in enumerate(back[-1])])
    path = [max(range(len(score[0])), key=lambda i: total[-1][i])]
    for step in reversed(back):
        path.append(step[path[-1]])
    return path[::-1]
