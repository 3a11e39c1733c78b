"""The filter audit against its definition, on odd rows and random texts."""

import random
import re
from itertools import permutations

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tidemill.llm import filteraudit
from tidemill.llm.filteraudit import ORACLE_SQL, Texts, audited

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def failed(text: str) -> str:
    words = WORD.findall(text)
    tests = {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search(r"[#$%&*|]", text)),
    }
    return "".join(k for k, bad in tests.items() if bad)


def brute(rows, labels):
    good, toxic = ({i for i, *marks in labels if marks[k] == 1 and i is not None} for k in (0, 1))
    docs = []
    for i, text, lang in rows:
        copy = i is not None and any(j is not None and j < i and (t or "") == (text or "") for j, t, _ in rows)
        docs.append((lang or "", failed(text or "") + "E" * copy, i in good, i in toxic))
    out = {}
    for part in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == part]
        removed_of = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            for k, letter in enumerate(order):
                left = [d for d in own if not set(d[1]) & set(order[:k])]
                gone = [d for d in left if letter in d[1]]
                removed_of[letter] += len(gone)
                out[part, order, k + 1] = [
                    len(left) - len(gone), len(gone), sum(letter in d[1] for d in own) - len(gone), sum(d[1] == letter for d in own),
                    sum(d[2] for d in gone), sum(d[3] for d in gone),
                ]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_of[order[step - 1]])
    return out


def rows_of(frame):
    fields = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    return {(r.part, r.filter_order, r.step): [r[f] for f in fields] for r in frame.collect()}


def texts(seed: int, n: int) -> list[str | None]:
    rng = random.Random(seed)
    words = ["a", "B", "cc", "Über", "x#y", "dd|", "　", "word" * 20, "\x00", "\x1c", "é", "longer", "EIGHTEEN"]
    out = [None, "", " \t\n\x0b\x0c\r"]
    while len(out) < n:
        few = rng.sample(words, rng.randint(1, len(words)))
        out.append(rng.choice([" ", "\n", "  "]).join(rng.choice(few) + str(rng.randint(0, rng.choice([1, 300]))) for _ in range(rng.choice([1, 30, 199, 200, 400]))))
    return out + out[: n // 3]


def test_against_definition(spark):
    found = texts(3, 60)
    rng = random.Random(5)
    rows = [(rng.choice([None, *range(50)]), t, rng.choice([None, "", "en", "de"])) for t in found] + [(7, found[9], "en"), (7, found[9], "en"), (7, found[9], "de")]
    labels = [(i, rng.choice([None, 0, 1]), rng.choice([None, 0, 1])) for i in [None, *range(60), 3, 4, 7]]
    # columns named as the operator's own ones, and one with a dot, stay out of the way
    docs = spark.createDataFrame([(*r, "E", 5, b"", 1) for r in rows], "doc_id long, text string, lang string, part string, fails int, digest binary, `a.b` int").repartition(5)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    assert rows_of(audited(docs, marks)) == brute(rows, labels)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    marks = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert audited(docs, marks).collect() == []
    one = audited(spark.createDataFrame([(1, None, None)], docs.schema), marks)
    assert rows_of(one) == brute([(1, None, None)], [])


def test_buffers():
    """Slices of arrays, texts that touch, words of many lengths, equal hashes."""
    found = [t or "" for t in texts(9, 80)] + ["Q" * 100_000, "ab" * 7 + " " + "ab" * 7 + " " + "ab" * 8, "x", "y", "x x"]
    array = pa.array(["before", *found, "after"]).slice(1, len(found))
    own = Texts(array)
    start, end, first = own.words()
    assert [bytes(own.raw[a:b]).decode() for a, b in zip(start, end)] == [w for t in found for w in WORD.findall(t)]
    distinct = [len(set(WORD.findall(t))) for t in found]
    assert own.distinct(start, end, first).tolist() == distinct
    own.hashes = lambda start, end: (end - start).astype(np.uint64) << np.uint64(50)  # words of one length share a hash
    assert own.distinct(start, end, first).tolist() == distinct
    empty = Texts(pa.array([None, ""], pa.string()))
    assert [len(x) for x in empty.words()] == [0, 0, 3]


@pytest.mark.parametrize("sf", ["sf0.001"])
def test_sql(spark, sf):
    base = f"/root/testdata/{sf}"
    con = duckdb.connect()
    for name in ("documents", "labels"):
        con.execute(f"create view {name} as select * from '{base}/{name}.parquet'")
    want = con.execute(ORACLE_SQL["op13_filter_audit"]).fetchall()
    got = [tuple(r) for r in filteraudit.op13_filter_audit(spark, base).collect()]
    assert sorted(got) == sorted(want) and got
