"""Substring operators against brute force on hand-made documents."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tidemill.llm import substring, suffixes, windows
from tidemill.llm.substring import remove_repeats
from tidemill.llm.suffixes import remove_repeated_bytes


def corpus():
    r = random.Random(5)
    vocabulary = ["".join(r.choices("abcdé", k=r.randint(1, 5))) for _ in range(60)]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, base = text(40), text(120)
    rows = [(i, text(r.randint(0, 150))) for i in range(30)]
    rows += [(100 + i, base) for i in range(9)]
    rows += [(200 + i, text(20) + "\n" + passage + "\t " + text(5 + i)) for i in range(6)]
    words = base.split()
    for i in range(8):
        near = words[:]
        near[r.randrange(len(near))] = "new"
        rows.append((300 + i, " ".join(near)))
    rows += [(400, None), (401, ""), (402, " \n "), (403, "ha " * 400), (404, "x" * 900), (300, rows[-1][1]), (405, "a b"), (None, "a b c")]
    return rows


def brute_words(rows, k):
    docs = [(t or "").encode().split() for _, t in rows]
    seen = Counter(tuple(w[i : i + k]) for w in docs for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, docs):
        gone = {j for i in range(len(w) - k + 1) if seen[tuple(w[i : i + k])] > 1 for j in range(i, i + k)}
        kept = b" ".join(x for j, x in enumerate(w) if j not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_bytes(rows, k):
    docs = [(t or "").encode() for _, t in rows]
    seen = Counter(w[i : i + k] for w in docs for i in range(len(w) - k + 1))
    out = []
    for (d, _), w in zip(rows, docs):
        gone = {j for i in range(len(w) - k + 1) if seen[w[i : i + k]] > 1 for j in range(i, i + k)}
        spans = sum(j - 1 not in gone for j in gone)
        out.append((d, len(w), len(gone), spans, hashlib.sha256(bytes(x for j, x in enumerate(w) if j not in gone)).hexdigest()))
    return out


def key(row):
    return tuple(-1 if x is None else x for x in row)


@pytest.mark.parametrize("block_mb", [0.002, 4.0])
def test_words(spark, block_mb):
    rows = corpus()
    docs = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, n_words string").repartition(3)
    got = [tuple(x) for x in remove_repeats(docs, block_mb=block_mb, bucket_mb=block_mb).collect()]
    assert sorted(got, key=key) == sorted(brute_words(rows, 35), key=key)


@pytest.mark.parametrize("block_mb", [0.002, 4.0])
def test_bytes(spark, block_mb):
    rows = corpus()
    docs = spark.createDataFrame([(*x, "n") for x in rows], "doc_id long, text string, block string").repartition(3)
    got = [tuple(x) for x in remove_repeated_bytes(docs, block_mb=block_mb, bucket_mb=block_mb, batch_mb=0.001).collect()]
    assert sorted(got, key=key) == sorted(brute_bytes(rows, 200), key=key)


def test_empty(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeats(none).collect() == [] and remove_repeated_bytes(none).collect() == []


@pytest.mark.parametrize("kind", ["words", "bytes"])
def test_hot_minimiser(spark, monkeypatch, kind):
    """A passage of little more than a window, in every document between words of its own: no bucket may hold all its strings."""
    r = random.Random(9)
    own = lambda n: " ".join("".join(r.choices("abcdefgh", k=7)) for _ in range(n))
    passage = own(36)
    rows = [(i, f"{own(40)} {passage} {own(40)}") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    bound = 4 * int(0.02 * (2 << 20))
    module = substring if kind == "words" else suffixes
    made = module.matcher

    def small(*args):
        match = made(*args)

        def checked(rows):
            rows = list(rows)
            assert sum(len(x[0]) for x in rows) < bound
            return match(rows)

        return checked

    monkeypatch.setattr(module, "matcher", small)
    if kind == "words":
        got, want = remove_repeats(docs, block_mb=0.02, bucket_mb=0.02), brute_words(rows, 35)
    else:
        got, want = remove_repeated_bytes(docs, block_mb=0.02, bucket_mb=0.02), brute_bytes(rows, 200)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_equal_strings():
    row = lambda *keys: (b"".join(keys), np.array([len(x) for x in keys], np.int32), np.array([x == b"m" for x in keys]))
    got = windows.equal_strings(iter([row(b"ab", b"c"), row(b"a", b"bc", b"m"), row(b"c", b"ab")]))
    assert [x[:, 0].tolist() for x in got] == [[0, 1], [2], [0, 1]]
    assert all((x[:, 1:] == [0, 1]).all() for x in got)


def test_word_hashes():
    words = [b"a", b"b", b"ab", b"a\0", b"12345678", b"123456789", b"x" * 64, b"x" * 65, b"x" * 66, b"x" * 900]
    start, end, hashes = substring.word_hashes(b" \t" + b"\n\r\x0b".join(words * 2) + b" " * 8)
    assert (end - start).tolist() == [len(w) for w in words * 2]
    assert hashes[: len(words)].tolist() == hashes[len(words) :].tolist() and len(set(hashes.tolist())) == len(words)


def test_prefixes():
    r = np.random.default_rng(4)
    for k in (8, 13, 24, 200):
        data = r.integers(0, 2, 3000).astype(np.uint8)
        data[1000:1400] = data[100:500]
        starts = np.sort(r.choice(len(data) - k + 1, 2000, replace=False))
        seen = Counter(data[a : a + k].tobytes() for a in starts)
        assert suffixes.repeated_prefixes(data, starts, k).tolist() == [seen[data[a : a + k].tobytes()] > 1 for a in starts]
    assert suffixes.repeated_prefixes(data, starts[:0], 200).tolist() == []


def test_pieces_of_long_texts(spark, monkeypatch):
    """Windows across the pieces in which a long text is cut."""
    monkeypatch.setattr(suffixes, "PIECE", 64)
    rows = corpus()
    starts, counts, minima, string, *_ = suffixes.super_strings([(t or "").encode() for _, t in rows], 200, 40)
    got = Counter(string(s, c)[i : i + 200] for s, c in zip(starts.tolist(), counts.tolist()) for i in range(c))
    assert got == Counter(t.encode()[i : i + 200] for _, t in rows if t for i in range(len(t.encode()) - 199))


def test_family_of_batches(spark, tmp_path):
    """Later batches against all before them; levels merge geometrically."""
    rows, family = corpus(), suffixes.SuffixFamily(spark, str(tmp_path), buckets=5, batch_mb=0.001)
    random.Random(2).shuffle(rows)
    seen: list = []
    for a in range(0, len(rows), 16):
        own = rows[a : a + 16]
        got = [tuple(x) for x in family.add(spark.createDataFrame(own, "doc_id long, text string"), block_mb=0.01).collect()]
        assert sorted(got, key=key) == sorted(brute_bytes(seen + own, 200)[len(seen) :], key=key)
        seen += own
    sizes = [n for _, n in family.levels]
    assert all(x >= 2 * y for x, y in zip(sizes, sizes[1:])) and len(sizes) < len(rows) / 16
