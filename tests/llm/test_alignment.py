"""The alignment of two vocabularies against its definition, on whole texts by the libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow.parquet as pq
import pytest

from tidemill.llm.alignment import RESULT, Aligner, aligned, op11_alignment, overlaps

public_tokenizers = pytest.importorskip("public_tokenizers")
A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    char = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)}
    back = {c: b for b, c in char.items()}
    a_bytes = lambda i: bytes(back[c] for c in a.id_to_token(i))

    def b_bytes(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if b.is_byte(i) else piece.replace("▁", " ").encode()

    def tokens(text):
        """(id, start, end) of A's and of B's tokens, or none."""
        out = []
        for ids, piece in ((a.encode(" " + (text or ""), add_special_tokens=False).ids, a_bytes), (b.encode(text or ""), b_bytes)):
            at, own = 0, []
            for i in ids:
                own.append((i, at, at + len(piece(i))))
                at = own[-1][2]
            if not text or b"".join(map(piece, ids)) != (" " + text).encode():
                return [], []
            out.append(own)
        return out

    return tokens


def brute(rows, tokens):
    docs = [(i, *tokens(t)) for i, t in rows]
    links = [[(x[0], y[0]) for x in a for y in b if x[1] < y[2] and y[1] < x[2]] if len(a) < 3000 else near(a, b) for _, a, b in docs]
    counts = Counter(p for own in links for p in own)
    best = {}
    for (_, y), n in counts.items():
        best[y] = max(best.get(y, 0), n)
    out = []
    for (i, a, b), own in zip(docs, links):
        ends = sorted({x[2] for x in a} & {y[2] for y in b})
        groups, s = [], 0
        for e in ends:
            groups.append(",".join(str(x[0]) for x in a if s < x[2] <= e) + "|" + ",".join(str(y[0]) for y in b if s < y[2] <= e))
            s = e
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""
        out.append((i, len(a), len(b), len(groups), len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), sha))
    return out


def near(a, b):
    """Overlaps by walking both lists."""
    out, j = [], 0
    for x in a:
        while b[j][2] <= x[1]:
            j += 1
        k = j
        while k < len(b) and b[k][1] < x[2]:
            out.append((x[0], b[k][0]))
            k += 1
    return out


def odd_texts() -> list[str | None]:
    rng = random.Random(2)
    parts = ["hello", "wörld", "don't", " ", "  ", "\n", "\t", "\r\n", "日本語", "😀", "x" * 70, "1234567", "...", "<|endoftext|>", "<s>", "</s>", "<unk>", "<0x41>", "\x00", "\x1c", "\x85", " ", "　", "ﬁ", "é", "a's", "it's", "(", "-", "ا", "﻿"]
    out = [None, "", " ", "   ", "\n", " lead", "trail ", "a ▁ b", "▁", "a b ▁c d", "á ́b", "x" * 3000]
    for n in range(80):
        out.append("".join(rng.choice(parts) + rng.choice(["", " ", " ", "  "]) for _ in range(rng.randint(1, 60))))
    return out + out[12:30]


def found(frame):
    names = [c.split()[0] for c in RESULT.split(", ")]
    return sorted((tuple(r[n] for n in names) for r in frame.collect()), key=str)


def test_odd_texts(spark, libraries):
    rows = [(None if n % 11 == 0 else n % 70, t) for n, t in enumerate(odd_texts())]
    want = sorted(brute(rows, libraries), key=str)
    assert sum(r[1] for r in want) > 2000 and sum(r[1] == 0 for r in want) >= 5
    # columns named as the operator's own ones, and one with a dot, stay out of the way
    frame = spark.createDataFrame([(*r, 1, b"", "p") for r in rows], "doc_id long, text string, block int, blob binary, `pairs.a` string").repartition(3)
    for block_mb in (8.0, 0.001):
        assert found(aligned(frame, A, B, block_mb)) == want


def test_whole_table(spark, libraries):
    rows = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    rows = [(r["doc_id"], r["text"]) for r in rows]
    assert found(op11_alignment(spark, "/root/testdata/sf0.001")) == sorted(brute(rows, libraries), key=str)


def test_empty(spark):
    assert found(aligned(spark.createDataFrame([], "doc_id long, text string"), A, B)) == []
    assert found(aligned(spark.createDataFrame([(4, None), (4, "")], "doc_id long, text string"), A, B)) == [(4, 0, 0, 0, 0, 0, 0, "")] * 2


def test_overlaps():
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = int(rng.integers(1, 40))
        a, b = (np.append(np.unique(rng.integers(1, n + 1, rng.integers(0, n + 1))), n + 1) for _ in range(2))
        first, count, gap = overlaps(a, b)
        pairs = {(i, j) for i in range(len(a)) for j in range(len(b)) if (a[i - 1] if i else 0) < b[j] and (b[j - 1] if j else 0) < a[i]}
        assert {(i, f + k) for i, (f, c) in enumerate(zip(first, count)) for k in range(c)} == pairs
        assert gap.tolist() == [x in b for x in a]
    assert [len(x) for x in overlaps(np.zeros(0, int), np.zeros(0, int))] == [0, 0, 0]


def test_forgetting():
    """Numbers of a block hold although stretches are forgotten between blocks."""
    own = Aligner(A, B, remember=3)
    first = own.numbers([["one", "two", "three four"], ["one"]])
    counts = own.tables()[0][first].tolist()
    assert first[0] == first[3] and not own.full()
    own.numbers([["five", "six"]])
    assert own.full()
    own.forget()
    again = own.numbers([["three four", "two", "one", "one"]])
    assert own.tables()[0][again].tolist() == [counts[2], counts[1], counts[0], counts[0]]
