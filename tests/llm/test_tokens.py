"""Operators 3, 4 and 5 against the libraries and brute force."""

import hashlib
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest

from tidemill.llm.decontaminate import hits, longest_matches, without_hits
from tidemill.llm.pieces import PieceCoder, coded
from tidemill.llm.tokenfiles import WaveletMatrix, WordEncoder, looked_up_tokens, read_shards, shard_starts, token_files

ODD_TEXTS = [None, "", " ", "   a  b ", "a\n\nb\tc", "It's <|endoftext|> x<s>y <0x0A> 'LL", "é é ﬁ Ｆ ǅ Σς 　x y", "▁▁ a▁b", "日本語テキスト \U0001f600!!", "ha" * 3000, "aaaa bbbb " * 50, "\x00\x01 \x85z", "THE QUICK brown", "   ", "\n", "\n \n", "1234567 000 ½²"]


def texts():
    r = random.Random(3)
    pool = "the of and tion ing é ß ü ! ? , . 0 1 23 \n \t  - _ # 中 Я ".split(" ") + [" "]
    return ODD_TEXTS + ["".join(r.choice(pool) + r.choice(["", " ", " ", "  "]) for _ in range(r.randint(0, 80))) for _ in range(300)]


def frame(spark, values):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(values)], "doc_id long, text string, n_tokens string").repartition(3)


def test_pieces(spark):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=path), PieceCoder(path)
    got = {r.doc_id: r for r in coded(frame(spark, texts()), path).collect()}
    for i, t in enumerate(texts()):
        ids = sp.encode(t or "")
        assert coder.encode(t or "") == ids, t
        assert coder.decode(ids) == sp.decode(ids), t
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(sp.decode(ids).encode()).hexdigest()
        assert (got[i].n_tokens, got[i].ids_sha256, got[i].decoded_sha256) == want, t


def test_long_words():
    """Long runs without spaces: as the library, in a time that does not grow with their square."""
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    sp, coder, r = sentencepiece.SentencePieceProcessor(model_file=path), PieceCoder(path), random.Random(7)
    parts = ["the", "tion", "ing", "and", "re", "qu", "e", "a", "o", "z", "ver", "schaft", "ment"]
    latin = "".join(r.choice(parts) for _ in range(36_000))
    base64 = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/") for _ in range(100_000))
    chinese = "".join(chr(r.randrange(0x4E00, 0x5200)) for _ in range(100_000))
    for text in (latin, base64, chinese, "a" * 100_001, "abab" * 5000 + "aab" * 3000):
        begun = time.process_time()
        ids = coder.encode(text)
        assert time.process_time() - begun < 5 and ids == sp.encode(text)


def test_token_files(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    t = Tokenizer.from_file(path)
    files = token_files(frame(spark, texts()), path, shard_ids=500)
    got = {r.doc_id: r for r in read_shards(files).collect()}
    start = 0
    for i, x in enumerate(texts()):
        ids = t.encode(x or "", add_special_tokens=False).ids + [1]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), x
        assert (got[i].first_id, got[i].last_id, got[i].end_ids) == (ids[0], 1, ids.count(1))
        start += len(ids)
    assert files.count() > 4
    common = t.encode("the", add_special_tokens=False).ids[0]
    places = sorted((i, k) for i, x in enumerate(texts()) for k, y in enumerate(t.encode(x or "", add_special_tokens=False).ids) if y == common)
    assert sorted(map(tuple, looked_up_tokens(files, common).collect())) == places and places
    none = token_files(spark.createDataFrame([], "doc_id long, text string"), path)
    assert read_shards(none).collect() == []
    assert sorted(r.start for r in read_shards(token_files(spark.createDataFrame([(None, "a"), (1, "b"), (1, "b")], "doc_id long, text string"), path)).collect()) == [0, 2, 4]


def test_words_cut_before_the_library():
    e, r = WordEncoder(public_tokenizers.path("word_bpe_49k.json")), random.Random(5)
    assert e.lowers
    pool = list("abzABZtheion019'.,!<|>_-éÉßÿ×÷ªµ²½ \n\t\x1c\x85\xa0\u0338\u0331\u0300hHİſΣς한") + ["<|endoftext|>", "<|ENDOFTEXT|>", "'s", "'LL", "'re"]
    texts = ["".join(r.choice(pool) for _ in range(r.randint(0, 20))) for _ in range(5000)]
    own = [e.split(t.encode()) for t in texts]
    ids, sizes = e.encode([w for words in own for w in words])
    ends = np.concatenate(([0], np.cumsum(sizes)))[np.cumsum([len(words) for words in own])].tolist()
    for t, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def same_as_library(e, texts):
    ids, sizes = e.encode([e.lowered(t.encode()) for t in texts], step=50)
    ends = np.cumsum(sizes).tolist()
    for t, a, b in zip(texts, [0, *ends], ends):
        assert ids[a:b].tolist() == e.tokenizer.encode(t, add_special_tokens=False).ids, t


def test_signs_make_no_new_words():
    """A word and the signs after it are learnt apart, so each is encoded once."""
    e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    cores, signs = "the Tion don't 12 naïve GROSS groß 'tis x's é É".split(), [",", ".", "!!", "...", ");", "'", '"', "#$%&*|", "<", "|>", "-", "'-"]
    same_as_library(e, [" ".join(c + s for c in cores[:-1]) for s in signs])
    assert e.known <= len(cores) + len(signs)
    same_as_library(e, ["!" * 9 + " the" + "!" * 9, "É, ½. »! e\u0301, the<\u0338 the, <|endoftext|>, A, the<|endoftext|>", "İ! Σ. ΑΣ, ς;", ",", "", " "])


def test_words_of_one_hash(monkeypatch):
    """Longer words that share a hash get their own ids, and a full encoder starts anew."""
    from tidemill.llm import tokenfiles

    hashes = tokenfiles.hashes_at
    monkeypatch.setattr(tokenfiles, "hashes_at", lambda whole, start, end: np.where(end - start > 8, np.uint64(7), hashes(whole, start, end)))
    long = ["abcdefgh" * 9 + x for x in ("", "a", "b", "abcdefgh")]
    for most in (1_000_000, 20):
        e = WordEncoder(public_tokenizers.path("word_bpe_49k.json"), most)
        for _ in range(2):
            same_as_library(e, [*(t or "" for t in texts()[:60]), "collision colliding colliders, the colliding colliders", " ".join(long + long[::-1])])


def test_shard_starts(spark):
    files = [(p, s, 1 + (7 * p + s) % 5) for p in range(40) for s in range(p % 3)]
    got = {(r.part, r.shard): r.base for r in shard_starts(spark.createDataFrame(files, "part long, shard long, n_ids long"), group=8).collect()}
    at = 0
    for p, s, n in files:
        assert got[p, s] == at
        at += n


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 140_000])
def test_planes(n):
    """Sizes around a block and a stretch; the directory takes a sixteenth of the planes."""
    ids = np.random.default_rng(n).integers(0, 40_000, n).astype(np.uint32)
    m = WaveletMatrix.from_bytes(WaveletMatrix.of(ids).to_bytes(), n)
    assert (m.tokens() == ids).all() and m.ranks.size * 4 <= m.bits * (n / 8 / 16 + 8)
    at = np.random.default_rng(2).integers(0, n, 50) if n else np.zeros(0, np.int64)
    assert (m.access(at) == ids[at]).all() and m.count(7) == (ids == 7).sum()
    for v in ids[at[:5]].tolist():
        assert (m.occurrences(v) == np.flatnonzero(ids == v)).all()
    if n > 100_000:
        few = WaveletMatrix.from_bytes(WaveletMatrix.of(ids).to_bytes(), n)
        few.access(5)
        assert len(few.opened) <= 2 * few.bits


def test_wavelet_matrix():
    ids = np.random.default_rng(1).integers(0, 300, 5000).astype(np.uint32)
    m = WaveletMatrix.from_bytes(WaveletMatrix.of(ids).to_bytes(), len(ids))
    assert (m.tokens() == ids).all() and (m.access(np.arange(5000)) == ids).all()
    for v in (0, 7, 299, 300, 5000):
        assert m.count(v) == (ids == v).sum() and (m.occurrences(v) == np.flatnonzero(ids == v)).all()
        assert m.count(v, 100, 4001) == (ids[100:4001] == v).sum()


def bench_rows():
    r = random.Random(9)
    words = [f"w{i}" for i in range(40)]
    items = [(i, " ".join(r.choices(words, k=n))) for i, n in enumerate([30, 12, 10, 9, 3, 1, 0, 25])] + [(20, None), (21, "..."), (1, "dup id " + " ".join(words[:12])), (None, " ".join(words[10:22]))]
    items.append((22, items[0][1]))
    docs = []
    for i in range(80):
        w = r.choices(words, k=r.randint(0, 30))
        if i % 3 == 0:
            src = items[r.choice([0, 1, 2, 3, 4, 7])][1].upper().split()
            a = r.randint(0, max(0, len(src) - 11))
            w[5:5] = src[a : a + r.randint(9, 12)]
        docs.append((i, r.choice([" ", ", ", "\n"]).join(w)))
    docs += [(90, None), (91, ""), (92, "w1"), (90, items[0][1]), (93, "-- !!")]
    return docs, items


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("items_mb", [16.0, 0.0001])
def test_decontaminate(spark, items_mb):
    docs, items = bench_rows()
    d = spark.createDataFrame([(*x, "t") for x in docs], "doc_id long, text string, item_id string")
    b = spark.createDataFrame(items, "item_id long, text string")
    windows = {}
    for name, t in items:
        w = words_of(t)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add("null" if name is None else str(name))
    want = []
    for i, t in docs:
        w, hit, names = words_of(t), set(), set()
        for x, own in windows.items():
            for a in range(len(w) - len(x) + 1):
                if tuple(w[a : a + len(x)]) == x:
                    hit |= set(range(a, a + len(x)))
                    names |= own
        want.append((i, len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit)))
    assert sorted(tuple(x)[:6] for x in hits(d, b, items_mb=items_mb).collect()) == sorted(want)
    clean = without_hits(d, b, items_mb=items_mb)
    assert clean.columns == d.columns and clean.count() == sum(not x[-1] for x in want)
    found = longest_matches(d, b, items_mb=items_mb).collect()
    assert {r.doc_id for r in found} == {x[0] for x in want if x[-1]}
    assert sorted(map(tuple, found), key=str) == sorted(brute_matches(docs, items), key=str)


def brute_matches(docs, items, window=10):
    """Every run of equal words on a diagonal that has a window, or a whole shorter item."""
    out = []
    for i, t in docs:
        w, seen = words_of(t), set()
        for name, x in items:
            v = words_of(x)
            for d in range(-len(v), len(w)):
                a = max(0, -d)
                while v and a < len(v) and a + d < len(w):
                    e = a
                    while e < len(v) and e + d < len(w) and v[e] == w[e + d]:
                        e += 1
                    if e - a >= min(window, len(v)):
                        seen.add((i, None if name is None else str(name), a, a + d, e - a))
                    a = e + 1
        out += seen
    return out


def test_longest_matches(spark):
    """Windows that repeat inside of an item do not join across its end."""
    d = spark.createDataFrame([(1, "a " * 40), (2, "x " + "a " * 10 + "b"), (3, "null end")], "doc_id long, text string")
    b = spark.createDataFrame([("i", "a " * 10 + "b"), (None, "null end"), ("null", "other item")], "item_id string, text string")
    got = sorted(map(tuple, longest_matches(d, b).collect()), key=str)
    assert [x for x in got if x[0] == 1] == sorted(((1, "i", 0, at, 10) for at in range(31)), key=str)
    assert [x for x in got if x[0] > 1] == [(2, "i", 0, 1, 11), (3, None, 0, 0, 2)]
    assert {x.doc_id: (x.n_items, x.longest) for x in hits(d, b).collect()} == {1: (1, 10), 2: (1, 11), 3: (1, 2)}


def test_no_items_or_documents(spark):
    docs, items = bench_rows()
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert not hits(d, b.limit(0)).filter("contaminated").count() and hits(d.limit(0), b).count() == 0


def test_a_process_keeps_its_words(spark):
    """Tasks of one process share what was merged, also words with characters that have no piece."""
    import public_tokenizers
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    texts = ["kept words \U0001f9ff\x00 stay", "kept words"]
    assert coded(frame(spark, texts), path).count() == 2 and PieceCoder.kept(path) is PieceCoder.kept(path)
    sp, coder = sentencepiece.SentencePieceProcessor(model_file=path), PieceCoder.kept(path)
    assert coder.encode(texts[0]) == sp.encode(texts[0]) and coder.words
    coder.learn([])
    assert coder.encode(texts[1]) == sp.encode(texts[1])
