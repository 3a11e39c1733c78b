"""Token-ID output (operator 4): one wavelet matrix per shard in compressed binary files.

Documents are encoded word by word (white space always ends a token of this vocabulary, so equal
words have equal ids and each is encoded once; words are told apart on arrays, by hash and content), dealt by doc_id ranges, and packed into shards. A
shard is one row of a Parquet file: the bit-planes of its ids, from the highest bit down, each
plane ordering the ids stably by the bits above, with the ones before every 512 bits (a thirty-second of
the planes' size in the file). Access, counting and occurrence lookup walk the planes by rank and select; they open
the stretches of 16 KB they touch, each compressed by itself. Reading all ids opens every stretch.

A null or empty text has the end id alone. Rows with equal doc_id stay next to each other; a null
doc_id comes first. Other columns are not read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import LOW_BYTES, hashes_at, looked_up, ranges, scratch, table, text_chunks, texts_of, with_text, word_places, written

SCHEMA = "doc_id long, n_tokens long, ids binary"
SHARD = "part long, shard long, n_ids long, doc_ids binary, known binary, sizes binary, matrix binary"


BLOCK, STRETCH = 512, 256  #: bits between two entries of a rank directory; blocks compressed together


class WaveletMatrix:
    """Rank and select over bit-planes: ids[i], count(id, before) and occurrences(id).

    frames: plane by plane, its compressed stretches. ranks: for each plane the ones before each block.
    """

    def __init__(self, frames: list[list[bytes]], ranks: np.ndarray, n: int):
        self.frames, self.ranks, self.n, self.bits = frames, ranks.astype(np.int64), n, len(frames)
        self.zeros = n - self.ranks[:, -1] if self.bits else np.zeros(0, np.int64)
        self.opened: dict[tuple[int, int], np.ndarray] = {}

    @classmethod
    def of(cls, ids: np.ndarray) -> WaveletMatrix:
        n, squeeze = len(ids), zstandard.ZstdCompressor(level=1).compress
        bits = max(1, int(ids.max()).bit_length()) if n else 1
        blocks = -(-n // BLOCK)
        frames, ranks = [], np.zeros((bits, blocks + 1), np.uint32)
        for level in range(bits):
            up = (ids & ids.dtype.type(1 << (bits - 1 - level))) != 0
            plane = np.zeros(blocks * BLOCK // 8, np.uint8)
            own = np.packbits(up, bitorder="little")
            plane[: len(own)] = own
            ranks[level, 1:] = np.cumsum(np.bitwise_count(plane.view(np.uint64)).reshape(-1, BLOCK // 64).sum(1, dtype=np.uint32))
            step = STRETCH * BLOCK // 8
            frames.append([squeeze(plane[i : i + step].tobytes()) for i in range(0, len(plane), step)])
            ids = np.concatenate([ids.take(np.flatnonzero(~up)), ids.take(np.flatnonzero(up))])
        return cls(frames, ranks, n)

    def stretch(self, level: int, k: int) -> np.ndarray:
        """The blocks of a stretch, a row of 64-bit words each."""
        if (level, k) not in self.opened:
            self.opened[level, k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self.frames[level][k]), np.uint64).reshape(-1, BLOCK // 64)
        return self.opened[level, k]

    def blocks(self, level: int, block: np.ndarray) -> np.ndarray:
        """The words of blocks; zeros after the last one."""
        out = np.zeros((len(block), BLOCK // 64), np.uint64)
        for k in np.unique(block[block < self.ranks.shape[1] - 1] // STRETCH).tolist():
            at = np.flatnonzero(block // STRETCH == k)
            own = self.stretch(level, k)
            at = at[block[at] % STRETCH < len(own)]
            out[at] = own[block[at] % STRETCH]
        return out

    def ranked(self, level: int, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ones of a plane before each position, and the bit there (0 after the last)."""
        words, inner = self.blocks(level, i // BLOCK), i % BLOCK
        room = np.clip(inner[:, None] - np.arange(0, BLOCK, 64), 0, 64).astype(np.uint64)
        mask = np.where(room == 64, ~np.uint64(0), (np.uint64(1) << (room & np.uint64(63))) - np.uint64(1))
        bit = words[np.arange(len(i)), inner // 64] >> (inner % 64).astype(np.uint64) & np.uint64(1)
        return self.ranks[level][i // BLOCK] + np.bitwise_count(words & mask).sum(1, dtype=np.int64), bit.astype(np.int64)

    def rank1(self, level: int, i: np.ndarray) -> np.ndarray:
        return self.ranked(level, i)[0]

    def select(self, level: int, up: int, k: np.ndarray) -> np.ndarray:
        """Where a plane has its k-th one, or zero, counted from 0."""
        before = self.ranks[level] if up else np.arange(self.ranks.shape[1]) * BLOCK - self.ranks[level]
        block = np.searchsorted(before, k, "right") - 1
        words = self.blocks(level, block)
        bits = np.unpackbits(words.view(np.uint8), axis=1, bitorder="little") == up
        return block * BLOCK + (np.cumsum(bits, 1, dtype=np.int16) > (k - before[block])[:, None]).argmax(1)

    def access(self, i) -> np.ndarray:
        shape, i = np.shape(i), np.atleast_1d(np.asarray(i, np.int64)).ravel()
        value = np.zeros(len(i), np.int64)
        for level in range(self.bits):
            before, bit = self.ranked(level, i)
            i = np.where(bit == 1, self.zeros[level] + before, i - before)
            value = value * 2 + bit
        return value.reshape(shape)

    def interval(self, value: int, a, b) -> tuple[np.ndarray, np.ndarray]:
        """Where the occurrences of value among each [a, b) stand below the last plane."""
        a, b = np.atleast_1d(np.asarray(a, np.int64)), np.atleast_1d(np.asarray(b, np.int64))
        if value >> self.bits:
            return a * 0, a * 0
        for level in range(self.bits):
            low, high = np.split(self.rank1(level, np.concatenate((a, b))), 2)
            a, b = (low + self.zeros[level], high + self.zeros[level]) if value >> (self.bits - 1 - level) & 1 else (a - low, b - high)
        return a, b

    def count(self, value: int, a=0, b=None):
        """How often value comes in [a, b); a and b may be arrays."""
        low, high = self.interval(value, a, self.n if b is None else b)
        return high - low if np.ndim(a) else int(high[0] - low[0])

    def occurrences(self, value: int) -> np.ndarray:
        """Positions of value, ascending: select upwards through the planes."""
        a, b = self.interval(value, 0, self.n)
        at = np.arange(int(a[0]), int(b[0]))
        for level in reversed(range(self.bits)):
            up = value >> (self.bits - 1 - level) & 1
            at = self.select(level, up, at - (self.zeros[level] if up else 0))
        return at

    def tokens(self) -> np.ndarray:
        """All ids, from the last plane up."""
        ids = np.zeros(self.n, np.uint16 if self.bits <= 16 else np.uint32)
        for level in reversed(range(self.bits)):
            plane = np.concatenate([self.stretch(level, k) for k in range(len(self.frames[level]))] or [np.zeros((0, BLOCK // 64), np.uint64)]).view(np.uint8).ravel()
            up = np.unpackbits(plane, count=self.n, bitorder="little").view(bool)
            back, zeros = np.empty_like(ids), int(self.zeros[level])
            back[np.flatnonzero(~up)], back[np.flatnonzero(up)] = ids[:zeros], ids[zeros:] | ids.dtype.type(1 << (self.bits - 1 - level))
            ids = back
        return ids.astype(np.uint32)

    def to_bytes(self) -> bytes:
        """Number of planes, sizes of stretches and of the directory, the directory, the stretches."""
        ranks = zstandard.ZstdCompressor(level=1).compress(np.diff(self.ranks, axis=1).astype("<u2").tobytes())
        flat = [f for own in self.frames for f in own]
        return np.array([self.bits, len(ranks), *map(len, flat)], "<u4").tobytes() + ranks + b"".join(flat)

    @classmethod
    def from_bytes(cls, data: bytes, n: int) -> WaveletMatrix:
        bits, size = np.frombuffer(data, "<u4", 2).tolist()
        blocks = -(-n // BLOCK)
        each = -(-blocks // STRETCH)
        head = 8 + 4 * bits * each
        ones = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[head : head + size]), "<u2").reshape(bits, blocks)
        ranks = np.concatenate((np.zeros((bits, 1), np.int64), np.cumsum(ones, 1, dtype=np.int64)), 1)
        ends = head + size + np.cumsum(np.frombuffer(data, "<u4", bits * each, 8), dtype=np.int64)
        cut = [head + size, *ends.tolist()]
        return cls([[data[cut[i] : cut[i + 1]] for i in range(level * each, (level + 1) * each)] for level in range(bits)], ranks, n)


#: The normalizer and the splitting pattern for which words are cut before the library sees them.
NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

#: Words of visible ASCII and small Latin-1 letters stay as they are under NORMAL; on them, a line each, this is
#: SPLIT, where {} stands for the characters that spell the bytes of small Latin-1 letters.
CUT = r"'s|'t|'re|'ve|'m|'ll|'d|[a-z{}]+|[0-9]|[!-/:-@\[-`{{-~]+|\n"
PLAIN_BYTE = np.isin(np.arange(256), [*b"\n", *range(0x21, 0x41), *range(0x5B, 0x7F)])
SMALL_BYTE = np.isin(np.arange(256), [*range(0x9F, 0xB7), *range(0xB8, 0xC0)])  #: after 0xC3
SIGN_BYTE = np.isin(np.arange(256), [*range(0x21, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)])
ALNUM_BYTE = np.isin(np.arange(256), [*b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"])


def roomy(a: np.ndarray, n: int) -> np.ndarray:
    """a with room for n values at least, grown to twice its length."""
    return a if n <= len(a) else np.concatenate((a, np.zeros(max(n - len(a), len(a)), a.dtype)))


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each position on, as one number."""
    return np.ndarray((max(0, len(data) - 7),), "<u8", data.data, 0, (1,))


class WordEncoder:
    """Ids of words as the tokenizers library gives them, each distinct word encoded once.

    If the file normalizes by NORMAL and splits by SPLIT, plain words are cut here and their pieces go
    to the library's merges, without the steps that would not change them. All other words take the
    library's whole way.

    Words are found again by 64-bit hashes in a sorted array and compared byte by byte with the word that
    is kept; one that only shares a hash is encoded for itself. A process keeps its encoder from task to
    task; with over `most` words it starts anew.
    """

    def __init__(self, path: str, most: int = 1_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        made = json.loads(self.tokenizer.to_str())
        cuts = (made["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
        self.lowers = (made["normalizer"] or {}).get("normalizers") == NORMAL and [c.get("type") for c in cuts] == ["Split", "ByteLevel"] and cuts[0]["pattern"] == {"Regex": SPLIT}
        if self.lowers:
            self.merged = self.tokenizer.model.tokenize
            spelled = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
            second = {chr(b): spelled(bytes([0xC3, b]).decode())[0][0] for b in np.flatnonzero(SMALL_BYTE).tolist()}
            self.respelled = {b: own[1] for b, own in second.items() if own[1] != b}
            self.cut = re.compile(CUT.format("".join({c for own in second.values() for c in own}))).findall
        self.reset()

    def lowered(self, text: bytes) -> bytes:
        """A-Z lowered where the file does so, unless a mark could join a letter or a special token be meant."""
        return text.lower() if self.lowers and b"\xcc" not in text and b"<|" not in text else text

    def split(self, text: bytes) -> list[bytes]:
        return self.lowered(text).split()

    @staticmethod
    @functools.cache
    def kept(path: str) -> WordEncoder:
        """This process's encoder."""
        return WordEncoder(path)

    def reset(self):
        self.hashes, self.numbers = np.zeros(0, np.uint64), np.zeros(0, np.int32)  # of known words, by hash
        self.known = self.used = self.spelt = 0
        self.ids, self.first, self.size = np.zeros(1 << 16, np.uint32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.letters, self.begin, self.length = np.zeros(1 << 16, np.uint8), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)

    def whole(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of each word and all ids in a row. In small batches: few objects live at a time."""
        size, flat = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for i in range(0, len(words), 2_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in words[i : i + 2_000]], add_special_tokens=False)]
            size.append(np.fromiter(map(len, found), np.int64, len(found)))
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32, int(size[-1].sum())))
        return np.concatenate(size), np.concatenate(flat)

    def pieced(self, lines: bytes) -> tuple[np.ndarray, np.ndarray]:
        """As whole(), plain words by their pieces; a line end after each word."""
        text = lines.decode("latin-1")
        for byte, spelled in self.respelled.items():
            text = text.replace(byte, spelled)
        pieces = self.cut(text)
        numbers = dict(zip(dict.fromkeys(pieces), count()))
        codes = looked_up(numbers, pieces, np.int64)
        ids, ends = [], []
        for piece in numbers:
            if piece != "\n":
                ids += [t.id for t in self.merged(piece)]
            ends.append(len(ids))
        size, flat = np.diff(np.array(ends, np.int64), prepend=0), np.array(ids, np.uint32)
        sizes = size.take(codes)
        return np.diff(np.cumsum(sizes)[codes == numbers.get("\n")], prepend=0), flat.take(ranges((np.array(ends, np.int64) - size).take(codes), sizes))

    def asked(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """As whole(), plain words by their pieces."""
        if not self.lowers:
            return self.whole(words)
        lines = np.frombuffer(b"\n".join([*words, b""]), np.uint8)
        ends = np.flatnonzero(lines == 10)
        small = np.append(False, lines[:-1] == 0xC3) & SMALL_BYTE[lines]
        other = ~(PLAIN_BYTE[lines] | small | np.append(small[1:], False))
        other[1:] |= (lines[:-1] == ord("<")) & (lines[1:] == ord("|"))
        plain = np.ones(len(words), bool)
        plain[np.searchsorted(ends, np.flatnonzero(other))] = False
        mine = np.repeat(plain, np.diff(ends, prepend=-1))
        size = np.zeros(len(words), np.int64)
        size[plain], part = self.pieced(lines[mine].tobytes())
        size[~plain], rest = self.whole([words[i] for i in np.flatnonzero(~plain).tolist()])
        flat, mine = np.zeros(int(size.sum()), np.uint32), np.repeat(plain, size)
        flat[mine], flat[~mine] = part, rest
        return size, flat

    def learn(self, words: list[bytes]) -> np.ndarray:
        """The numbers that new words get."""
        size, flat = self.asked(words)
        letters, length = np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words))
        n, used, spelt = self.known + len(words), self.used + len(flat), self.spelt + len(letters)
        self.ids, self.letters = roomy(self.ids, used), roomy(self.letters, spelt + 8)
        self.ids[self.used : used], self.letters[self.spelt : spelt] = flat, letters
        for name, value in (("first", self.used + np.cumsum(size) - size), ("size", size), ("begin", self.spelt + np.cumsum(length) - length), ("length", length)):
            setattr(self, name, roomy(getattr(self, name), n))
            getattr(self, name)[self.known : n] = value
        numbers = np.arange(self.known, n, dtype=np.int32)
        self.known, self.used, self.spelt = n, used, spelt
        return numbers

    def same(self, whole: bytes, start: np.ndarray, length: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Which words of whole are the known ones of these numbers. Up to 8 bytes a hash belongs to one word
        of a length; longer words are compared byte by byte."""
        out = self.length.take(codes) == length
        word = np.flatnonzero((length > 8) & out)
        data, kept = eights(np.frombuffer(whole, np.uint8)), eights(self.letters)
        a, b, left = start[word], self.begin[codes[word]], length[word]
        for _ in range(8):
            equal = ((data[a] ^ kept[b]) & LOW_BYTES[np.minimum(left, 8)]) == 0
            out[word[~equal]] = False
            more = np.flatnonzero(equal & (left > 8))
            word, a, b, left = word[more], a[more] + 8, b[more] + 8, left[more] - 8
        for i, x, y, n in zip(word.tolist(), a.tolist(), b.tolist(), left.tolist()):
            out[i] = whole[x : x + n] == self.letters[y : y + n].tobytes()
        return out

    def words_of(self, whole: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the words. Up to 8 ASCII signs that end a word after a letter or digit are a word of
        their own, as SPLIT cuts there; not where a special token may be meant."""
        data = np.frombuffer(whole, np.uint8)
        start, end = word_places(data)
        if not self.lowers or b"<|" in whole:
            return start, end
        core, word = end.copy(), np.arange(len(end))
        for _ in range(8):
            word = word[SIGN_BYTE[data[core[word] - 1]] & (core[word] > start[word])]
            core[word] -= 1
        last, before = data[core - 1], data[core - 2]
        word = np.flatnonzero((core < end) & (core > start) & (ALNUM_BYTE[last] | (SMALL_BYTE[last] & (before == 0xC3) & (core > start + 1))))
        return np.insert(start, word + 1, core[word]), np.insert(end, word, core[word])

    def found(self, whole: bytes, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of some words of whole in a row, and how many each has."""
        if self.known > self.most:
            self.reset()
        hashes = hashes_at(whole, start, end)
        order = np.argsort(hashes)
        ordered = hashes.take(order)
        begun = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])[: len(ordered)])
        apart = ordered[begun]
        at = np.searchsorted(self.hashes, apart)
        known = np.append(self.hashes, 0)[at] == apart
        known &= at < len(self.hashes)
        number = np.zeros(len(apart), np.int64)
        number[known] = self.numbers[at[known]]
        if not known.all():
            new = order[begun[~known]]
            number[~known] = self.learn([whole[a:b] for a, b in zip(start[new].tolist(), end[new].tolist())])
            self.hashes, self.numbers = np.insert(self.hashes, at[~known], apart[~known]), np.insert(self.numbers, at[~known], number[~known])
        codes = np.zeros(len(order), np.int64)
        codes[order] = np.repeat(number, np.diff(np.append(begun, len(order))))
        ids, first, sizes = self.ids, self.first.take(codes), self.size.take(codes)
        odd = np.flatnonzero(~self.same(whole, start, end - start, codes))
        if len(odd):
            sizes[odd], more = self.asked([whole[a:b] for a, b in zip(start[odd].tolist(), end[odd].tolist())])
            first[odd] = len(ids) + np.cumsum(sizes[odd]) - sizes[odd]
            ids = np.concatenate((ids, more))
        return ids.take(ranges(first, sizes)), sizes

    def encode(self, texts: list[bytes], step: int = 1 << 20) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts (lowered ones, or words) in a row, and how many each has; `step` words at a time."""
        whole = b" ".join([*texts, b" " * 8])
        start, end = self.words_of(whole)
        ids, sizes = (np.concatenate(x) for x in zip(*(self.found(whole, start[i : i + step], end[i : i + step]) for i in range(0, len(start) or 1, step))))
        ends = np.searchsorted(start, np.cumsum([len(t) + 1 for t in texts]))
        return ids, np.diff(np.concatenate(([0], np.cumsum(sizes)))[ends], prepend=0)


def token_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """doc_id, n_tokens and ids (little-endian, the end id last; 2 bytes each if the vocabulary allows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.kept(path)
        kind = np.uint16 if encoder.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        for batch in text_chunks(batches):
            ids, own = encoder.encode([encoder.lowered(t) for t in texts_of(batch)])
            own += 1
            out = np.full(len(ids) + len(own), end_id, kind)
            keep = np.ones(len(out), bool)
            keep[np.cumsum(own) - 1] = False
            out[keep] = ids
            data = out.tobytes()
            at = np.concatenate(([0], np.cumsum(own))) * out.itemsize
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_tokens": pa.array(own), "ids": pa.array([data[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())], pa.binary())})

    return with_text(docs).mapInArrow(run, SCHEMA)


def write_shards(tokens: DataFrame, shards: int, shard_ids: int = 1 << 20) -> DataFrame:
    """The token files: rows in ascending doc_id order, one wavelet matrix of about shard_ids each."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard = TaskContext.get().partitionId(), 0
        ids, sizes, data = [], [], []

        def close():
            width = sum(map(len, data)) // sum(sizes)
            matrix = WaveletMatrix.of(np.frombuffer(b"".join(data), f"<u{width}"))
            row = (part, shard, matrix.n, np.array([x or 0 for x in ids], np.int64).tobytes(), np.array([x is not None for x in ids]).tobytes(), np.array(sizes, np.int64).tobytes(), matrix.to_bytes())
            return pa.RecordBatch.from_pydict({f.split()[0]: pa.array([v], pa.binary() if f.endswith("binary") else pa.int64()) for f, v in zip(SHARD.split(", "), row)})

        for batch in batches:
            for i, n, b in zip(batch.column("doc_id").to_pylist(), batch.column("n_tokens").to_pylist(), batch.column("ids").to_pylist()):
                ids.append(i)
                sizes.append(n)
                data.append(b)
                if sum_reached(sizes, shard_ids):
                    yield close()
                    shard, ids, sizes, data = shard + 1, [], [], []
        if ids:
            yield close()

    def sum_reached(sizes: list[int], limit: int) -> bool:
        pack.held = (0 if len(sizes) == 1 else pack.held) + sizes[-1]
        return pack.held >= limit

    return written(tokens.repartitionByRange(shards, "doc_id").sortWithinPartitions("doc_id").mapInArrow(pack, SHARD), 8 << 20, scratch_too=False)


def shard_starts(files: DataFrame, group: int = 4096) -> DataFrame:
    """part, shard, base (ids of all shards before): sums within a part, of parts within a group of
    them, and of groups, so that no task sees more than a group's rows or a row for each group."""
    before = lambda *by: Window.partitionBy(*by[:-1]).orderBy(by[-1]).rowsBetween(Window.unboundedPreceding, -1)
    summed = lambda rows, keys, name, *by: rows.select(*keys, F.coalesce(F.sum("n_ids").over(before(*by)), F.lit(0)).alias(name))
    own = files.select("part", "shard", "n_ids", F.floor(F.col("part") / group).alias("group"))
    parts = own.groupBy("group", "part").agg(F.sum("n_ids").alias("n_ids"))
    groups = parts.groupBy("group").agg(F.sum("n_ids").alias("n_ids"))
    in_part, in_group, in_all = summed(own, ("group", "part", "shard"), "x", "part", "shard"), summed(parts, ("part",), "y", "group", "part"), summed(groups, ("group",), "z", "group")
    return in_part.join(in_group, "part").join(in_all, "group").select("part", "shard", (F.col("x") + F.col("y") + F.col("z")).alias("base"))


def read_shards(files: DataFrame, end_id: int = 1) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, decoded from the files; first_id and last_id
    by access, end_ids (occurrences of the end id in the document) by rank."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                matrix = WaveletMatrix.from_bytes(r["matrix"], r["n_ids"])
                ids = matrix.tokens().astype("<u4").tobytes()
                sizes = np.frombuffer(r["sizes"], np.int64)
                ends = np.cumsum(sizes)
                first, last = np.split(matrix.access(np.concatenate((ends - sizes, ends - 1))), 2)
                crc = [zlib.crc32(ids[4 * a : 4 * e]) for a, e in zip((ends - sizes).tolist(), ends.tolist())]
                yield pa.RecordBatch.from_pydict({
                    "doc_id": pa.array(np.frombuffer(r["doc_ids"], np.int64), mask=~np.frombuffer(r["known"], bool)), "start": pa.array(ends - sizes + r["base"]), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(crc, pa.int64()),
                    "first_id": pa.array(first), "last_id": pa.array(last), "end_ids": pa.array(matrix.count(end_id, ends - sizes, ends)),
                })

    fields = "doc_id long, start long, n_tokens long, ids_crc32 long, first_id long, last_id long, end_ids long"
    return files.join(shard_starts(files), ["part", "shard"]).mapInArrow(unpack, fields)


def looked_up_tokens(files: DataFrame, token: int) -> DataFrame:
    """doc_id, token_at: every place of a token id in its document, by select; no shard is decoded."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                at = WaveletMatrix.from_bytes(r["matrix"], r["n_ids"]).occurrences(token)
                ends = np.cumsum(np.frombuffer(r["sizes"], np.int64))
                own = np.searchsorted(ends, at, "right")
                ids = pa.array(np.frombuffer(r["doc_ids"], np.int64), mask=~np.frombuffer(r["known"], bool))
                yield pa.RecordBatch.from_pydict({"doc_id": ids.take(pa.array(own)), "token_at": pa.array(at - np.concatenate(([0], ends))[own])})

    return files.mapInArrow(find, "doc_id long, token_at long")


def token_files(docs: DataFrame, path: str, end_id: int = 1, shard_ids: int = 1 << 20) -> DataFrame:
    """Encode docs and write the files; the DataFrame reads them (columns of SHARD)."""
    with scratch(docs.sparkSession):  # the plain ids go once the files are written
        tokens = written(token_rows(docs, path, end_id))
        total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
        return write_shards(tokens, max(4, -(-total // (2 * shard_ids))), shard_ids)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return read_shards(token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json")))


QUERIES = {"op4_token_files": op4_token_files}
