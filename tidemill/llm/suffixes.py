"""Suffix-array dedup over bytes (operator 2): a logarithmic family of suffix arrays per bucket.

Super-strings (see windows.py) reach the bucket of their minimiser, a 40-byte gram. There they come
in batches. Each batch gets a suffix array of the suffixes that start at the grams; it is merge-
scanned against every existing level for neighbours that share the gram (matches of 40 bytes or more).
The strings so found get an array of the suffixes at all their window starts, in which neighbours with
a common prefix of 200 bytes are the repeated windows. The batch then becomes a level, and levels of
about equal size merge, so a suffix is merged a logarithmic number of times.

`SuffixFamily` keeps the levels in a folder: later batches are scanned against what came before.

A null or empty text has no bytes. Repeated rows lose what they share. No row is dropped.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import mixed, ranges, runs_of, sliding_min, table, written
from tidemill.llm.windows import distinct_strings, flagged_runs, merged_run, repeated_windows

SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
PIECE = 1 << 20


def gram_hashes(data: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q bytes (a multiple of 8) from each position."""
    n = len(data) - q + 1
    data = np.ascontiguousarray(data)
    x = np.zeros(n, np.uint64)
    for i in range(0, q, 8):
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(29)
        x += np.ndarray((n,), "<u8", data.data, i, (1,))
    return mixed(x)


def super_strings(texts: list[bytes], k: int, q: int) -> tuple:
    """Runs of consecutive k-byte windows that share their minimiser, in texts laid end to end."""
    whole = b"".join(texts)
    data = np.frombuffer(whole, np.uint8)
    starts, counts, minima = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    a = 0
    for t in texts:
        e = a + len(t)
        for p in range(a, e - k + 1, PIECE):
            least = sliding_min(gram_hashes(data[p : min(e, p + PIECE + k - 1)], q), k - q + 1)
            fresh = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
            starts.append(fresh + p)
            counts.append(np.diff(np.append(fresh, len(least))))
            minima.append(least[fresh])
        a = e
    return np.concatenate(starts), np.concatenate(counts), np.concatenate(minima), lambda s, c: whole[s : s + c + k - 1], len(whole), whole, lambda s, c: c + k - 1


class Family:
    """Levels of sorted (suffix, string number) pairs; level sizes at least double from last to first."""

    def __init__(self, k: int, q: int):
        self.k, self.q = k, q
        self.levels: list[list[tuple[bytes, int]]] = []
        self.numbers: dict[bytes, int] = {}
        self.strings: list[bytes] = []
        self.flags: list[np.ndarray] = []

    def add(self, strings: list[bytes], many: np.ndarray) -> list[int]:
        """Insert a batch; returns the number of each of its strings."""
        numbers, fresh = [], []
        for s, twice in zip(strings, many.tolist()):
            i = self.numbers.get(s)
            if i is None:
                i = self.numbers[s] = len(self.strings)
                self.strings.append(s)
                self.flags.append(np.full(len(s) - self.k + 1, twice))
                fresh.append(i)
            else:
                self.flags[i][:] = True
            numbers.append(i)
        suffixes, inner = self.anchored(fresh)
        array = sorted(zip(suffixes, fresh))
        self.scan(array, inner)
        self.levels.append(array)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            top = self.levels.pop()
            self.levels[-1] += top
            self.levels[-1].sort()  # two sorted runs: one linear merge
        return numbers

    def anchored(self, fresh: list[int]) -> tuple[list[bytes], list[int]]:
        """The suffix of each string from its first minimal gram on; the strings that hold it again."""
        if not fresh:
            return [], []
        sizes = np.array([len(self.strings[i]) for i in fresh])
        grams = gram_hashes(np.frombuffer(b"".join([self.strings[i] for i in fresh]) + bytes(self.q), np.uint8), self.q)
        out, inner, a = [], [], 0
        for i, n in zip(fresh, sizes.tolist()):
            at = int(np.argmin(grams[a : a + self.k - self.q + 1]))  # the first window holds the minimiser of the run
            out.append(self.strings[i][at:])
            if (grams[a + at + 1 : a + n - self.q + 1] == grams[a + at]).any():
                inner.append(i)
            a += n
        return out, inner

    def scan(self, array: list[tuple[bytes, int]], inner: list[int]) -> None:
        """Gather the strings whose suffixes share a gram with the batch's, in it and in all levels."""
        q, touched, a = self.q, inner, 0
        while a < len(array):
            gram, b = array[a][0][:q], a + 1
            while b < len(array) and array[b][0][:q] == gram:
                b += 1
            group = [i for _, i in array[a:b]]
            for level in self.levels:
                at = bisect_left(level, (gram,))
                while at < len(level) and level[at][0][:q] == gram:
                    group.append(level[at][1])
                    at += 1
            if len(group) > 1:
                touched += group
            a = b
        if touched:
            self.compare(list(dict.fromkeys(touched)))

    def compare(self, touched: list[int]) -> None:
        """Mark the windows of these strings that come more than once among them."""
        k = self.k
        data = np.frombuffer(b"".join([self.strings[i] for i in touched]), np.uint8)
        counts = np.array([len(self.flags[i]) for i in touched])
        first = np.cumsum(counts + k - 1) - (counts + k - 1)
        twice = repeated_prefixes(data, ranges(first, counts), k)
        a = 0
        for i, n in zip(touched, counts.tolist()):
            self.flags[i] |= twice[a : a + n]
            a += n

    def load(self, strings: list[bytes]) -> None:
        """A level from an earlier batch; its windows are not looked at among themselves."""
        fresh = list(range(len(self.strings), len(self.strings) + len(strings)))
        self.strings += strings
        self.flags += [np.zeros(len(s) - self.k + 1, bool) for s in strings]
        self.numbers.update(zip(strings, fresh))
        self.levels.append(sorted(zip(self.anchored(fresh)[0], fresh)))


def repeated_prefixes(data: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    """Which of the suffixes at `starts` share their first k bytes with another: the suffixes are sorted
    8 bytes at a time, and only those that still have an equal neighbour are sorted on."""
    words = np.ndarray((max(0, len(data) - 7),), ">u8", data.data, 0, (1,))
    out = np.zeros(len(starts), bool)
    at, first = np.arange(len(starts)), np.zeros(min(1, len(starts)), np.int64)  # suffixes in order; where groups begin
    for depth in [*range(0, k - 7, 8), *([k - 8] if k % 8 else [])]:
        if not len(at):
            break
        key = words[starts[at] + depth].astype(np.uint64)
        size = np.diff(np.append(first, len(at)))
        mixed_groups = np.repeat(np.logical_or.reduceat(key != np.repeat(key[first], size), first), size)
        if mixed_groups.any():
            group = np.repeat(np.arange(len(first)), size)
            some = np.flatnonzero(mixed_groups)
            order = some[np.argsort(key[some]) if len(first) == 1 else np.lexsort((key[some], group[some]))]
            at[some], key[some] = at[order], key[order]
            fresh = np.concatenate(([True], (key[1:] != key[:-1]) | (group[1:] != group[:-1])))
            keep = ~(fresh & np.append(fresh[1:], True))  # groups of two or more
            at, fresh = at[keep], fresh[keep]
            first = np.flatnonzero(fresh)
        elif len(at) == 1:
            return out
    out[at] = True
    return out


def matcher(k: int, q: int, batch_bytes: int):
    def match(rows, levels: list[list[bytes]] = ()) -> list[np.ndarray]:
        family = Family(k, q)
        for strings in levels:
            family.load(strings)
        numbers: list[list[int]] = []
        strings, marks, lengths, held = [], [], [], 0

        def close():
            own = family.add(strings, np.concatenate(marks))
            a = 0
            for n in lengths:
                numbers.append(own[a : a + n])
                a += n

        for data, count, many in rows:
            ends = np.cumsum(count + k - 1).tolist()
            strings += [data[a:e] for a, e in zip([0, *ends[:-1]], ends)]
            marks.append(many)
            lengths.append(len(ends))
            held += len(data)
            if held >= batch_bytes:
                close()
                strings, marks, lengths, held = [], [], [], 0
        if lengths:
            close()
        out = []
        for own in numbers:
            flags = np.concatenate([family.flags[i] for i in own])
            sizes = np.array([len(family.flags[i]) for i in own])
            out.append(flagged_runs(flags, np.cumsum(sizes) - sizes))
        return out

    return match


def finisher(texts_too: bool):
    def finish(ids, texts, found, mask) -> pa.Table:
        data = np.frombuffer(found[5], np.uint8)
        removed = np.concatenate(([0], np.cumsum(mask)))
        out = {"n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
        a = 0
        for t in texts:
            e = a + len(t)
            gone = int(removed[e] - removed[a])
            kept = data[a:e][~mask[a:e]].tobytes() if gone else t
            out["n_bytes"].append(len(t))
            out["n_removed"].append(gone)
            out["n_spans"].append(len(runs_of(mask[a:e])[0]) if gone else 0)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if texts_too:
                out["kept"].append(kept)
            a = e
        result = pa.table({"doc_id": pa.array(ids, pa.int64())} | {c: pa.array(out[c], pa.string() if c == "kept_sha256" else pa.int64()) for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")})
        return result.append_column("kept", pa.array(out["kept"], pa.binary())) if texts_too else result

    return finish


def remove_repeated_bytes(docs: DataFrame, k: int = 200, q: int = 40, block_mb: float = 8.0, bucket_mb: float = 5.0, batch_mb: float = 3.0, texts_too: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row, and with texts_too the kept bytes.

    k: bytes of a window. q: bytes of a gram, a multiple of 8 up to k. batch_mb: string bytes of a batch.
    """
    schema = SCHEMA + (", kept binary" if texts_too else "")
    return repeated_windows(docs, k, b"", lambda texts: super_strings(texts, k, q), matcher(k, q, int(batch_mb * (1 << 20))), finisher(texts_too), schema, block_mb, bucket_mb)


class SuffixFamily:
    """The index kept in a folder of the cluster: a table for each level, a row for each bucket and block.

    add(batch) answers a batch as remove_repeated_bytes does, but counts windows of all earlier batches
    too (those documents stay as they are), and makes the batch a level; while the level before it is
    less than twice its size, the two merge. Strings are dealt by minimiser among `buckets` buckets."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = 256, k: int = 200, q: int = 40, batch_mb: float = 3.0):
        self.spark, self.folder, self.buckets, self.k, self.q, self.batch_mb = spark, folder, buckets, k, q, batch_mb
        self.levels: list[tuple[str, int]] = []  # path and bytes of strings, the largest first
        self.made = 0

    def add(self, batch: DataFrame, block_mb: float = 8.0) -> DataFrame:
        known = None
        for i, (path, _) in enumerate(self.levels):
            own = self.spark.read.parquet(path).withColumn("level", F.lit(i))
            known = own if known is None else known.unionByName(own)
        k, q = self.k, self.q
        cut = lambda texts: super_strings(texts, k, q)
        match = matcher(k, q, int(self.batch_mb * (1 << 20)))
        found = written(repeated_windows(batch, k, b"", cut, match, finisher(False), SCHEMA, block_mb, block_mb, n_buckets=self.buckets, known=known))
        self.levels.append(self.stored(distinct_strings(batch, cut, self.buckets, block_mb)))
        while len(self.levels) > 1 and self.levels[-2][1] < 2 * self.levels[-1][1]:
            a, b = (self.spark.read.parquet(self.levels.pop()[0]) for _ in range(2))
            self.levels.append(self.stored(b.unionByName(a)))
        return found

    def stored(self, strings: DataFrame) -> tuple[str, int]:
        """Rows (bucket, keys, sizes) as a level: one sorted run of distinct strings for each bucket."""
        self.made += 1
        path = f"{self.folder}/level-{self.made}"
        strings.groupBy("bucket").applyInArrow(merged_run, "bucket long, bytes long, keys binary, sizes binary").write.parquet(path)
        return path, self.spark.read.parquet(path).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(table(spark, sf_dir, "documents"))


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
