"""Repeated windows by super-strings: the exchange that both substring operators use.

Every window of k units (words or bytes) has a minimiser, the smallest hash among its m-grams.
Consecutive windows of one document that share it travel as one string to the bucket which the
minimiser names, so all equal windows meet in one bucket. Equal strings of a block travel once,
with a mark, so a passage that a third of all rows hold reaches its bucket once per block. The
bucket answers each block with the windows that occur more than once; the block, which is brought
together with its answers, spreads them over its own occurrences.

The strings at the edges of a passage that many documents hold differ, yet share a minimiser. Where
the strings of one minimiser exceed a bound, its windows travel one by one to further buckets, dealt
by their content: equal windows still meet, and no bucket grows with a single minimiser.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import answer_blocks, block_texts, covered, each_block, from_blob, packed_blocks, ranges

SENT = "block long, bucket long, keys binary, sizes binary, many binary"
REPLY = "block long, bucket long, hits binary"


def heavy_minimisers(cut: tuple, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimisers whose distinct strings hold `least` bytes or more in a block, those bytes, and about
    how many bytes their windows have one by one."""
    starts, counts, minima, string = cut[:4]
    keys, own = np.unique(minima, return_inverse=True)
    held, apart = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    if len(keys):
        likely = np.flatnonzero((np.bincount(own, weights=cut[-1](starts, counts)) >= least)[own])
        seen: set[bytes] = set()
        for s, c, o in zip(starts[likely].tolist(), counts[likely].tolist(), own[likely].tolist()):
            key = string(s, c)
            if key not in seen:
                seen.add(key)
                held[o] += len(key)
                apart[o] += c * -(-len(key) * k // (c + k - 1))
    keep = held >= least
    return keys[keep], held[keep], apart[keep]


def heavy_overall(blocks: DataFrame, cut: Callable[[list[bytes]], tuple], k: int, bound: int) -> tuple[np.ndarray, int]:
    """All minimisers whose strings, distinct in each block, exceed `bound` bytes in total, and about
    the bytes of their windows. Below an even share of half the bound a block keeps a minimiser to
    itself, so what is missed is less than half the bound."""
    least = bound / 2 / max(1, blocks.count())

    def weigh(block: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        keys, held, apart = heavy_minimisers(cut(block_texts(blob)[1]), k, least)
        yield pa.RecordBatch.from_pydict({"minimiser": pa.array(keys.astype(np.uint64).view(np.int64)), "held": pa.array(held), "apart": pa.array(apart)})

    weighed = blocks.select("block", "blob").mapInArrow(each_block(weigh), "minimiser long, held long, apart long")
    heavy = weighed.groupBy("minimiser").agg(F.sum("held").alias("held"), F.sum("apart").alias("apart")).where(F.col("held") >= bound / 2).collect()
    return np.sort(np.array([r.minimiser for r in heavy], np.int64).view(np.uint64)), sum(r.apart for r in heavy)


def cut_into_buckets(cut: tuple, n_buckets: int, heavy: np.ndarray, n_further: int) -> tuple[dict, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct super-strings of each bucket, and first unit, bucket and number in it of each run.

    cut: first unit and number of windows of each run, its minimiser, and a function that gives a
    run's string and size. Runs of heavy minimisers are cut into single windows, for the n_further
    buckets from n_buckets on.
    """
    starts, counts, minima, string = cut
    alone = np.isin(minima, heavy)
    buckets = (minima % np.uint64(n_buckets)).astype(np.int64)
    if alone.any():
        times_each = np.where(alone, counts, 1)
        starts, buckets = ranges(starts, times_each), np.repeat(np.where(alone, -1, buckets), times_each)
        counts = np.repeat(np.where(alone, 1, counts), times_each)
    numbers = np.empty(len(starts), np.int64)
    found: dict[int, dict] = {}
    times: dict[int, list] = {}
    for i, (s, c, b) in enumerate(zip(starts.tolist(), counts.tolist(), buckets.tolist())):
        key = string(s, c)
        if b < 0:
            b = buckets[i] = n_buckets + xxhash.xxh3_64_intdigest(key) % n_further
        own = found.get(b)
        if own is None:
            own, times[b] = found.setdefault(b, {}), []
        k = own.setdefault(key, len(own))
        if k == len(times[b]):
            times[b].append((1, c))
        else:
            times[b][k] = (2, c)
        numbers[i] = k
    return {b: (list(own), times[b]) for b, own in found.items()}, starts, buckets, numbers


def equal_strings(rows: Iterator[tuple[bytes, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """The repeated ones among single windows, given by their bytes and lengths, as match() returns them."""
    first: dict[bytes, int] = {}
    marks, lengths, pairs, n = [], [], [], 0
    for data, sizes, many in rows:
        ends = np.cumsum(sizes, dtype=np.int64).tolist()
        for i, (a, e) in enumerate(zip([0, *ends[:-1]], ends), n):
            f = first.setdefault(data[a:e], i)
            if f != i:
                pairs += f, i
        marks.append(many)
        lengths.append(len(ends))
        n += len(ends)
    twice = np.concatenate([np.zeros(0, bool), *marks])
    twice[np.array(pairs, np.int64)] = True
    out, a = [], 0
    for m in lengths:
        hit = np.flatnonzero(twice[a : a + m])
        out.append(np.stack([hit, np.zeros_like(hit), np.ones_like(hit)], 1))
        a += m
    return out


def repeated_windows(
    docs: DataFrame,
    k: int,
    joiner: bytes,
    cut: Callable[[list[bytes]], tuple],
    match: Callable[[list[tuple[bytes, np.ndarray, np.ndarray]]], list[np.ndarray]],
    finish: Callable[[list, list[bytes], tuple, np.ndarray], pa.Table],
    schema: str,
    block_mb: float,
    bucket_mb: float,
    carry: tuple = (),
    n_buckets: int | None = None,
    known: DataFrame | None = None,
) -> DataFrame:
    """cut(texts) finds the runs, match(rows) the repeated windows of a bucket as (string, first
    window, window after the last) triples for each row, finish(ids, texts, cut, mask) the result.
    The last item of a cut is a function that gives the bytes of runs by first unit and windows.
    A block sends a row to each bucket at most, so rows grow as blocks times buckets: block_mb and
    bucket_mb, bounded by a task's memory, keep the rows of 1 TB at some hundred bytes and more.
    carry: further columns of docs that come along, as `carried_<name>`. n_buckets: a number of buckets
    that stays, by minimiser alone. known: strings of earlier texts, (bucket, level, keys, sizes)."""
    blocks, mb = packed_blocks(docs, block_mb, ("doc_id", "text", *carry))
    heavy, apart = (np.zeros(0, np.uint64), 0) if n_buckets else heavy_overall(blocks, cut, k, int(bucket_mb * (2 << 20)))
    n_buckets = n_buckets or max(16, round(mb / bucket_mb))
    n_further = 1 + int(apart / (bucket_mb * (1 << 20)))

    def send(block: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        _, texts = block_texts(blob)
        found = cut_into_buckets(cut(texts)[:4], n_buckets, heavy, n_further)[0]
        squeeze = zstandard.ZstdCompressor(level=3)
        rows = {name: [] for name in ("block", "bucket", "keys", "sizes", "many")}
        for b, (keys, times) in found.items():
            packed = np.array(times, np.int32).reshape(-1, 2)
            if b >= n_buckets:
                packed[:, 1] = [len(x) for x in keys]
            for name, value in zip(rows, (block, b, squeeze.compress((joiner if b < n_buckets else b"").join(keys)), squeeze.compress(packed[:, 1].tobytes()), squeeze.compress((packed[:, 0] > 1).tobytes()))):
                rows[name].append(value)
        if found:
            yield pa.RecordBatch.from_pydict(rows, pa.schema([("block", pa.int64()), ("bucket", pa.int64()), ("keys", pa.binary()), ("sizes", pa.binary()), ("many", pa.binary())]))

    def answer(rows: pa.Table, before: pa.Table | None = None) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        sent_rows = ((open_(key.as_py()), np.frombuffer(open_(size.as_py()), np.int32), np.frombuffer(open_(many.as_py()), bool)) for key, size, many in zip(rows["keys"], rows["sizes"], rows["many"]))
        if before is not None:
            hits = match(sent_rows, [strings_of(r) for r in before.sort_by("level").to_pylist()]) if rows.num_rows else []
        else:
            hits = (match if rows["bucket"][0].as_py() < n_buckets else equal_strings)(sent_rows)
        keep = pa.array([i for i, h in enumerate(hits) if len(h)], pa.int64())
        return pa.table({"block": rows["block"].take(keep), "bucket": rows["bucket"].take(keep), "hits": pa.array([hits[i].astype(np.int32).tobytes() for i in keep.to_pylist()], pa.binary())})

    def resolve(block: int, blob: bytes, replies: pa.Table) -> pa.Table:
        ids, texts = block_texts(blob)
        found = cut(texts)
        n_units = found[4]
        begin, end = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        if replies.num_rows:
            _, starts, buckets, numbers = cut_into_buckets(found[:4], n_buckets, heavy, n_further)
            order = np.lexsort((numbers, buckets))
            where, number = buckets[order], numbers[order]
            for b, blob_ in zip(replies["bucket"].to_pylist(), replies["hits"]):
                hit = np.frombuffer(blob_.as_py(), np.int32).reshape(-1, 3).astype(np.int64)
                lo, hi = np.searchsorted(where, [b, b + 1])
                first, last = (lo + np.searchsorted(number[lo:hi], hit[:, 0], side) for side in ("left", "right"))
                at = starts[order[ranges(first, last - first)]]
                begin.append(at + np.repeat(hit[:, 1], last - first))
                end.append(at + np.repeat(hit[:, 2] + k - 1, last - first))
        mask = covered(n_units, np.concatenate(begin), np.concatenate(end))
        result = finish(ids, texts, found, mask)
        rows = from_blob(blob) if carry else None
        for c in carry:
            result = result.append_column(f"carried_{c}", rows.column(c))
        return result

    for c in carry:
        schema += f", `carried_{c}` {dict(docs.dtypes)[c]}"

    sent = blocks.mapInArrow(each_block(send), SENT)
    by_bucket = sent.groupBy("bucket")
    replies = by_bucket.applyInArrow(lambda rows: answer(rows), REPLY) if known is None else by_bucket.cogroup(known.groupBy("bucket")).applyInArrow(lambda rows, before: answer(rows, before), REPLY)
    return answer_blocks(blocks, replies, resolve, schema)


def strings_of(row: dict) -> list[bytes]:
    """The strings of a level's row."""
    data, ends = zstandard.ZstdDecompressor().decompress(row["keys"]), np.cumsum(np.frombuffer(row["sizes"], np.int32)).tolist()
    return [data[a:e] for a, e in zip([0, *ends[:-1]], ends)]


def distinct_strings(docs: DataFrame, cut: Callable[[list[bytes]], tuple], n_buckets: int, block_mb: float) -> DataFrame:
    """(bucket, keys, sizes): the distinct strings of each block by bucket."""

    def send(block: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        found = cut_into_buckets(cut(block_texts(blob)[1])[:4], n_buckets, np.zeros(0, np.uint64), 1)[0]
        squeeze = zstandard.ZstdCompressor(level=3).compress
        yield pa.RecordBatch.from_pydict({
            "bucket": pa.array(list(found), pa.int64()), "keys": pa.array([squeeze(b"".join(keys)) for keys, _ in found.values()], pa.binary()),
            "sizes": pa.array([np.array([len(x) for x in keys], np.int32).tobytes() for keys, _ in found.values()], pa.binary()),
        })

    return packed_blocks(docs, block_mb)[0].mapInArrow(each_block(send), "bucket long, keys binary, sizes binary")


def merged_run(rows: pa.Table) -> pa.Table:
    """The distinct strings of a bucket's rows, sorted, as one row."""
    strings = sorted({s for r in rows.to_pylist() for s in strings_of(r)})
    return pa.table({
        "bucket": rows["bucket"][:1], "bytes": pa.array([sum(map(len, strings))], pa.int64()), "keys": pa.array([zstandard.ZstdCompressor(level=3).compress(b"".join(strings))], pa.binary()),
        "sizes": pa.array([np.array([len(x) for x in strings], np.int32).tobytes()], pa.binary()),
    })


def flagged_runs(flags: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Runs of True in flags, cut at the strings that begin at `starts`, as (string, from, to)."""
    if not flags.any():
        return np.zeros((0, 3), np.int64)
    own = np.searchsorted(starts, np.arange(len(flags)), "right") - 1
    edge = np.flatnonzero(flags & ~(np.concatenate(([False], flags[:-1])) & (np.concatenate(([-1], own[:-1])) == own)))
    after = np.flatnonzero(flags & ~(np.concatenate((flags[1:], [False])) & (np.concatenate((own[1:], [-1])) == own)))
    return np.stack([own[edge], edge - starts[own[edge]], after + 1 - starts[own[edge]]], 1)


def eights(data: np.ndarray, k: int, position: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The k units of windows as rows of 8-byte words, the last of which may overlap the one before."""
    each = 8 // data.itemsize
    data = np.ascontiguousarray(data)
    words = np.ndarray((max(0, len(data) - each + 1),), "<u8", data.data, 0, (data.itemsize,))
    span = np.unique(np.append(np.arange(0, k - each + 1, each), k - each))
    return lambda i: words[position[i][:, None] + span]


def equal_groups(hashes: np.ndarray, row: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """Which windows equal another one: sorted by hash, neighbours then compared unit by unit.

    row(positions) gives the units of windows as a matrix. Windows of one hash that differ are told
    apart by their content.
    """
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    twice = np.zeros(len(hashes), bool)
    at = np.flatnonzero(same)
    wrong = []
    for i in range(0, len(at), 1 << 14):
        part = at[i : i + (1 << 14)]
        ok = (row(order[part]) == row(order[part + 1])).all(1)
        twice[order[part[ok]]] = twice[order[part[ok] + 1]] = True
        wrong.append(part[~ok])
    for h in np.unique(hashes[order[np.concatenate(wrong)]]) if wrong else ():
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(hashes == h):
            first = seen.setdefault(row(np.array([i])).tobytes(), i)
            twice[[first, i]] |= first != i
    return twice
