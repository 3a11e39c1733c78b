"""Benchmark decontamination (operator 3): suffix arrays over shards of the training text.

A shard is a few MB of documents. Its suffix array holds every word position whose word occurs in the
benchmark (no other can begin a match), sorted by the `window` words from there on. Every suffix of
every benchmark item is looked up in it by binary search, which gives all places that hold its window;
places of one item on one diagonal, next to each other in both, join to the longest verbatim match.

Nothing is shuffled: the benchmark travels, packed in blocks of at most about `items_mb`. One block is
broadcast as it is. More than one go by in passes, one block broadcast at a time and released after
it; each pass writes what it found, for documents with a match alone, and what all passes found is
brought together by row. An item is never cut, so a block is as large as its largest item at least.

A null text has no words and hits nothing; items without words have no window. An item of fewer words
than a window is one window. Equal items share their windows and all count. Rows with an equal item_id
count as one item; those with a null item_id are one item too, which is written as null in lists and
is not the item called "null". Repeated documents are judged alike. Other columns are not touched.
"""

from __future__ import annotations

import functools
import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import Numbered, covered, from_blob, looked_up, packed_blocks, ranges, table, text_chunks, texts_of, written

#: A-Z to a-z, digits, a-z and bytes above 0x7F as they are, all else to a space.
WORD_BYTES = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest long"
MATCH = "doc_id long, item_id string, item_word long, doc_word long, n_words long"


class Items:
    """The suffixes of some benchmark items as search keys: distinct windows, and where items hold them."""

    def __init__(self, names: list[str | None], texts: list[bytes], window: int):
        self.window, numbers = window, Numbered()
        words = [t.translate(WORD_BYTES).split() for t in texts]
        size = np.array([len(w) for w in words], np.int64)
        flat = looked_up(numbers, [x for w in words for x in w], np.int64) + 1
        self.words = dict(numbers)
        own_names = Numbered()
        item = np.array([own_names[(n is None, n)] for n in names], np.int64)
        self.names = [n for _, n in own_names]

        starts = np.maximum(size - window, -1) + 1
        starts[(size > 0) & (starts < 1)] = 1
        first = np.repeat(np.cumsum(size) - size, starts)
        offset = ranges(np.zeros_like(starts), starts)
        reach = np.minimum(window, np.repeat(size, starts))
        padded = np.append(flat, np.zeros(window, np.int64))[(first + offset)[:, None] + np.arange(window)] if len(first) else np.zeros((0, window), np.int64)
        padded = np.where(np.arange(window) < reach[:, None], padded, 0)
        self.low, at, which = np.unique(self.keys(padded), return_index=True, return_inverse=True)
        self.sizes = reach[at]
        self.high = self.keys(np.where(np.arange(window) < self.sizes[:, None], padded[at], 0xFFFFFFFF))
        order = np.argsort(which, kind="stable")
        self.owner, self.offset = np.repeat(item, starts)[order], offset[order]
        self.owner_count = np.bincount(which, minlength=len(self.low))
        self.owner_first = np.cumsum(self.owner_count) - self.owner_count

    def keys(self, rows: np.ndarray) -> np.ndarray:
        return np.ascontiguousarray(rows.astype(">u4")).view(f"S{4 * self.window}").ravel() if len(rows) else np.zeros(0, f"S{4 * self.window}")

    def places(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window and position of each occurrence in a shard of word ids that ends in `window` zeros."""
        at = np.flatnonzero(ids)
        if not len(self.low) or not len(at):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        suffixes = self.keys(ids[at[:, None] + np.arange(self.window)])
        order = np.argsort(suffixes)
        array = suffixes[order]
        first, last = np.searchsorted(array, self.low, "left"), np.searchsorted(array, self.high, "right")
        return np.repeat(np.arange(len(first)), last - first), at[order[ranges(first, last - first)]]

    def matches(self, which: np.ndarray, at: np.ndarray, own: np.ndarray) -> np.ndarray:
        """(document, item, item word, place, words) of the longest matches, from windows at places."""
        n = self.owner_count[which]
        entry = ranges(self.owner_first[which], n)
        rows = np.stack([np.repeat(own, n), self.owner[entry], np.repeat(at, n) - self.offset[entry], np.repeat(at, n), self.offset[entry], np.repeat(self.sizes[which], n)], 1)
        rows = np.unique(rows, axis=0)  # of repeated rows with one item_id
        fresh = np.ones(len(rows), bool)
        fresh[1:] = (rows[1:, :3] != rows[:-1, :3]).any(1) | (rows[1:, 3] > rows[:-1, 3] + 1)
        last = np.append(np.flatnonzero(fresh)[1:], len(rows)) - 1 if len(rows) else np.zeros(0, np.int64)
        return np.stack([rows[fresh, 0], rows[fresh, 1], rows[fresh, 4], rows[fresh, 3], rows[last, 3] + rows[last, 5] - rows[fresh, 3]], 1)


@functools.lru_cache(maxsize=1)
def indexed(block: str, blob: bytes, window: int) -> Items:
    """The index of a block, kept by the process until it works with another."""
    rows = from_blob(blob)
    return Items(rows.column("item_id").to_pylist(), texts_of(rows), window)


class Shard:
    """Documents of a batch laid end to end, a zero word after each."""

    def __init__(self, batch: pa.RecordBatch):
        self.words: list[bytes] = []
        counts = []
        for t in texts_of(batch):
            own = t.translate(WORD_BYTES).split()
            self.words += own
            counts.append(len(own))
        self.counts = np.array(counts, np.int64)
        self.spread = np.arange(len(self.words)) + np.repeat(np.arange(len(counts)), counts)
        self.first = np.cumsum(self.counts + 1) - self.counts - 1

    def search(self, items: Items) -> tuple[np.ndarray, np.ndarray]:
        """Hit mask over all words, and the longest matches."""
        ids = np.zeros(len(self.words) + len(self.counts) + items.window, np.int64)
        get = items.words.get
        ids[self.spread] = np.fromiter((get(w, -1) for w in self.words), np.int64, len(self.words)) + 1
        which, at = items.places(ids)
        mask = covered(len(ids), at, at + items.sizes[which])[self.spread]
        return mask, items.matches(which, at, np.searchsorted(self.first, at, "right") - 1)


def item_blocks(items: DataFrame, items_mb: float) -> tuple[DataFrame, list[int]]:
    """The benchmark in blocks of the shared folder, and their numbers."""
    named = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    held = named.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = named.coalesce(1 + int(held / (items_mb * (1 << 20))))  # about a block for each partition
    blocks = packed_blocks(few, items_mb, ("item_id", "text"))[0]
    return blocks, [r.block for r in blocks.select("block").orderBy("block").collect()]


def each_pass(docs: DataFrame, blocks: DataFrame, numbers: list[int], chunk_mb: float, window: int, fields: str, made) -> Iterator[DataFrame]:
    """For each block of items, made(batch, shard, items, mask, matches) over all of docs; lazily for
    one block, written for more, so that each broadcast is released before the next."""
    context = docs.sparkSession.sparkContext
    for block in numbers:
        blob = context.broadcast(blocks.where(F.col("block") == block).select("blob").first().blob)
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], blob=blob, name=name) -> Iterator[pa.RecordBatch]:
            items = indexed(name, blob.value, window)
            for batch in text_chunks(batches, chunk_mb):
                shard = Shard(batch)
                yield made(batch, shard, items, *shard.search(items))

        found = docs.mapInArrow(run, fields)
        if len(numbers) == 1:
            yield found
        else:
            yield written(found)
            blob.unpersist()


def digest(names) -> str:
    return hashlib.sha256(",".join(sorted("null" if x is None else x for x in names)).encode()).hexdigest()


def names_by_doc(n: int, items: Items, matches: np.ndarray) -> list[set]:
    out: list[set] = [set() for _ in range(n)]
    for d, i in np.unique(matches[:, :2], axis=0).tolist():
        out[d].add(items.names[i])
    return out


def longest_by_doc(n: int, matches: np.ndarray) -> np.ndarray:
    out = np.zeros(n, np.int64)
    np.maximum.at(out, matches[:, 0], matches[:, 4])
    return out


def hits(docs: DataFrame, items: DataFrame, window: int = 10, items_mb: float = 4.0, chunk_mb: float = 2.0) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, longest (words of the longest
    verbatim match) of every row."""
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    blocks, numbers = item_blocks(items, items_mb)

    def summed(counts, total, ids, names, longest) -> pa.RecordBatch:
        ends = np.cumsum(counts)
        hit = total[ends] - total[ends - counts]
        return pa.RecordBatch.from_pydict({
            "doc_id": ids, "n_words": pa.array(counts), "n_hit": pa.array(hit), "n_items": pa.array([len(x) for x in names], pa.int64()),
            "items_sha256": pa.array([digest(x) for x in names], pa.string()), "contaminated": pa.array(hit > 0), "longest": pa.array(longest),
        })

    if len(numbers) == 1:

        def whole(batch, shard, found, mask, matches) -> pa.RecordBatch:
            n = len(shard.counts)
            return summed(shard.counts, np.concatenate(([0], np.cumsum(mask))), batch.column("doc_id"), names_by_doc(n, found, matches), longest_by_doc(n, matches))

        return next(each_pass(plain, blocks, numbers, chunk_mb, window, SCHEMA, whole))

    keyed = written(plain.withColumn("row", F.monotonically_increasing_id()))

    def sparse(batch, shard, found, mask, matches) -> pa.RecordBatch:
        n, first = len(shard.counts), shard.first - np.arange(len(shard.counts))
        names, longest = names_by_doc(n, found, matches), longest_by_doc(n, matches)
        at = [d for d in range(n) if names[d]]
        bits = [np.packbits(mask[first[d] : first[d] + shard.counts[d]]).tobytes() for d in at]
        return pa.RecordBatch.from_pydict({"row": batch.column("row").take(pa.array(at, pa.int64())), "bits": pa.array(bits, pa.binary()), "names": pa.array([list(names[d]) for d in at], pa.list_(pa.string())), "longest": pa.array(longest[at], pa.int64())})

    parts = list(each_pass(keyed, blocks, numbers, chunk_mb, window, "row long, bits binary, names array<string>, longest long", sparse))
    nothing = keyed.sparkSession.createDataFrame([], "row long, bits binary, names array<string>, longest long")
    found = functools.reduce(DataFrame.unionByName, parts, nothing).groupBy("row").agg(F.collect_list("bits").alias("bits"), F.flatten(F.collect_list("names")).alias("names"), F.max("longest").alias("longest"))

    def brought(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches, chunk_mb):
            counts = np.array([len(t.translate(WORD_BYTES).split()) for t in texts_of(batch)], np.int64)
            mask = np.zeros(int(counts.sum()), bool)
            for a, n, bits in zip((np.cumsum(counts) - counts).tolist(), counts.tolist(), batch.column("bits").to_pylist()):
                for b in bits or ():
                    mask[a : a + n] |= np.unpackbits(np.frombuffer(b, np.uint8), count=n).astype(bool)
            names = [set(own or ()) for own in batch.column("names").to_pylist()]
            yield summed(counts, np.concatenate(([0], np.cumsum(mask))), batch.column("doc_id"), names, np.array([x or 0 for x in batch.column("longest").to_pylist()], np.int64))

    return keyed.join(found, "row", "left").mapInArrow(brought, SCHEMA)


def longest_matches(docs: DataFrame, items: DataFrame, window: int = 10, items_mb: float = 4.0, chunk_mb: float = 2.0) -> DataFrame:
    """doc_id, item_id, item_word, doc_word, n_words: every longest verbatim match of a window or more
    (of a whole item with fewer words), with where it starts in the item and in the document."""
    blocks, numbers = item_blocks(items, items_mb)

    def made(batch, shard, found, mask, matches) -> pa.RecordBatch:
        doc = matches[:, 0]
        return pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id").take(pa.array(doc)), "item_id": pa.array([found.names[i] for i in matches[:, 1].tolist()], pa.string()),
            "item_word": pa.array(matches[:, 2]), "doc_word": pa.array(matches[:, 3] - shard.first[doc]), "n_words": pa.array(matches[:, 4]),
        })

    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    parts = list(each_pass(plain, blocks, numbers, chunk_mb, window, MATCH, made))
    return functools.reduce(DataFrame.unionByName, parts, docs.sparkSession.createDataFrame([], MATCH))


def without_hits(docs: DataFrame, items: DataFrame, window: int = 10, items_mb: float = 4.0, chunk_mb: float = 2.0) -> DataFrame:
    """The rows of docs, all columns, in which no window of the benchmark occurs."""
    blocks, numbers = item_blocks(items, items_mb)

    def made(batch, shard, found, mask, matches) -> pa.RecordBatch:
        clean = np.ones(len(shard.counts), bool)
        clean[matches[:, 0]] = False
        return batch.filter(pa.array(clean))

    for i in range(len(numbers)):  # what a pass leaves is what the next one reads
        docs = next(each_pass(docs, blocks, numbers[i : i + 1], chunk_mb, window, docs.schema, made))
        docs = written(docs) if i + 1 < len(numbers) else docs
    return docs


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op3_decontaminate": op3_decontaminate}
