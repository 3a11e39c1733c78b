"""Cross-tokenizer alignment (operator 11): interval stabbing between the tokens of two vocabularies.

The tokens of B are a static index of disjoint byte intervals, sorted by start and by end. Every token
of A stabs it by two bisections, which give the B tokens it overlaps: the links. A gap after a token of
A is stabbed as well; where no B token spans it, it closes a group. All bisections of a chunk run at
once on flat arrays.

Both vocabularies begin a token at a single space between two other characters, so a text is cut there
into stretches that are encoded apart (tested against whole texts). Equal stretches have equal
alignments; a process encodes and aligns each distinct one once and remembers up to `remember` of them.

Counts of id pairs take two steps. A block of texts sends each distinct pair once, with its count;
Spark adds them up, finds the highest of every B id (which has at most as many pairs as A has ids), and
brings the totals back to the blocks, which add them up by document. Blocks are written first, so they
don't change when a task runs again.

A null or empty text has no tokens: all counts are 0 and the digest is ''. So has a text whose joined A
or B bytes are not a space and the text, such as one with U+2581. Rows are told apart by their place, so
rows may share a doc_id or have none; repeated rows count as often as they come. An empty table gives
no rows. Other columns are not read. A stretch without single spaces is encoded in one call.
"""

from __future__ import annotations

import functools
import hashlib
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemill.llm.common import answer_blocks, from_blob, ranges, scratch, table, text_chunks, to_blob, with_text, written

SPACE = "▁"
COUNTS = ("n_a", "n_b", "n_groups", "n_links")
RESULT = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
PAIRS = pa.list_(pa.struct({"a": pa.int32(), "b": pa.int32(), "n": pa.int64()}))
BLOCKS = pa.schema({"block": pa.int64(), "blob": pa.binary(), "pairs": PAIRS})

cut = re.compile(r"(?<=\S) (?=\S)").split


def byte_alphabet() -> dict[str, int]:
    """The byte behind each character of byte-level vocabularies: printable bytes stand for themselves,
    the others, in order, for the code points from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def overlaps(a_end: np.ndarray, b_end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For tokens that cover the same bytes one after another, given by their ends: the first B token
    that each A token overlaps, how many it overlaps, and whether the gap after it is spanned by none."""
    a_start, b_start = (np.concatenate(([0], e))[: len(e)] for e in (a_end, b_end))
    first = np.searchsorted(b_end, a_start, "right")
    after = np.searchsorted(b_start, a_end, "left")
    open_gap = b_end[np.searchsorted(b_end, a_end, "left")] == a_end if len(a_end) else np.zeros(0, bool)
    return first, after - first, open_gap


class Aligner:
    """Encodes and aligns stretches, and remembers them by number.

    counts[i]: n_a, n_b, n_groups, n_links of stretch i; groups[i] its groups as text; links[first[i]:
    first[i + 1]] its links as a_id << 32 | b_id; fits[i] whether both encodings keep its bytes.
    """

    def __init__(self, a_path: str, b_path: str, remember: int = 200_000):
        import sentencepiece

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the threads here
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        alphabet = byte_alphabet()
        n_a = self.a.get_vocab_size()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.a_bytes = [bytes(alphabet.get(c, 63) for c in self.a.id_to_token(i) or "") for i in range(n_a)]
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]
        self.a_size, self.b_size = (np.array(list(map(len, x)), np.int64) for x in (self.a_bytes, self.b_bytes))
        self.written = np.array([str(i) for i in range(max(n_a, len(pieces)))], object)
        self.remember = remember
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.held, self.chars = [], 0

    def numbers(self, texts: list[list[str]]) -> np.ndarray:
        """The numbers of all stretches of the texts in a row; new ones are aligned first."""
        known = self.known
        fresh = list({s for own in texts for s in own if s not in known})
        for a in range(0, len(fresh), 20_000):
            self.align(fresh[a : a + 20_000])
        return np.fromiter((known[s] for own in texts for s in own), np.int64, sum(map(len, texts)))

    def full(self) -> bool:
        return len(self.known) > self.remember or self.chars > 50 * self.remember

    def align(self, stretches: list[str]) -> None:
        spaced = [" " + s for s in stretches]
        a_ids = [e.ids for e in self.a.encode_batch_fast(spaced, add_special_tokens=False)]
        b_ids = self.b.encode(stretches, num_threads=1)
        fits = np.zeros(len(stretches), bool)
        for i, s in enumerate(spaced):
            whole = s.encode()
            fits[i] = b"".join([self.a_bytes[x] for x in a_ids[i]]) == whole and b"".join([self.b_bytes[x] for x in b_ids[i]]) == whole
            if not fits[i]:
                a_ids[i], b_ids[i] = [], []
        n = len(stretches)
        n_a, n_b = (np.fromiter(map(len, x), np.int64, n) for x in (a_ids, b_ids))
        a, b = (np.fromiter((i for own in x for i in own), np.int64, int(c.sum())) for x, c in ((a_ids, n_a), (b_ids, n_b)))
        a_end, b_end = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        first, count, open_gap = overlaps(a_end, b_end)
        own = np.repeat(np.arange(n), n_a)
        links = np.repeat(a, count) << 32 | b[ranges(first, count)]
        n_links, n_groups = (np.bincount(own, w, n).astype(np.int64) for w in (count, open_gap))
        # ids in the order of their groups, those of A before those of B
        a_group = np.cumsum(open_gap) - open_gap
        b_group = a_group[np.searchsorted(a_end, b_end, "left")] if len(a) else b
        order = np.argsort(np.concatenate((2 * a_group, 2 * b_group + 1)), kind="stable")
        group = np.concatenate((a_group, b_group))[order]
        side = np.concatenate((np.zeros(len(a), int), np.ones(len(b), int)))[order]
        text = self.written[np.concatenate((a, b))[order]]
        mark = np.where(np.diff(side, append=0) > 0, "|", np.where(np.diff(group, append=-1) != 0, ";", ",")).astype(object)
        ends = np.cumsum(n_a + n_b)
        mark[ends[n_a > 0] - 1] = "\n"  # the last id of a stretch
        lines = iter("".join((text + mark).tolist()).split("\n"))
        groups = [next(lines) if f else "" for f in (n_a > 0).tolist()]
        base = len(self.known)
        self.known |= zip(stretches, range(base, base + n))
        self.chars += sum(map(len, stretches))
        self.held.append((np.stack((n_a, n_b, n_groups, n_links), 1), np.array(groups, object), links, n_links, fits))

    def tables(self) -> tuple:
        """counts, groups, links, first and fits of all stretches."""
        if not self.held:
            return np.zeros((0, 4), np.int64), np.zeros(0, object), np.zeros(0, np.int64), np.zeros(1, np.int64), np.zeros(0, bool)
        counts, groups, links, n_links, fits = (np.concatenate(x) for x in zip(*self.held))
        self.held = [(counts, groups, links, n_links, fits)]
        return counts, groups, links, np.concatenate(([0], np.cumsum(n_links))), fits


@functools.lru_cache(1)
def aligner(a_path: str, b_path: str, remember: int) -> Aligner:
    """One for a process, whatever number of tasks it runs."""
    return Aligner(a_path, b_path, remember)


class Block:
    """Documents whose stretches are numbered; closes into a row of BLOCKS."""

    def __init__(self, own: Aligner):
        self.own, self.ids, self.numbers, self.sizes, self.bytes = own, [], [], [], 0

    def add(self, batch: pa.RecordBatch) -> None:
        texts = [cut(t) if t else [] for t in batch.column("text").to_pylist()]
        self.ids += batch.column("doc_id").to_pylist()
        self.numbers.append(self.own.numbers(texts))
        self.sizes += map(len, texts)
        self.bytes += batch.column("text").nbytes

    def close(self, number: int) -> pa.RecordBatch:
        counts, groups, links, first, fits = self.own.tables()
        flat, sizes = np.concatenate(self.numbers), np.array(self.sizes, np.int64)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        good = np.bincount(doc[~fits[flat]], minlength=len(sizes)) == 0
        flat, sizes = flat[good[doc]], np.where(good, sizes, 0)
        used, place, times = np.unique(flat, return_inverse=True, return_counts=True)
        ends = np.cumsum(sizes).tolist()
        named = groups[flat]
        shas = [hashlib.sha256(";".join(named[e - s : e].tolist()).encode()).hexdigest() if s else "" for e, s in zip(ends, sizes.tolist())]
        n_links = counts[used, 3]
        keys, of_link = np.unique(links[ranges(first[used], n_links)], return_inverse=True)
        total = np.bincount(of_link, np.repeat(times, n_links), len(keys)).astype(np.int64)
        sums = np.stack([np.bincount(np.repeat(np.arange(len(sizes)), sizes), counts[flat, k], len(sizes)) for k in range(4)]).astype(np.int64)
        lists = lambda n, values: pa.ListArray.from_arrays(np.concatenate(([0], np.cumsum(n))).astype(np.int32), pa.array(values.astype(np.uint32)))
        blob = to_blob(pa.table({
            "doc_id": pa.array(self.ids, pa.int64()), **{c: pa.array(v, pa.int64()) for c, v in zip(COUNTS, sums)},
            "groups_sha256": pa.array(shas, pa.string()), "places": lists(sizes, place),
        }))
        stretches = to_blob(pa.table({"links": lists(n_links, of_link)}))
        pairs = pa.StructArray.from_arrays([pa.array(keys >> 32, pa.int32()), pa.array(keys & 0xFFFFFFFF, pa.int32()), pa.array(total)], ["a", "b", "n"])
        whole = len(blob).to_bytes(8, "little") + blob + stretches
        listed = pa.ListArray.from_arrays(np.array([0, len(keys)], np.int32), pairs).cast(PAIRS)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([whole], pa.binary()), listed], schema=BLOCKS)


def aligned_blocks(docs: DataFrame, a_path: str, b_path: str, block_mb: float = 8.0, remember: int = 200_000) -> DataFrame:
    """BLOCKS of the rows of docs, each block with about block_mb of text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own, task, k = aligner(a_path, b_path, remember), TaskContext.get().partitionId(), 0
        block = None
        for batch in text_chunks(batches):
            block = block or Block(own)
            block.add(batch)
            if block.bytes >= block_mb * (1 << 20) or own.full():
                yield block.close((task << 24) + k)
                block, k = None, k + 1
                if own.full():
                    own.forget()
        if block:
            yield block.close((task << 24) + k)

    return with_text(docs).mapInArrow(run, from_arrow_schema(BLOCKS))


def pair_totals(blocks: DataFrame) -> DataFrame:
    """a, b, total, top: every linked id pair, how often it is linked, and whether no pair of its B id is more often."""
    totals = blocks.select(F.explode("pairs").alias("p")).groupBy("p.b", "p.a").agg(F.sum("p.n").alias("total"))
    return totals.select("a", "b", "total", (F.col("total") == F.max("total").over(Window.partitionBy("b"))).alias("top"))


def aligned(docs: DataFrame, a_path: str, b_path: str, block_mb: float = 8.0) -> DataFrame:
    """RESULT for every row of docs."""

    def answer(block: int, blob: bytes, replies: pa.Table) -> pa.Table:
        end = 8 + int.from_bytes(blob[:8], "little")
        rows, stretches = from_blob(blob[8:end]), from_blob(blob[end:])
        a, b, total, top = (replies.column(c).to_numpy() for c in ("a", "b", "total", "top"))
        order = np.argsort(a.astype(np.int64) << 32 | b)
        links, places = (t.column(c).combine_chunks() for t, c in ((stretches, "links"), (rows, "places")))
        out = rows.select(["doc_id", *COUNTS])
        for name, values in (("n_best", top[order].astype(np.int64)), ("count_sum", total[order])):
            of_stretch = sums_of(links, values)
            out = out.append_column(name, pa.array(sums_of(places, of_stretch), pa.int64()))
        return out.append_column("groups_sha256", rows.column("groups_sha256"))

    with scratch(docs.sparkSession) as kept:
        blocks = written(aligned_blocks(docs, a_path, b_path, block_mb))
        asked = blocks.select(F.col("block").alias("asker"), F.explode("pairs").alias("p")).select("asker", "p.a", "p.b")
        replies = asked.join(pair_totals(blocks), ["a", "b"]).select(F.col("asker").alias("block"), "a", "b", "total", "top")
        return kept(answer_blocks(blocks, replies, answer, RESULT))


def sums_of(lists: pa.ListArray, values: np.ndarray) -> np.ndarray:
    """For each list of positions, the sum of the values there."""
    at = lists.offsets.to_numpy().astype(np.int64)
    sums = np.concatenate(([0], np.cumsum(values[lists.values.to_numpy()[at[0] : at[-1]]], dtype=np.int64)))
    return sums[at[1:] - at[0]] - sums[at[:-1] - at[0]]


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return aligned(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op11_alignment": op11_alignment}
