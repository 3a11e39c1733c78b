"""LM scoring (operator 10): a weighted backoff automaton over smoothed n-grams up to order 3.

States are the empty history, the start of a text, every seen word and every seen pair of words. A
state's arcs lead on by the words seen after it; its failure arc leads to the state of the next
shorter history. Weights come from Dirichlet smoothing,

    p(w | u v) = (c(u v w) + mu[1] p(w | v)) / (c(u v) + mu[1])
    p(w | v)   = (c(v w) + mu[0] p(w)) / (c(v) + mu[0])
    p(w)       = (c(w) + 1) / (N + V + 1), with c = 0 and 1 in all for any unknown word,

so a failure arc weighs mu / (c(history) + mu) and every state's probabilities sum to 1. The texts are
read from left to right, once, many side by side: the state is carried along, failure arcs are taken
until an arc reads the word, and the log-weights add up. A long text is cut into stretches, each of
which reads the two words before it first; two words determine the state, so the scores are the same.

The automaton is never gathered anywhere. Every block of text sends its distinct n-grams, with their
training counts, to buckets by hash; the bucket adds up all blocks and answers each block with the
counts that its own n-grams have, from which the block builds the states and arcs that its texts can
reach. A block sends a row to every bucket, for each bucket knows a part of N and V. n-grams are told
apart by 50-bit hashes.

A null or empty text is its end token alone. Repeated rows count as often as they come. A null doc_id
is split by the hash of the empty text. With no training text at all every word is unknown.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import answer_blocks, block_texts, each_block, hashed_texts, mixed, packed_blocks, ranges, table

SCHEMA = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
END, START = np.uint64(1), np.uint64(2)
KEY_BITS = 52  #: 50 bits of a hash, then the n-gram's order less 1
WORD, PAIR, TRIPLE = 0, 1, 2


def tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each with its end token, and the tokens of each text."""
    hashes, counts = hashed_texts([t.translate(LOWER) for t in texts])
    counts = counts + 1
    flat = np.full(len(hashes) + len(texts), END)
    keep = np.ones(len(flat), bool)
    keep[np.cumsum(counts) - 1] = False
    flat[keep] = hashes
    return flat, counts


def keyed(hashes: np.ndarray, kind: int) -> np.ndarray:
    return mixed(hashes) >> np.uint64(66 - KEY_BITS) << np.uint64(2) | np.uint64(kind)


def held(ids: list, part: int, of: int) -> np.ndarray:
    return np.array([zlib.crc32(str(i).encode() if i is not None else b"") % of == part for i in ids], bool)


class Grams:
    """The distinct n-grams of some texts: sorted keys, training counts, and each token's n-grams."""

    def __init__(self, ids: list, texts: list[bytes], part: int, of: int):
        flat, self.counts = tokens(texts)
        self.out = held(ids, part, of)
        self.first = np.cumsum(self.counts) - self.counts
        train = np.repeat(~self.out, self.counts)
        self.opens = np.zeros(len(flat), bool)  # the first token of a text
        self.opens[self.first] = True
        odd = np.uint64(0x9E3779B97F4A7C15)
        before = np.concatenate(([START], flat[:-1]))
        before[self.first] = START
        pair = mixed(before * odd + flat)
        later = np.flatnonzero(~self.opens)
        triple = mixed(np.concatenate(([START], pair[:-1]))[later] * odd + flat[later])
        keys = np.concatenate((keyed(flat, WORD), keyed(pair, PAIR), keyed(triple, TRIPLE)))
        self.keys, where = np.unique(keys, return_inverse=True)
        del keys, before, pair, triple
        where = where.astype(np.int32)
        self.times = np.bincount(where, weights=np.concatenate((train, train, train[later])).astype(float), minlength=len(self.keys)).astype(np.uint32)
        n = len(flat)
        self.word, self.pair, self.later, self.triple = where[:n], where[n : 2 * n], later, where[2 * n :]

    def cuts(self, n_buckets: int) -> np.ndarray:
        """Where each bucket's keys begin: buckets are ranges of keys."""
        edge = -(-(np.arange(n_buckets + 1).astype(object) << KEY_BITS) // n_buckets)
        return np.searchsorted(self.keys, edge.astype(np.uint64))


class Automaton:
    """States and arcs that some texts can reach, from the training counts of their n-grams.

    State i is the i-th n-gram if that is a word or a pair; then come the start and the empty history.
    """

    def __init__(self, g: Grams, total: np.ndarray, n_all: int, n_texts: int, known: int, mu: tuple[float, float]):
        m = len(g.keys)
        self.start, self.empty = m, m + 1
        self.unknown = np.log10(1 / (n_all + known + 1))
        number = np.cumsum(g.keys & np.uint64(3) == WORD) - 1  # of each word among the words
        self.width = 1 + (int(number[-1]) if m else 0)
        self.label = number[g.word]

        one = (total + 1) / (n_all + known + 1)  # p(w), at words
        at = np.zeros(m, np.int64)  # one place where each n-gram ends
        at[g.word] = at[g.pair] = np.arange(len(g.word))
        at[g.pair] = np.arange(len(g.pair))
        at[g.triple] = g.later
        kind = g.keys & np.uint64(3)
        words, pairs, triples = (np.flatnonzero((kind == k) & (total > 0)) for k in (WORD, PAIR, TRIPLE))
        all_pairs = np.flatnonzero(kind == PAIR)
        opens, last = g.opens[at], np.append(g.word, 0)[at - 1]  # the word before
        seen = np.append(total, n_texts)  # of histories: words, and the start
        history = np.where(opens, self.start, last)
        two = np.zeros(m)
        two[all_pairs] = (total[all_pairs] + mu[0] * one[g.word[at[all_pairs]]]) / (seen[history[all_pairs]] + mu[0])
        into = np.append(g.pair, 0)[at[triples] - 1]  # the pair that is the history of a triple
        three = (total[triples] + mu[1] * two[g.pair[at[triples]]]) / (total[into] + mu[1])

        source = np.concatenate((np.full(len(words), self.empty), history[pairs], into))
        by = np.concatenate((number[words], self.label[at[pairs]], self.label[at[triples]]))
        key = source * self.width + by
        order = np.argsort(key)
        self.arcs = np.append(key[order], np.iinfo(np.int64).max)
        self.weight = np.log10(np.concatenate((one[words], two[pairs], three)))[order]
        self.target = np.concatenate((words, pairs, g.pair[at[triples]]))[order]
        self.fail = np.full(m + 2, self.empty)
        self.fail[all_pairs] = g.word[at[all_pairs]]
        backoff = np.where(kind == PAIR, mu[1] / (total + mu[1]), mu[0] / (total + mu[0]))
        self.lost = np.log10(np.append(backoff, (mu[0] / (n_texts + mu[0]), 1.0)))
        self.fail[:m][(kind == PAIR) & (np.append(total, (0, 0))[self.fail[:m]] == 0)] = self.empty  # of an unseen word

    def step(self, state: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Read a word at each state: the states reached, and the log-weights of failure arcs and arc."""
        state, gained, left = state.copy(), np.zeros(len(state)), np.arange(len(state))
        while len(left):
            now = state[left]
            key = now * self.width + label[left]
            arc = np.searchsorted(self.arcs, key)
            hit = self.arcs[arc] == key
            found = left[hit]
            gained[found] += self.weight[arc[hit]]
            state[found] = self.target[arc[hit]]
            lone = ~hit & (now == self.empty)
            gained[left[lone]] += self.unknown
            failed = ~hit & ~lone
            left, now = left[failed], now[failed]
            gained[left] += self.lost[now]
            state[left] = self.fail[now]
        return state, gained

    def read(self, counts: np.ndarray, stretch: int = 512) -> np.ndarray:  # stretch >= 2
        """The log-weight of every token of texts of `counts` tokens."""
        pieces = -(-counts // stretch)
        text = np.repeat(np.arange(len(counts)), pieces)
        nth = ranges(np.zeros_like(pieces), pieces)
        first = (np.cumsum(counts) - counts)[text] + nth * stretch
        size = np.minimum(counts[text] - nth * stretch, stretch)
        order = np.argsort(-size, kind="stable")
        first, size, cut = first[order], size[order], nth[order] > 0
        state = np.where(cut, self.empty, self.start)
        out = np.zeros(int(counts.sum()))
        back = np.flatnonzero(cut)
        for before in (2, 1):
            state[back], _ = self.step(state[back], self.label[first[back] - before])
        active = np.searchsorted(-size, -np.arange(stretch), "left")  # stretches of over t tokens
        for t in range(int(size.max(initial=0))):
            at = first[: active[t]] + t
            state[: active[t]], out[at] = self.step(state[: active[t]], self.label[at])
        return out


def packed(numbers: np.ndarray) -> bytes:
    """64-bit numbers, byte plane by byte plane; ascending keys come as gaps."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, 8).T).tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(8, -1)
    return np.ascontiguousarray(planes.T).view(np.uint64).ravel()


def scores(docs: DataFrame, held_part: int = 2, parts: int = 7, mu: tuple[float, float] = (100.0, 4.0), block_mb: float = 4.0, bucket_mb: float = 8.0) -> DataFrame:
    """Scores every row; rows whose id has crc32 mod `parts` equal to held_part teach nothing."""
    blocks, mb = packed_blocks(docs, block_mb)
    n_buckets = max(16, round(mb / bucket_mb))

    def send(block: int, blob: bytes) -> Iterator[pa.RecordBatch]:
        g = Grams(*block_texts(blob), held_part, parts)
        cut = g.cuts(n_buckets)
        squeeze = zstandard.ZstdCompressor(level=1).compress
        each = [slice(a, b) for a, b in zip(cut[:-1], cut[1:])]
        yield pa.RecordBatch.from_pydict({
            "block": pa.array([block] * n_buckets, pa.int64()), "bucket": pa.array(range(n_buckets), pa.int64()),
            "tokens": pa.array([int(g.counts[~g.out].sum())] * n_buckets, pa.int64()), "texts": pa.array([int((~g.out).sum())] * n_buckets, pa.int64()),
            "keys": pa.array([packed(np.diff(g.keys[x], prepend=np.uint64(0))) for x in each], pa.binary()), "times": pa.array([squeeze(g.times[x].tobytes()) for x in each], pa.binary()),
        })

    def answer(rows: pa.Table) -> pa.Table:
        open_ = zstandard.ZstdDecompressor().decompress
        keys = [np.cumsum(unpacked(k.as_py()), dtype=np.uint64) for k in rows["keys"]]
        ends = np.cumsum([len(k) for k in keys])
        times = [np.frombuffer(open_(t.as_py()), np.uint32) for t in rows["times"]]
        distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
        del keys
        total = np.bincount(where, weights=np.concatenate(times).astype(float), minlength=len(distinct)).astype(np.uint64)
        known = int(((distinct & np.uint64(3) == WORD) & (total > 0)).sum())
        n, own = rows.num_rows, np.split(where, ends[:-1])
        return pa.table({
            "block": rows["block"], "bucket": rows["bucket"], "known": pa.array([known] * n, pa.int64()),
            "tokens": pa.array([sum(rows["tokens"].to_pylist())] * n, pa.int64()), "texts": pa.array([sum(rows["texts"].to_pylist())] * n, pa.int64()),
            "totals": pa.array([packed(total[w]) for w in own], pa.binary()),
        })

    def walk(block: int, blob: bytes, replies: pa.Table) -> pa.Table:
        ids, texts = block_texts(blob)
        g = Grams(ids, texts, held_part, parts)
        cut = g.cuts(n_buckets)
        total = np.zeros(len(g.keys))
        for b, data in zip(replies["bucket"].to_pylist(), replies["totals"]):
            total[cut[b] : cut[b + 1]] = unpacked(data.as_py())
        n_all, n_texts, known = replies["tokens"][0].as_py(), replies["texts"][0].as_py(), sum(replies["known"].to_pylist())
        count = total[g.word]
        base = np.log10((count + 1) / (n_all + known + 1))
        step = Automaton(g, total, n_all, n_texts, known, mu).read(g.counts)
        add = lambda x: np.add.reduceat(x, g.first) if len(g.first) else x
        return pa.table({
            "doc_id": pa.array(ids, pa.int64()), "held_out": pa.array(g.out), "n_tokens": pa.array(g.counts), "n_known": pa.array(add((count > 0).astype(np.int64))),
            "train_tokens": pa.array([n_all] * len(ids), pa.int64()), "base_score": pa.array(add(base)), "score": pa.array(add(step)),
        })

    sent = blocks.mapInArrow(each_block(send), "block long, bucket long, tokens long, texts long, keys binary, times binary")
    replies = sent.groupBy("bucket").applyInArrow(answer, "block long, bucket long, known long, tokens long, texts long, totals binary")
    return answer_blocks(blocks, replies, walk, SCHEMA)


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))


QUERIES = {"op10_lm_scores": op10_lm_scores}
