"""SentencePiece encoding and decoding (operator 5) by vectorised merge rounds.

Text with spaces as U+2581 falls into words, runs of U+2581 with what follows them, for no piece
crosses their borders (checked when the model is read). Distinct words are merged together: in each
round every word merges its pairs of least rank (best score) from the left, up to the first that makes
a better pair, all words at once on flat arrays. Words without a pair leave, the rest are compacted, and only pairs beside a merge are ranked anew. Words are cut first
between characters that no piece holds side by side, so a long text without spaces is many short
stretches, and takes no round for each of its merges.
Characters without a piece become bytes. Distinct words are merged once and kept for later texts, up
to `remember` of them.

A null or empty text has no ids and decodes to the empty text.
"""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import table, text_chunks, with_text

SPACE = "▁"
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


class PieceModel:
    """Pieces, the rank of every pair that merges, and byte ids, read from a model file."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        normal = [i for i in range(n) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        self.pieces = {sp.id_to_piece(i): i for i in normal}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.surface = {i: p.replace(SPACE, " ").encode() for p, i in self.pieces.items()} | {i: bytes([b]) for b, i in enumerate(self.bytes)}
        crossing = [p for p in self.pieces if SPACE in p.lstrip(SPACE)]
        if crossing:
            raise ValueError(f"pieces that cross words: {crossing[:3]}")
        self.apart = "\n" if not any("\n" in p and len(p) > 1 for p in self.pieces) else ""
        self.symbols = dict(self.pieces)  # and characters that only occur inside of pieces
        for p in self.pieces:
            for c in p:
                self.symbols.setdefault(c, n + len(self.symbols))
        self.loose = {i: c for c, i in self.symbols.items() if i not in self.surface}
        self.base = 1 + max(self.symbols.values(), default=0)
        self.of_code = -1 - np.arange(0x110000)
        single = {ord(c): i for c, i in self.symbols.items() if len(c) == 1}
        self.of_code[list(single)] = list(single.values())
        self.first_loose = min(self.loose, default=self.base)
        scores = sorted({sp.get_score(i) for i in normal}, reverse=True)
        rank = {s: r for r, s in enumerate(scores)}
        pairs = sorted((self.symbols[p[:j]] * self.base + self.symbols[p[j:]], rank[sp.get_score(i)], i) for p, i in self.pieces.items() for j in range(1, len(p)) if p[:j] in self.symbols and p[j:] in self.symbols)
        self.keys, self.rank, self.merged = (np.array(x, np.int64) for x in (zip(*pairs) if pairs else ((), (), ())))
        codes = {(a, b) for p in self.pieces for a, b in zip(p, p[1:])}
        self.inside = np.array(sorted(self.symbols[a] * self.base + self.symbols[b] for a, b in codes), np.int64)
        self.never = len(scores)
        self.together = self.safe_ranks()

    def safe_ranks(self) -> np.ndarray:
        """Ranks whose pairs never make a better pair: one piece alone has the rank, and every pair with
        that piece ranks behind it."""
        safe = np.ones(self.never + 1, bool)
        of_piece = np.full(self.base, -1, np.int64)
        of_piece[self.merged] = self.rank
        for part in (self.keys // self.base, self.keys % self.base):
            early = self.rank <= of_piece[part]
            safe[of_piece[part[early]]] = False
        pieces = np.unique(np.stack([self.rank, self.merged], 1), axis=0)[:, 0] if len(self.keys) else self.rank
        safe[pieces[1:][pieces[1:] == pieces[:-1]]] = False
        return safe

    def pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank of each pair and the symbol it becomes; rank `never` if it does not merge."""
        rank, merged = np.full(len(left), self.never), np.zeros(len(left), np.int64)
        if len(self.keys):
            key = left * self.base + right
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = np.flatnonzero((self.keys[at] == key) & (left >= 0) & (right >= 0))
            rank[hit], merged[hit] = self.rank[at[hit]], self.merged[at[hit]]
        return rank, merged

    def early(self, best: np.ndarray, flat: np.ndarray, word: np.ndarray, rank: np.ndarray, merged: np.ndarray) -> np.ndarray:
        """Which of the pairs at `best`, merged from the left, make a pair that goes before the next of them."""
        new, n = merged[best], len(flat)
        inner = np.append(-1, best[:-1]) == best - 2  # right after another pair
        left = np.where(inner, np.append(-1, new[:-1]), np.append(flat, -1)[best - 1])
        left[word[best - 1] != word[best]] = -1
        right = np.append(flat, (-1, -1))[best + 2]
        right[np.append(word, (-1, -1))[best + 2] != word[best]] = -1
        return np.minimum(self.pairs(left, new)[0], self.pairs(new, right)[0]) <= rank[best]

    def merge(self, words: list[str]) -> list[list[int]]:
        """Ids of each word; a character without piece is -1 - code point until the end."""
        flat = self.of_code[np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)]
        whole = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        code = np.concatenate((flat[:-1] * self.base + flat[1:], [0])) if len(flat) else flat
        apart = ~np.isin(code, self.inside) | (flat < 0) | np.append(flat[1:] < 0, True) | (np.diff(whole, append=-1) != 0)
        word = np.concatenate(([0], np.cumsum(apart)[:-1])) if len(flat) else flat  # from here on, stretches of words
        whole = whole[np.flatnonzero(apart)]
        out: list[list[int]] = [[] for _ in whole]
        rank, merged = self.pairs(flat, np.append(flat[1:], -1))
        rank[np.flatnonzero(np.diff(word, append=-1))] = self.never
        while len(flat):
            first = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(np.append(first, len(word)))
            least = np.minimum.reduceat(rank, first)
            keep = np.ones(len(flat), bool)
            over = least == self.never
            if over.any():
                keep = np.repeat(~over, size)
                ids, a = flat[~keep].tolist(), 0
                for w, b in zip(word[first[over]].tolist(), np.cumsum(size[over]).tolist()):
                    out[w], a = ids[a:b], b
            best = np.flatnonzero((rank == np.repeat(least, size)) & keep)
            if not len(best):
                break
            run = np.flatnonzero(np.diff(best, prepend=-2) != 1)  # overlapping pairs: every other one
            nth = np.arange(len(best)) - np.repeat(run, np.diff(np.append(run, len(best))))
            best = best[nth % 2 == 0]
            if not self.together[rank[best]].all():
                early = self.early(best, flat, word, rank, merged)
                held = np.cumsum(early) - early  # how many of the stretch, or of those before it, precede
                own = np.diff(word[best], prepend=-1) != 0
                best = best[held == held[np.flatnonzero(own)][np.cumsum(own) - 1]]
            flat[best] = merged[best]
            keep[best + 1] = False
            changed = np.zeros(len(flat), bool)
            changed[best] = True
            before = best - 1
            before -= (before >= 0) & ~keep[before]  # over a symbol that went into the one before it
            changed[before[before >= 0]] = True
            flat, word, rank, merged, changed = flat[keep], word[keep], rank[keep], merged[keep], changed[keep]
            at = np.flatnonzero(changed)
            rank[at], merged[at] = self.pairs(flat[at], np.append(flat, -1)[at + 1])
            rank[at[np.append(word, -1)[at + 1] != word[at]]] = self.never
        joined: list[list[int]] = [[] for _ in words]
        for w, ids in zip(whole.tolist(), out):
            joined[w] += ids
        for k, ids in enumerate(joined):
            if ids and (min(ids) < 0 or max(ids) >= self.first_loose):
                joined[k] = [y for x in ids for y in ((x,) if x in self.surface else [self.bytes[b] for b in self.loose.get(x, chr(-1 - min(x, -1))).encode()])]
        return joined


class PieceCoder:
    """Encodes and decodes whole texts; remembers words. A process keeps its coder from task to task."""

    @staticmethod
    @functools.cache
    def kept(path: str) -> PieceCoder:
        """This process's coder."""
        return PieceCoder(path)

    def __init__(self, path: str, remember: int = 400_000):
        self.model, self.remember = PieceModel(path), remember
        inner = f"[^{SPACE}{self.model.apart}]"
        self.cut = re.compile(f"{SPACE}+{inner}*|{inner}+" + (f"|{self.model.apart}" if self.model.apart else "")).findall
        self.words: dict[str, tuple[str, int, bytes]] = {}

    def split(self, text: str) -> list[str]:
        return self.cut(SPACE + text.replace(" ", SPACE)) if text else []

    def learn(self, texts: list[list[str]]) -> None:
        if len(self.words) > self.remember:
            self.words.clear()
        fresh = list({w for own in texts for w in own if w not in self.words})
        surface = self.model.surface
        for a in range(0, len(fresh), 50_000):
            part = fresh[a : a + 50_000]
            for w, ids in zip(part, self.model.merge(part)):
                self.words[w] = ",".join(map(str, ids)), len(ids), b"".join([surface[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        own = self.split(text)
        self.learn([own])
        return [int(x) for w in own for x in self.words[w][0].split(",")]

    def decode(self, ids: list[int]) -> str:
        data = b"".join([self.model.surface.get(i, b"") for i in ids])
        return data.removeprefix(b" ").decode(errors="replace")


def coded(docs: DataFrame, path: str, chunk_mb: float = 2.0) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = PieceCoder.kept(path)
        sha = lambda data: hashlib.sha256(data).hexdigest()
        for batch in text_chunks(batches, chunk_mb):
            texts = [coder.split(t or "") for t in batch.column("text").to_pylist()]
            coder.learn(texts)
            found = [[coder.words[w] for w in own] for own in texts]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "n_tokens": pa.array([sum([x[1] for x in own]) for own in found], pa.int64()),
                "ids_sha256": pa.array([sha(",".join([x[0] for x in own]).encode()) for own in found], pa.string()),
                "decoded_sha256": pa.array([sha(b"".join([x[2] for x in own]).removeprefix(b" ")) for own in found], pa.string()),
            })

    return with_text(docs).mapInArrow(run, SCHEMA)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return coded(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES = {"op5_pieces": op5_pieces}
