"""Language ID (operator 9): script ranges, per-word scores, Viterbi with a switching penalty.

A word's script leaves the languages that use it; hashed letter trigrams score the word in each; the
best path through a text's words, paying for each change of language, labels its spans. The text's
language is the one with most words; the score is their share. Training counts trigrams of a sample
of at most `sample` labelled documents, spread evenly over the languages and chosen by hash, so a rare
language is learned from all it has.

A text that is null or has no letter gets `und` and score 0, as do all texts if nothing was learned.
Ties go to the language whose name sorts first. Rows with null lang teach nothing.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import Numbered, digest_bucket, looked_up, ranges, table, text_chunks, with_text

SLOTS = 1 << 16
LETTERS = re.compile(r"[^\W\d_]+").findall
SCHEMA = "doc_id long, lang_pred string, score double"
_SCRIPTS: dict[str, str] = {}


def words_of(text: str | None) -> list[str]:
    return LETTERS(text.lower()) if text else []


def script(word: str) -> str:
    """The script of a word's first letter, or empty if that is no letter."""
    c = word[0]
    if c not in _SCRIPTS:
        _SCRIPTS[c] = unicodedata.name(c, "UNKNOWN").split()[0] if c.isalpha() else ""
    return _SCRIPTS[c]


def slots_of(word: str, known: dict[str, int] = {}) -> list[int]:  # noqa: B006  remembers trigrams
    w = f"^{word}$"
    out = []
    for i in range(len(w) - 2):
        t = w[i : i + 3]
        s = known.get(t)
        if s is None:
            if len(known) > 1_000_000:
                known.clear()
            s = known[t] = zlib.crc32(t.encode()) % SLOTS
        out.append(s)
    return out


class LanguageModel:
    def __init__(self, counts: dict[str, np.ndarray], scripts: dict[tuple[str, str], int], penalty: float):
        self.names = sorted(counts)
        self.penalty = penalty
        table_ = np.array([counts[n] for n in self.names], float).reshape(len(self.names), SLOTS).T + 0.1
        self.log = np.log(table_ / table_.sum(0)) if self.names else table_
        total = Counter()
        for (lang, _), n in scripts.items():
            total[lang] += n
        self.forget()
        self.scripts: dict[str, np.ndarray] = {}
        for s in {s for _, s in scripts}:
            self.scripts[s] = np.array([scripts.get((n, s), 0) >= 0.01 * total[n] for n in self.names])

    def forget(self) -> None:
        self.numbers, self.known = Numbered(), np.zeros((0, max(1, len(self.names))), np.float32)
        self.letters = np.zeros(0, bool)

    def looked_up(self, words: list[str], most: int = 400_000) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word begins with a letter, and its scores. Words are scored once while this
        copy of the model remembers them; with over `most` of them it starts anew."""
        if len(self.numbers) > most:
            self.forget()
        codes = looked_up(self.numbers, words, np.int64)
        fresh = list(islice(self.numbers, len(self.known), None))
        if fresh:
            parts = [self.word_scores(fresh[i : i + 50_000]).astype(np.float32) for i in range(0, len(fresh), 50_000)]
            self.known = np.concatenate((self.known, *parts))
            self.letters = np.concatenate((self.letters, np.fromiter((bool(script(w)) for w in fresh), bool, len(fresh))))
        letters = self.letters[codes]
        return letters, self.known[codes[letters]].astype(float)

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Log-probability of each language for each word; -50 outside of its script's languages."""
        if not self.names:
            return np.zeros((len(words), 1))
        slots = [slots_of(w) for w in words]
        size = np.fromiter(map(len, slots), np.int64, len(slots))
        flat = np.fromiter((x for own in slots for x in own), np.int64, int(size.sum()))
        score = np.add.reduceat(self.log[flat], np.cumsum(size) - size)
        every = np.ones(len(self.names), bool)
        allowed = np.array([self.scripts.get(script(w), every) for w in words])
        score = np.where(allowed | ~allowed.any(1, keepdims=True), score, -np.inf)
        score -= score.max(1, keepdims=True)
        return np.maximum(score - np.log(np.exp(score).sum(1, keepdims=True)), -50)

    def paths(self, score: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The best language of every word; texts follow one another and have counts >= 1 words.

        The constant path of the best total is optimal unless some stretch gains more than a switch
        costs; only the other texts are walked word by word."""
        ends = np.cumsum(counts)
        first = ends - counts
        best = np.add.reduceat(score, first).argmax(1)
        own = np.repeat(np.arange(len(counts)), counts)
        path = best[own]
        gain = score.max(1) - score[np.arange(len(score)), path]
        run = np.cumsum(gain_or_loss(score, path))
        start = np.concatenate(([0.0], run[:-1]))
        shift = own * -1e7  # restarts the running minimum at each text
        least = np.minimum.accumulate(start - start[first][own] + shift) - shift
        rise = np.maximum.reduceat(run - start[first][own] - least, first)
        walk = np.flatnonzero((rise > self.penalty) & (np.maximum.reduceat(gain, first) > 0))
        if len(walk):
            at = ranges(first[walk], counts[walk])
            path[at] = self.viterbi(score[at], counts[walk])
        return path

    def viterbi(self, score: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
        """Best paths of texts that follow one another (one text without counts), walked side by side."""
        counts = np.array([len(score)]) if counts is None else counts
        order = np.argsort(-counts, kind="stable")
        size, start = counts[order], (np.cumsum(counts) - counts)[order]
        active = np.searchsorted(-size, -np.arange(size[0]), "left")  # texts of over t words
        back = np.empty(score.shape, np.int16)
        stay = np.arange(score.shape[1], dtype=np.int16)
        total = score[start]
        for t in range(1, size[0]):
            k = active[t]
            now, row = total[:k], start[:k] + t
            top = now.argmax(1)
            moved = now[np.arange(k), top, None] - self.penalty
            switch = moved > now
            back[row] = np.where(switch, top[:, None], stay)
            now = np.where(switch, moved, now) + score[row]
            total[:k] = now - now.max(1, keepdims=True)
        path = np.empty(len(score), np.int64)
        path[start + size - 1] = total.argmax(1)
        for t in range(size[0] - 1, 0, -1):
            row = start[: active[t]] + t
            path[row - 1] = back[row, path[row]]
        return path


def gain_or_loss(score: np.ndarray, path: np.ndarray) -> np.ndarray:
    """What the best other language gains over the path's at each word; negative if it loses."""
    rows = np.arange(len(score))
    if score.shape[1] == 1:
        return np.full(len(score), -1.0)
    other = score.copy()
    other[rows, path] = -np.inf
    return other.max(1) - score[rows, path]


def learned(docs: DataFrame, sample: int = 6000, penalty: float = 12.0) -> LanguageModel:
    """A model from at most `sample` rows with text and lang; counts are added up by Spark."""
    labelled = docs.where("text is not null and lang is not null").withColumn("u", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30))
    seen = labelled.groupBy("lang").agg(F.count("*").alias("n"))
    langs = seen.count()
    if langs > sample:
        raise ValueError(f"{langs} languages, but only {sample} rows to learn from")
    each = sample // max(1, langs)
    likely = labelled.join(F.broadcast(seen), "lang").where(F.col("u") < F.lit(1.5 * each + 50) / F.col("n"))  # a row a language, `sample` at most
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("u", "doc_id", "text"))
    rows = likely.select("lang", "doc_id", "u", F.col("text").cast("string").alias("text")).withColumn("nth", nth).where(F.col("nth") <= each).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[tuple[str, str, int], int] = Counter()
        for batch in text_chunks(batches):
            by_lang: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                by_lang.setdefault(lang, Counter()).update(words_of(text))
            for lang, own in by_lang.items():
                for w, n in own.items():
                    if s := script(w):
                        found[lang, s, -1] += n
                        for slot in slots_of(w):
                            found[lang, "", slot] += n
        yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in found], pa.string()), "script": pa.array([k[1] for k in found], pa.string()), "slot": pa.array([k[2] for k in found], pa.int64()), "n": pa.array(list(found.values()), pa.int64())})

    counts: dict[str, np.ndarray] = {}
    scripts: dict[tuple[str, str], int] = {}
    for r in rows.mapInArrow(count, "lang string, script string, slot long, n long").groupBy("lang", "script", "slot").agg(F.sum("n").alias("n")).toLocalIterator():
        own = counts.setdefault(r.lang, np.zeros(SLOTS))
        if r.slot < 0:
            scripts[r.lang, r.script] = r.n
        else:
            own[r.slot] = r.n
    return LanguageModel(counts, scripts, penalty)


def labelled_words(texts: list, model: LanguageModel) -> tuple[np.ndarray, np.ndarray]:
    """Words of each text (those of letters only), and the language number of each word."""
    words: list[str] = []
    counts = []
    for t in texts:
        own = words_of(t)
        words += own
        counts.append(len(own))
    letters, score = model.looked_up(words)
    of_text = np.bincount(np.repeat(np.arange(len(counts)), counts)[letters], minlength=len(counts))
    if not len(score) or not model.names:
        return of_text, np.zeros(len(score), np.int64)
    return of_text, model.paths(score, of_text[of_text > 0])


def predicted(docs: DataFrame, model: LanguageModel, chunk_mb: float = 2.0) -> DataFrame:
    """doc_id, lang_pred, score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # SLOTS numbers a language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_chunks(batches, chunk_mb):
            counts, path = labelled_words(batch.column("text").to_pylist(), own)
            votes = np.zeros((len(counts), max(1, len(own.names))), np.int64)
            np.add.at(votes, (np.repeat(np.arange(len(counts)), counts), path), 1)
            best = votes.argmax(1)
            some = (counts > 0) & bool(own.names)
            share = np.where(some, votes[np.arange(len(counts)), best] / np.maximum(counts, 1), 0.0)
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "lang_pred": pa.array([own.names[b] if s else "und" for b, s in zip(best, some)], pa.string()), "score": pa.array(share)})

    return with_text(docs).mapInArrow(run, SCHEMA)


def spans(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, first_word, n_words, lang: the runs of words of one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in text_chunks(batches):
            counts, path = labelled_words(batch.column("text").to_pylist(), own)
            doc = np.repeat(np.arange(len(counts)), counts)
            if not len(doc) or not own.names:
                continue
            at = np.flatnonzero(np.concatenate(([True], (path[1:] != path[:-1]) | (doc[1:] != doc[:-1]))))
            first = np.cumsum(counts) - counts
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id").take(pa.array(doc[at])), "first_word": pa.array(at - first[doc[at]]), "n_words": pa.array(np.diff(np.append(at, len(doc)))), "lang": pa.array([own.names[i] for i in path[at]], pa.string())})

    return with_text(docs).mapInArrow(run, "doc_id long, first_word long, n_words long, lang string")


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = digest_bucket("doc_id", 3) == 1
    model = learned(docs.where(~held_out))
    return predicted(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


QUERIES = {"op9_language": op9_language}
