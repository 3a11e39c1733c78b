"""Filter interaction audit (operator 13): five filters over whole texts, in all 120 orders.

Each task reads the Arrow buffers of its texts as byte classes: prefix sums over blanks, capitals,
symbols and first bytes of code points give the counts of every document at once. The words of a
document are hashed, sorted by document and hash, and neighbours of equal hash are compared byte by
byte, so the count of distinct words is exact. What a document fails becomes a mask of bits; equal
masks of a part are counted, and all orders and steps are read off those few counts.

Failure: A under 200 words; B under half of the words distinct; C over 3 capitals A-Z in 100 code
points; D any of `#$%&*|`; E the text of a row with a smaller doc_id, anywhere in the table.

A null text is empty, a null lang is the part ''. A null doc_id is neither smaller nor larger than
any other: such rows never fail E and have no labels. Rows that share a doc_id and a text don't make
each other fail. Labels without doc_id count nowhere; of several labels of a document one that is 1 is
enough. An empty table has no parts, so no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm.common import BLANK, LOW_BYTES, ODD, mixed, table, text_chunks, written

FILTERS = "ABCDE"
SYMBOL = np.isin(np.arange(256), list(b"#$%&*|"))
CAPITAL = (np.arange(256) >= ord("A")) & (np.arange(256) <= ord("Z"))
CODE_POINT = (np.arange(256) & 0xC0) != 0x80  #: bytes that begin a code point
SCHEMA = "doc_id long, part string, fails int, digest binary"


class Texts:
    """Texts that lie in one buffer: data[bounds[i] : bounds[i + 1]] is text i."""

    def __init__(self, texts: pa.Array):
        filled = pc.fill_null(texts, "")
        self.n = len(filled)
        bounds = np.frombuffer(filled.buffers()[1], np.int32, self.n + 1, filled.offset * 4).astype(np.int64)
        raw = filled.buffers()[2]
        self.raw = memoryview(raw or b"")[bounds[0] : bounds[-1]]
        self.bounds = bounds - bounds[0]
        self.data = np.concatenate((np.frombuffer(self.raw, np.uint8), np.full(8, 32, np.uint8)))
        self.size = len(self.data) - 8

    def count(self, wanted: np.ndarray) -> np.ndarray:
        """How many bytes of each text are in a class."""
        sums = np.concatenate(([0], np.cumsum(wanted[self.data[: self.size]])))
        return np.diff(sums[self.bounds])

    def words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of each word, and the words before each text; a word ends where its text does."""
        inside = ~BLANK[self.data[: self.size]]
        cut = np.zeros(self.size + 1, bool)
        cut[self.bounds] = True
        after = np.concatenate(([False], inside))  # after[i]: the byte before i is of a word
        before = np.concatenate((inside, [False]))
        start = np.flatnonzero(before & (~after | cut))
        end = np.flatnonzero(after & (~before | cut))
        return start, end, np.searchsorted(start, self.bounds)

    def hashes(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each word, 8 bytes a step."""
        eight = np.ndarray((self.size + 1,), "<u8", self.data.data, 0, (1,))
        out = (end - start).astype(np.uint64)
        word, at, left = np.arange(len(start)), start, end - start
        while len(word):
            out[word] = mixed(out[word] * np.uint64(ODD) + (eight[at] & LOW_BYTES[np.minimum(left, 8)]))
            more = left > 8
            word, at, left = word[more], at[more] + 8, left[more] - 8
        return out

    def equal(self, start: np.ndarray, end: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether words x[i] and y[i] have the same bytes."""
        eight = np.ndarray((self.size + 1,), "<u8", self.data.data, 0, (1,))
        left = end[x] - start[x]
        same = left == end[y] - start[y]
        pair = np.flatnonzero(same)
        a, b, left = start[x[pair]], start[y[pair]], left[pair]
        while len(pair):
            differs = ((eight[a] ^ eight[b]) & LOW_BYTES[np.minimum(left, 8)]) != 0
            same[pair[differs]] = False
            more = ~differs & (left > 8)
            pair, a, b, left = pair[more], a[more] + 8, b[more] + 8, left[more] - 8
        return same

    def distinct(self, start: np.ndarray, end: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Distinct words of each text: sorted hashes, equal neighbours compared; a text in which two
        words share a hash is counted word by word."""
        per_text = np.diff(first)
        text = np.repeat(np.arange(self.n), per_text)
        bits = max(1, self.n.bit_length())
        key = (text.astype(np.uint64) << np.uint64(64 - bits)) | (self.hashes(start, end) >> np.uint64(bits))
        order = np.argsort(key)
        twin = np.flatnonzero(key[order[1:]] == key[order[:-1]]) + 1
        held = self.equal(start, end, order[twin], order[twin - 1])
        out = per_text - np.bincount(text[order[twin]], minlength=self.n)
        for i in np.unique(text[order[twin[~held]]]).tolist():
            own = slice(first[i], first[i + 1])
            out[i] = len({bytes(self.raw[a:b]) for a, b in zip(start[own].tolist(), end[own].tolist())})
        return out


def failures(texts: Texts, least_words: int, distinct_percent: int, capital_percent: int) -> np.ndarray:
    """Bits 1, 2, 4, 8 for the filters A to D."""
    start, end, first = texts.words()
    n_words = np.diff(first)
    tests = (
        n_words < least_words,
        100 * texts.distinct(start, end, first) < distinct_percent * n_words,
        100 * texts.count(CAPITAL) > capital_percent * texts.count(CODE_POINT),
        texts.count(SYMBOL) > 0,
    )
    return sum(t.astype(np.int32) << i for i, t in enumerate(tests))


def scanned(docs: DataFrame, least_words: int = 200, distinct_percent: int = 50, capital_percent: int = 3) -> DataFrame:
    """doc_id, part, the mask of A to D and the sha256 of the text, a row per row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in text_chunks(batches):
            texts = Texts(batch.column("text"))
            at = texts.bounds.tolist()
            digests = [hashlib.sha256(texts.raw[a:b]).digest() for a, b in zip(at, at[1:])]
            fails = failures(texts, least_words, distinct_percent, capital_percent)
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id"), "part": batch.column("part"),
                "fails": pa.array(fails, pa.int32()), "digest": pa.array(digests, pa.binary()),
            })

    part = F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part")
    return docs.select(F.col("doc_id").cast("long"), part, F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def mask_counts(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """part, fails (mask of A to E), n, good, toxic: one row for each mask of a part."""
    rows = written(scanned(docs, **bounds))
    # the first row of a text is met on doc_id and digest, so copies of one text spread over all tasks
    firsts = rows.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long")).agg(
        F.max(F.coalesce(F.col("quality") == 1, F.lit(False)).cast("long")).alias("good"),
        F.max(F.coalesce(F.col("toxic") == 1, F.lit(False)).cast("long")).alias("toxic"),
    )
    copy = F.when(F.col("doc_id").isNotNull() & F.col("first").isNull(), F.lit(16)).otherwise(F.lit(0))
    met = (
        rows.groupBy("doc_id", "digest", "part", "fails").agg(F.count("*").alias("n"))
        .join(firsts, ["doc_id", "digest"], "left")
        .select("doc_id", "part", F.col("fails").bitwiseOR(copy).alias("fails"), "n")
        .join(marks, "doc_id", "left")
    )
    total = lambda mark: F.sum(F.col("n") * F.coalesce(F.col(mark), F.lit(0))).alias(mark)
    return met.groupBy("part", "fails").agg(F.sum("n").alias("n"), total("good"), total("toxic"))


def in_all_orders(counts: DataFrame) -> DataFrame:
    """counts with filter_order, step, letter, its bit and the bits of the filters before it: 600 rows each."""
    bit = lambda letter: F.pow(F.lit(2), F.instr(F.lit(FILTERS), letter) - 1).cast("int")
    orders = F.split(F.lit(",".join(map("".join, permutations(FILTERS)))), ",")
    steps = counts.withColumn("filter_order", F.explode(orders)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    earlier = F.transform(F.sequence(F.lit(1), F.col("step")), lambda i: F.substring("filter_order", i, F.lit(1)))
    steps = steps.withColumn("letter", F.substring("filter_order", F.col("step"), F.lit(1)))
    bits = F.aggregate(earlier, F.lit(0), lambda s, x: s + bit(x))
    return steps.withColumn("bit", bit(F.col("letter"))).withColumn("before", bits - F.col("bit"))


def audited(docs: DataFrame, labels: DataFrame, **bounds: int) -> DataFrame:
    """part, filter_order, step and the counts of each step; a row for every step of every part."""
    steps = in_all_orders(mask_counts(docs, labels, **bounds))
    own, earlier = F.col("fails").bitwiseAND(F.col("bit")) != 0, F.col("fails").bitwiseAND(F.col("before")) != 0
    total = lambda test, value="n": F.sum(F.when(test, F.col(value)).otherwise(F.lit(0)))
    counted = steps.groupBy("part", "filter_order", "step", "letter").agg(
        total(~own & ~earlier).alias("kept"),
        total(own & ~earlier).alias("removed"),
        total(own & earlier).alias("redundant"),
        total(F.col("fails") == F.col("bit")).alias("unique_fails"),
        total(own & ~earlier, "good").alias("good_lost"),
        total(own & ~earlier, "toxic").alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter")).alias("shapley")
    return counted.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", shapley)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audited(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op13_filter_audit": op13_filter_audit}

ORACLE_SQL = {
    "op13_filter_audit": r"""
WITH texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), firsts AS (
  SELECT t, min(doc_id) AS least FROM texts GROUP BY t
), marks AS (
  SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good,
         max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic
  FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id
), masks AS (
  SELECT x.part, coalesce(m.good, 0) AS good, coalesce(m.toxic, 0) AS toxic,
         (CASE WHEN len(words) < 200 THEN 1 ELSE 0 END)
         + (CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 2 ELSE 0 END)
         + (CASE WHEN 100 * (length(x.t) - length(regexp_replace(x.t, '[A-Z]', '', 'g'))) > 3 * length(x.t) THEN 4 ELSE 0 END)
         + (CASE WHEN regexp_matches(x.t, '[#$%&*|]') THEN 8 ELSE 0 END)
         + (CASE WHEN x.doc_id > f.least THEN 16 ELSE 0 END) AS fails
  FROM texts x JOIN firsts f ON x.t = f.t LEFT JOIN marks m ON x.doc_id = m.doc_id
), letters AS (
  SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
  FROM letters a JOIN letters b ON b.l <> a.l JOIN letters c ON c.l NOT IN (a.l, b.l)
  JOIN letters d ON d.l NOT IN (a.l, b.l, c.l) JOIN letters e ON e.l NOT IN (a.l, b.l, c.l, d.l)
), steps AS (
  SELECT filter_order, step::INTEGER AS step, bits[step] AS bit, coalesce(list_sum(bits[1:step - 1]), 0)::INTEGER AS before
  FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS step)
), counted AS (
  SELECT part, filter_order, step, bit,
         count(*) FILTER (WHERE fails & (bit | before) = 0) AS kept,
         count(*) FILTER (WHERE fails & bit <> 0 AND fails & before = 0) AS removed,
         count(*) FILTER (WHERE fails & bit <> 0 AND fails & before <> 0) AS redundant,
         count(*) FILTER (WHERE fails = bit) AS unique_fails,
         count(*) FILTER (WHERE fails & bit <> 0 AND fails & before = 0 AND good = 1) AS good_lost,
         count(*) FILTER (WHERE fails & bit <> 0 AND fails & before = 0 AND toxic = 1) AS toxic_lost
  FROM masks, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, bit)::BIGINT AS shapley
FROM counted
"""
}
