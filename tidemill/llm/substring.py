"""Substring dedup over words (operator 1): super-k-mer partitioning, counted exactly by sorting.

Nulls and empty texts have no words and lose none. A repeated row repeats all its windows, so both
copies lose them. A row is never dropped; documents shorter than the window are kept whole.
"""

from __future__ import annotations

import hashlib
from functools import cache
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidemill.llm.common import Numbered, looked_up, mixed, rolling_hash, sliding_min, table, word_hashes
from tidemill.llm.windows import eights, equal_groups, flagged_runs, repeated_windows

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def super_kmers(texts: list[bytes], k: int, m: int) -> tuple:
    """Runs of consecutive windows that share their minimiser."""
    whole = b" ".join([*texts, b" " * 8])
    begin, end, hashes = word_hashes(whole)
    words = cache(whole.split)
    ends = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))
    counts = np.diff(ends, prepend=0)
    n = len(begin)
    if n < k:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), None, n, words, ends, None
    least = sliding_min(mixed(rolling_hash(hashes, m)), k - m + 1)
    doc = np.repeat(np.arange(len(counts)), counts)
    valid = doc[: n - k + 1] == doc[k - 1 :]
    fresh = valid.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | (doc[1 : n - k + 1] != doc[: n - k]) | ~valid[:-1]
    starts = np.flatnonzero(fresh)
    owner = np.cumsum(fresh)[valid] - 1
    return starts, np.bincount(owner, minlength=len(starts)), least[starts], lambda s, c: b" ".join(words()[s : s + c + k - 1]), n, words, ends, lambda s, c: end[s + c + k - 2] - begin[s]


def matcher(k: int):
    def match(rows) -> list[np.ndarray]:
        """Number the words of the bucket, sort its windows and mark those that come twice."""
        numbers = Numbered()
        ids, counts, marks, lengths = [], [], [], []
        for data, count, many in rows:
            ids.append(looked_up(numbers, data.split(), np.int32))
            counts.append(count)
            marks.append(many)
            lengths.append(len(count))
        if not ids:
            return []
        flat, count, many = np.concatenate(ids), np.concatenate(counts).astype(np.int64), np.concatenate(marks)
        del ids
        first = np.cumsum(count + k - 1) - (count + k - 1)
        own = np.repeat(np.arange(len(count)), count)
        begin = np.cumsum(count) - count
        position = first[own] + np.arange(len(own)) - begin[own]
        hashes = rolling_hash(mixed(flat.astype(np.uint64) + np.uint64(1)), k)[position]
        twice = equal_groups(hashes, eights(flat, k, position)) | many[own]
        out, at, base = [], 0, 0
        for n in lengths:
            size = int(count[at : at + n].sum())
            out.append(flagged_runs(twice[base : base + size], begin[at : at + n] - base))
            at, base = at + n, base + size
        return out

    return match


def finisher(texts_too: bool):
    def finish(ids, texts, found, mask) -> pa.Table:
        words, ends = found[5](), found[6].tolist()
        whole = iter(texts)
        removed = np.concatenate(([0], np.cumsum(mask)))
        out = {"doc_id": ids, "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
        a = 0
        for e in ends:
            gone, next_text = int(removed[e] - removed[a]), next(whole)
            kept = b" ".join(compress(words[a:e], (~mask[a:e]).tolist()) if gone else words[a:e])
            out["n_words"].append(e - a)
            out["n_removed"].append(gone)
            out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
            if texts_too:
                out["kept"].append(kept if gone else next_text)
            a = e
        types = {"doc_id": pa.int64(), "n_words": pa.int64(), "n_removed": pa.int64(), "kept_sha256": pa.string()}
        result = pa.table({c: pa.array(out[c], t) for c, t in types.items()})
        return result.append_column("kept", pa.array(out["kept"], pa.binary()).cast(pa.string())) if texts_too else result

    return finish


def remove_repeats(docs: DataFrame, k: int = 35, m: int = 6, block_mb: float = 8.0, bucket_mb: float = 8.0, texts_too: bool = False, carry: tuple = ()) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row, and with texts_too the kept text (as it was
    if nothing is removed, else the words left, joined by spaces) and the columns in carry.

    Each word in a window of k words whose sequence starts anywhere else is removed.
    """
    schema = SCHEMA + (", kept string" if texts_too else "")
    return repeated_windows(docs, k, b" ", lambda texts: super_kmers(texts, k, m), matcher(k), finisher(texts_too), schema, block_mb, bucket_mb, carry)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
