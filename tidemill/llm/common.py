"""What the text operators share: shared folders, packed blocks of documents and array helpers.

A *block* is a few MB of consecutive rows kept as one compressed Arrow stream. Blocks are written
once to the folder the cluster shares, so their content and row order never change when a task is
run again, and an operator can send one row per block and bucket instead of one per word.
"""

from __future__ import annotations

import contextlib
import contextvars
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a folder of this machine, for a local
    master alone: on a cluster it would be lost with its executor, so that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        kept = spark.sparkContext.getCheckpointDir()
        if not kept:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-checkpoint-"))
            kept = spark.sparkContext.getCheckpointDir()
        base = kept
    return f"{base}/tidemill-{uuid.uuid4().hex}"


_SCRATCH: contextvars.ContextVar[list[str] | None] = contextvars.ContextVar("scratch", default=None)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables written inside are removed at the end, but for those written by the function it gives."""
    paths: list[str] = []
    outer = _SCRATCH.set(paths)
    try:
        yield lambda df: written(df, scratch_too=False)
    finally:
        _SCRATCH.reset(outer)
        for path in paths:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def written(df: DataFrame, partition_bytes: int = 16 << 20, scratch_too: bool = True) -> DataFrame:
    """df as a table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_folder(spark)
    if scratch_too and (paths := _SCRATCH.get()) is not None:
        paths.append(path)
    df.write.option("parquet.block.size", partition_bytes).option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def digest_bucket(column: str, n: int):
    """crc32 of the decimal id modulo n, as the contracts split train and held-out rows."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n))


def text_chunks(batches: Iterator[pa.RecordBatch], mb: float = 2.0) -> Iterator[pa.RecordBatch]:
    """The same rows in batches that hold about mb of text each."""
    limit = int(mb * (1 << 20))
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        text = batch.column("text")
        sizes = np.diff(np.frombuffer(text.buffers()[1], np.int32, n + 1, text.offset * 4))
        ends = np.flatnonzero(np.diff(np.append(np.cumsum(sizes + 1) // limit, -1)) != 0) + 1
        a = 0
        for e in ends.tolist():
            yield batch.slice(a, e - a)
            a = e


def texts_of(batch: pa.RecordBatch) -> list[bytes]:
    """UTF-8 texts of a batch; a null text is empty."""
    return [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]


def with_text(docs: DataFrame) -> DataFrame:
    """doc_id and text alone, whatever other columns there are."""
    return docs.select("doc_id", F.col("text").cast("string").alias("text"))


# ---------------------------------------------------------------- blocks


def to_blob(batch: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=5))) as out:
        out.write_table(batch.combine_chunks())
    return sink.getvalue().to_pybytes()


def from_blob(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(pa.py_buffer(blob)).read_all()


def packed_blocks(docs: DataFrame, mb: float = 4.0, columns: tuple = ("doc_id", "text")) -> tuple[DataFrame, int]:
    """(block long, blob binary) written to the shared folder, and the MB of text in all blocks.

    Rows stay in the partition that read them; nothing is shuffled. A block closes at `mb` of text.
    """
    limit = int(mb * (1 << 20))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, k = TaskContext.get().partitionId(), 0
        pending: list[pa.RecordBatch] = []
        held = 0

        def close():
            whole = pa.Table.from_batches(pending)
            return pa.RecordBatch.from_pydict(
                {"block": pa.array([(task << 18) + k], pa.int64()), "bytes": pa.array([held], pa.int64()), "blob": pa.array([to_blob(whole)], pa.binary())}
            )

        for batch in batches:
            sizes = np.diff(np.frombuffer(batch.column("text").buffers()[1], np.int32, batch.num_rows + 1, batch.column("text").offset * 4)) if batch.num_rows else np.zeros(0, int)
            at = 0
            while at < batch.num_rows:
                room = np.cumsum(sizes[at:] + 1)
                n = min(int(np.searchsorted(room, limit - held)) + 1, batch.num_rows - at)
                pending.append(batch.slice(at, n))
                held += int(room[n - 1])
                at += n
                if held >= limit:
                    yield close()
                    pending, held, k = [], 0, k + 1
        if pending:
            yield close()

    picked = docs.select(*(F.col(c).cast("string").alias(c) if c == "text" else F.col(c) for c in columns))
    blocks = written(picked.mapInArrow(pack, "block long, bytes long, blob binary"))
    total = blocks.agg(F.sum("bytes")).first()[0] or 0
    return blocks, max(1, -(-total >> 20) if total < 0 else (total >> 20) + 1)


def block_texts(blob: bytes) -> tuple[list, list[bytes]]:
    """The ids and the UTF-8 texts of a block, in its order; a null text is empty."""
    rows = from_blob(blob)
    return rows.column("doc_id").to_pylist(), [t or b"" for t in rows.column("text").cast(pa.binary()).to_pylist()]


def each_block(function):
    """A mapInArrow function that calls function(block, blob) -> RecordBatch iterator."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, blob in zip(batch.column("block").to_pylist(), batch.column("blob")):
                yield from function(block, blob.as_py())

    return run


def answer_blocks(blocks: DataFrame, replies: DataFrame, function, schema: str) -> DataFrame:
    """Bring each block together with its replies: function(block, blob, replies table) -> pa.Table."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = [function(block.as_py(), blob.as_py(), right) for block, blob in zip(left.column("block"), left.column("blob"))]
        return pa.concat_tables(parts) if parts else empty

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    empty = to_arrow_schema(_parse_datatype_string(schema)).empty_table()
    return blocks.select("block", "blob").groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, schema)


# ---------------------------------------------------------------- arrays


class Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def looked_up(mapping: dict, keys: list, dtype) -> np.ndarray:
    return np.fromiter(map(mapping.__getitem__, keys), dtype, len(keys))


ODD = 0x9E3779B97F4A7C15
BLANK = np.isin(np.arange(256), list(b" \t\n\r\x0b\f"))
LOW_BYTES = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def rolling_hash(x: np.ndarray, k: int) -> np.ndarray:
    """Polynomial hash of every k consecutive values, in log2(k) passes; empty if there are fewer."""
    if len(x) < k:
        return np.zeros(0, np.uint64)
    done, acc, span, power = 0, None, 1, x
    while True:
        if k & span:
            if acc is None:
                acc, done = power, span
            else:
                n = min(len(acc), len(power) - done)
                acc = acc[:n] * np.uint64(pow(ODD, span, 1 << 64)) + power[done : done + n]
                done += span
        if span * 2 > k:
            return acc[: len(x) - k + 1]
        power = power[:-span] * np.uint64(pow(ODD, span, 1 << 64)) + power[span:]
        span *= 2


def word_places(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word of a text, given as bytes, that ends in a blank."""
    edge = np.flatnonzero(np.diff(BLANK[data], prepend=True))
    return edge[::2], edge[1::2]


def word_hashes(whole: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of a text that ends in 8 blanks."""
    start, end = word_places(np.frombuffer(whole, np.uint8))
    return start, end, hashes_at(whole, start, end)


def hashes_at(whole: bytes, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each stretch of a text that ends in 8 blanks, 8 bytes a step. Stretches of one length up
    to 8 have different hashes if they differ."""
    data = np.frombuffer(whole, np.uint8)
    eight = np.ndarray((len(data) - 7,), "<u8", data.data, 0, (1,))
    out = (end - start).astype(np.uint64)
    word, at, left = np.arange(len(start)), start, end - start
    for _ in range(8):
        out[word] = mixed(out[word] * np.uint64(ODD) + (eight[at] & LOW_BYTES[np.minimum(left, 8)]))
        more = left > 8
        word, at, left = word[more], at[more] + 8, left[more] - 8
    for i in word.tolist():
        out[i] = xxhash.xxh3_64_intdigest(whole[start[i] : end[i]])
    return out


def hashed_texts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in a row, and how many each text has; no dictionary is kept."""
    begin, _, hashes = word_hashes(b" ".join([*texts, b" " * 8]))
    ends = np.searchsorted(begin, np.cumsum([len(t) + 1 for t in texts]))
    return hashes, np.diff(ends, prepend=0)


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values."""
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (w - span)], a[w - span :]) if span < w else a


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The concatenation of arange(s, s + n)."""
    total = int(sizes.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(sizes)
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


def covered(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of n positions lie in any [start, end)."""
    steps = np.bincount(starts, minlength=n + 1)[: n + 1] - np.bincount(ends, minlength=n + 1)[: n + 1]
    return np.cumsum(steps)[:n] > 0


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of True."""
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
