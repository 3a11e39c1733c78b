"""WARC archives (operator 12) by way of a chunked record table.

A payload travels as rows of (record, chunk number), each of at most `chunk_bytes`; beside the chunk a
row carries the digest and the size of the payload up to it, so the last chunk of a record knows both
and no step in Python holds a whole payload. Records of one payload are told by digest and size; the
largest page_id responds and the others become revisits. An archive is a stretch of gzip members, one a
record after a warcinfo record, kept as rows of (archive, record, part): their data in this order are
the bytes of a .warc.gz file, which `saved_files` writes to a mounted folder. Reading inflates a part at
a time, with a digest of its own that must equal the header's.

A null html is an empty payload, which is a payload like others. Rows are told apart by a record number,
so rows may share a page_id or have none: among equal payloads the last row of the largest page_id
responds, null counts as the smallest, and a revisit of a response without page_id refers to null. A
null or empty url is written as the record's own identifier; white space and control characters in a
url are percent-encoded. An empty table makes no archive. Other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tidemill.llm.common import scratch, table, written

LONG, TEXT = pa.int64(), pa.string()
CHUNKS = pa.schema({"record": LONG, "page_id": LONG, "url": TEXT, "chunk": pa.int32(), "last": pa.bool_(), "bytes": LONG, "digest": TEXT, "data": pa.binary()})
ARCHIVES = pa.schema({"archive": pa.int32(), "record": LONG, "part": pa.int32(), "last": pa.bool_(), "data": pa.binary()})
RESULT = pa.schema({"page_id": LONG, "payload_bytes": LONG, "payload_digest": TEXT, "record_type": TEXT, "refers_to": LONG})

# fixed values of the format
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAME = "urn:warc-page:"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def batched(rows: Iterator[tuple], schema: pa.Schema, mb: float = 4.0) -> Iterator[pa.RecordBatch]:
    """Rows as batches of 4,096 at most, and of about mb in their last values where those are binary."""
    sized = pa.types.is_binary(schema.types[-1])
    held, size = [], 0

    def close() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)

    for row in rows:
        held.append(row)
        size += len(row[-1]) if sized else 0
        if size >= mb * (1 << 20) or len(held) == 4096:
            yield close()
            held, size = [], 0
    if held:
        yield close()


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of batches, a slice of some MB at a time."""
    for batch in batches:
        step = max(1, int(batch.num_rows * (4 << 20) / max(batch.nbytes, 1)))
        for a in range(0, batch.num_rows, step):
            yield from zip(*(c.to_pylist() for c in batch.slice(a, step).columns))


# ---------------------------------------------------------------- the chunked record table


def chunked(pages: DataFrame, chunk_bytes: int = 1 << 20) -> DataFrame:
    """A row for every chunk of every row's payload, with size and digest up to there; CHUNKS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows():
            digest = size = None
            for record, page, url, chunk, last, data in rows_of(batches):
                if chunk == 0:
                    digest, size = hashlib.sha1(), 0
                digest.update(data)
                size += len(data)
                yield record, page, url, chunk, last, size, base32(digest.digest()), data

        yield from batched(rows(), CHUNKS)

    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    ends = lambda p: F.greatest(F.lit(0), F.floor((F.octet_length(p) - 1) / chunk_bytes)).cast("int")
    parts = lambda p: F.transform(F.sequence(F.lit(0), ends(p)), lambda i: F.substring(p, i * chunk_bytes + 1, F.lit(chunk_bytes)))
    cut = F.element_at(F.transform(F.array(payload), parts), 1)  # the payload's bytes are taken once
    numbered = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long"), F.col("url").cast("string"), cut.alias("cut"))
    chunks = numbered.select("record", "page_id", "url", (F.size("cut") - 1).alias("end"), F.posexplode("cut").alias("chunk", "data"))
    return chunks.select("record", "page_id", "url", "chunk", (F.col("chunk") == F.col("end")).alias("last"), "data").mapInArrow(run, from_arrow_schema(CHUNKS))


def decided(heads: DataFrame, least_bytes: int = 0, hot_share: int = 1000) -> DataFrame:
    """heads (record, page_id, bytes, digest and more) with `first`, the record that responds for its payload.

    The largest of a payload is found by partial aggregation. It returns to its rows by broadcast for
    payloads with over 1 / hot_share of all rows, of which there are fewer than hot_share, and by a
    shuffled join for the others, none of which fills more than that share of a task.
    """
    total = heads.count()
    key = F.when(F.col("bytes") >= least_bytes, F.lit(0)).otherwise(F.col("record") + 1).alias("alone")
    heads = heads.withColumn("alone", key)
    groups = written(heads.groupBy("digest", "bytes", "alone").agg(F.count("*").alias("n"), F.max(F.struct("page_id", "record")).alias("first")))
    hot = F.col("n") * hot_share > total
    met = heads.join(F.broadcast(groups.where(hot).drop("n")), ["digest", "bytes", "alone"], "left")
    rest = met.where(F.col("first").isNull()).drop("first").join(groups.where(~hot).drop("n"), ["digest", "bytes", "alone"])
    return met.where(F.col("first").isNotNull()).unionByName(rest).drop("alone")


# ---------------------------------------------------------------- writing


def header(kind: str, fields: dict[str, str | int | None]) -> bytes:
    lines = [VERSION, f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in fields.items() if v is not None)]
    return "\r\n".join([*lines, "", ""]).encode()


def record_name(page: int | None, record: int) -> str:
    return f"<{NAME}{'' if page is None else page}:{record}>"


def named_page(name: str) -> int | None:
    page = name.removeprefix(f"<{NAME}").split(":")[0]
    return int(page) if page else None


def record_head(record: int, page: int | None, url: str | None, size: int, digest: str, first_page: int | None, first: int, date: str) -> bytes:
    """The headers of a record, WARC and HTTP. A response's payload follows, a revisit has none."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    revisit = first != record
    return header("revisit" if revisit else "response", {
        "WARC-Record-ID": record_name(page, record), "WARC-Date": date,
        "WARC-Target-URI": quote(url, safe="".join(map(chr, range(33, 127)))) if url else record_name(page, record)[1:-1],
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "WARC-Refers-To": record_name(first_page, first) if revisit else None,
        "Content-Type": "application/http; msgtype=response", "Content-Length": len(http) + (0 if revisit else size),
    }) + http


def gzip_parts(pieces: Iterator[bytes], part_bytes: int, level: int) -> Iterator[tuple[bool, bytes]]:
    """One gzip member of the pieces, in parts of about part_bytes: (is the last, bytes)."""
    squeeze, held = zlib.compressobj(level, wbits=31), b""
    for piece in pieces:
        held += squeeze.compress(piece)
        if len(held) >= part_bytes:
            yield False, held
            held = b""
    yield True, held + squeeze.flush()


def archived(chunks: DataFrame, decisions: DataFrame, n_archives: int, part_bytes: int = 1 << 20, date: str = "1970-01-01T00:00:00Z", level: int = 6) -> DataFrame:
    """ARCHIVES: the records of chunks as written, dealt by record number; a record's rows stay together.

    A record's decision sorts before its chunks, so the writer knows the headers when the payload comes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        archive = TaskContext.get().partitionId()
        info = b"software: tidemill\r\nformat: WARC File Format 1.1\r\n"

        def records(rows) -> Iterator[tuple[int, Iterator[bytes]]]:
            """Record number and its pieces; the pieces of one are taken before the next is asked for."""
            row = next(rows, None)
            if row is not None:
                name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{NAME}{archive}')}>"
                fields = {"WARC-Record-ID": name, "WARC-Date": date, "Content-Type": "application/warc-fields", "Content-Length": len(info)}
                yield -1, iter((header("warcinfo", fields) + info, b"\r\n\r\n"))
            while row is not None:
                record, _, page, url, size, digest, first_page, first, _ = row
                after = []

                def pieces(record=record, after=after, head=record_head(record, page, url, size, digest, first_page, first, date), keep=first == record):
                    yield head
                    for own in rows:
                        if own[0] != record:
                            after.append(own)
                            break
                        if keep:
                            yield own[-1]
                    yield b"\r\n\r\n"

                yield record, pieces()
                row = after[0] if after else None

        def out():
            for record, pieces in records(rows_of(batches)):
                for part, (last, data) in enumerate(gzip_parts(pieces, part_bytes, level)):
                    yield archive, record, part, last, data

        yield from batched(out(), ARCHIVES)

    none = lambda kind: F.lit(None).cast(kind)
    heads = decisions.select(
        "record", F.lit(-1).alias("chunk"), "page_id", "url", "bytes", "digest",
        F.col("first.page_id").alias("first_page"), F.col("first.record").alias("first"), none("binary").alias("data"),
    )
    data = chunks.select(
        "record", "chunk", none("long").alias("page_id"), none("string").alias("url"), none("long").alias("bytes"),
        none("string").alias("digest"), none("long").alias("first_page"), none("long").alias("first"), "data",
    )
    return heads.unionByName(data).repartition(n_archives, "record").sortWithinPartitions("record", "chunk").mapInArrow(run, from_arrow_schema(ARCHIVES))


def written_archives(pages: DataFrame, chunk_bytes: int = 1 << 20, archive_mb: int = 64, least_bytes: int = 0) -> DataFrame:
    """The archives of all rows, as a table in the shared folder."""
    with scratch(pages.sparkSession) as kept:
        chunks = written(chunked(pages, chunk_bytes))
        heads = chunks.where("last").select("record", "page_id", "url", "bytes", "digest")
        total = heads.agg(F.sum("bytes")).first()[0] or 0
        return kept(archived(chunks, decided(heads, least_bytes), max(1, total // (archive_mb << 20) + 1), chunk_bytes))


def saved_files(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as folder/NNNNN.warc.gz, for a folder that all executors mount: path, bytes.

    A file takes its name only when it is whole, so a task that runs again replaces it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = part = out = None
        made = []

        def close():
            out.close()
            os.replace(part, path)
            made.append((path, os.path.getsize(path)))

        for archive, data in rows_of(batches):
            if path != f"{folder}/{archive:05d}.warc.gz":
                if out:
                    close()
                path = f"{folder}/{archive:05d}.warc.gz"
                part = f"{path}.{uuid.uuid4().hex}"
                out = open(part, "wb")
            out.write(data)
        if out:
            close()
        yield pa.RecordBatch.from_pydict({"path": pa.array([m[0] for m in made], pa.string()), "bytes": pa.array([m[1] for m in made], pa.int64())})

    in_order = archives.repartition("archive").sortWithinPartitions("archive", "record", "part")
    return in_order.select("archive", "data").mapInArrow(run, "path string, bytes long")


# ---------------------------------------------------------------- reading


def inflated(parts: Iterator[bytes], step: int) -> Iterator[bytes]:
    """What gzip members hold, at most `step` bytes at a time."""
    opened = None
    for data in parts:
        while data:
            if opened is None or opened.eof:
                opened = zlib.decompressobj(wbits=31)
            piece = opened.decompress(data, step)
            data = opened.unused_data if opened.eof else opened.unconsumed_tail
            if piece:
                yield piece
        while opened and not opened.eof and (piece := opened.decompress(b"", step)):
            yield piece
    if opened and not opened.eof:
        raise ValueError("an archive ends within a member")


def taken_head(held: bytes, stream: Iterator[bytes]) -> tuple[list[str], bytes]:
    """Lines up to the next empty one, and what was read beyond it."""
    while (end := held.find(b"\r\n\r\n")) < 0:
        piece = next(stream, None)
        if piece is None:
            raise ValueError("a record ends within its headers")
        held += piece
    return held[:end].decode().split("\r\n"), held[end + 4 :]


def fields_of(lines: list[str]) -> dict[str, str]:
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def parsed(parts: Iterator[bytes], step: int = 1 << 20) -> Iterator[tuple]:
    """The page records of gzip members, as RESULT; a payload goes by piece by piece."""
    stream, held = inflated(parts, step), b""
    while held or (held := next(stream, b"")):
        lines, held = taken_head(held, stream)
        if lines[0] != VERSION:
            raise ValueError(f"not a record: {lines[0][:40]!r}")
        fields = fields_of(lines[1:])
        left, kind = int(fields["content-length"]), fields["warc-type"]
        if kind in ("response", "revisit"):
            http, rest = taken_head(held, stream)
            left -= len("\r\n".join(http).encode()) + 4
            held, declared = rest, int(fields_of(http[1:])["content-length"])
        digest, seen = hashlib.sha1(), 0
        while seen < left:
            if not held and not (held := next(stream, b"")):
                raise ValueError("a record ends within its block")
            own, held = held[: left - seen], held[left - seen :]
            digest.update(own)
            seen += len(own)
        while len(held) < 4:
            if not (piece := next(stream, b"")):
                raise ValueError("a record ends without its empty lines")
            held += piece
        if held[:4] != b"\r\n\r\n":
            raise ValueError("a record is longer than its header says")
        held = held[4:]
        if kind not in ("response", "revisit"):
            continue
        stated = fields["warc-payload-digest"].removeprefix("sha1:")
        if kind == "response" and (seen != declared or base32(digest.digest()) != stated):
            raise ValueError(f"{fields['warc-record-id']}: the payload does not have the stated size and digest")
        refers = named_page(fields["warc-refers-to"]) if kind == "revisit" else None
        yield named_page(fields["warc-record-id"]), declared, stated, kind, refers


def read_archives(archives: DataFrame) -> DataFrame:
    """RESULT for every record of ARCHIVES. Records of one part are read where they lie; the parts of
    longer ones are brought together first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(parsed(data for (data,) in rows_of(batches)), RESULT)

    short = archives.where("part = 0 AND last").select("data").mapInArrow(run, from_arrow_schema(RESULT))
    long = archives.where("NOT (part = 0 AND last)").repartition("archive", "record").sortWithinPartitions("archive", "record", "part")
    return short.unionByName(long.select("data").mapInArrow(run, from_arrow_schema(RESULT)))


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(written_archives(table(spark, sf_dir, "pages")))


QUERIES = {"op12_warc": op12_warc}

# base32 by its definition: 20 bits of the digest are four letters
ORACLE_SQL = {
    "op12_warc": """
WITH payloads AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex
  FROM pages
), digests AS (
  SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda i:
           substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                  1 + (('0x' || substr(hex, (1 + 5 * (i // 4))::BIGINT, 5))::INTEGER >> (15 - 5 * (i % 4)))::INTEGER % 32, 1)), '') AS payload_digest
  FROM payloads
), firsts AS (
  SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM digests
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to
FROM firsts
"""
}
