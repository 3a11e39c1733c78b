"""WARC archives: exact round trips, revisits, files read by an independent reader, odd rows."""

import base64
import gzip
import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemill.llm import warc
from tidemill.llm.warc import ORACLE_SQL, chunked, gzip_parts, inflated, parsed, read_archives, record_head, saved_files, written_archives

SCHEMA = "page_id long, url string, html string"


def pages(seed: int = 1) -> list[tuple]:
    rng = random.Random(seed)
    bodies = [None, "", "\r\n\r\n", "WARC/1.1\r\nWARC-Type: response\r\n\r\n", "é" * 3000, "x", "a\x00b", "".join(rng.choice("ab €😀\n") for _ in range(40_000))]
    out = []
    for i in range(60):
        out.append((i, rng.choice([None, "", "http://a.example/ü?q=1 2\r\nX: y", "http://b.example/%20"]), rng.choice(bodies + [f"page {i}"])))
    return [*out, (None, None, "x"), (None, None, "alone"), (7, "u", "same"), (7, "u", "same"), (7, "v", "other"), (None, "w", "none"), (None, "w", "none")]


def expected(rows) -> list[tuple]:
    """The largest page_id of equal payloads responds, null before all others; of equal rows one responds."""
    data = [(p, (h or "").encode()) for p, _, h in rows]
    tops = {}
    for p, d in data:
        tops[d] = max(tops.get(d, -1), -1 if p is None else p)
    out, met = [], set()
    for p, d in data:
        top = tops[d]
        own = -1 if p is None else p
        first = own == top and d not in met
        if first:
            met.add(d)
        out.append((p, len(d), base64.b32encode(hashlib.sha1(d).digest()).decode(), "response" if first else "revisit", None if first or top == -1 else top))
    return out


def sorted_rows(rows):
    return sorted(map(tuple, rows), key=lambda r: [(x is not None, x) for x in r])


@pytest.mark.parametrize("chunk_bytes", [7000, 1 << 20])
def test_round_trip(spark, chunk_bytes):
    rows = pages()
    # columns named as the operator's own ones, and one with a dot, stay out of the way
    frame = spark.createDataFrame([(*r, 3, b"", "d") for r in rows], f"{SCHEMA}, record int, data binary, `first.page_id` string").repartition(3)
    assert sorted_rows(read_archives(written_archives(frame, chunk_bytes)).collect()) == sorted_rows(expected(rows))


def test_chunks_carry_digests(spark):
    body = "aé" * 5000
    rows = chunked(spark.createDataFrame([(1, "u", body), (2, "u", "")], SCHEMA), 1000).orderBy("page_id", "chunk").collect()
    whole, own = body.encode(), [r for r in rows if r.page_id == 1]
    assert [len(r.data) for r in own] == [1000] * 15 and b"".join(bytes(r.data) for r in own) == whole
    assert [r.digest for r in own] == [base64.b32encode(hashlib.sha1(whole[: 1000 * (i + 1)]).digest()).decode() for i in range(15)]
    assert [r.last for r in own] == [False] * 14 + [True] and [(r.bytes, r.last) for r in rows if r.page_id == 2] == [(0, True)]


def test_hot_payloads(spark):
    """Both ways to the response: payloads of many rows by broadcast, the others by a join; small ones all respond."""
    rows = [(i, None, "hot" if i % 3 else f"pair {i // 6}") for i in range(3000)]
    frame = spark.createDataFrame(rows, SCHEMA)
    heads = chunked(frame).select("record", "page_id", "bytes", "digest")
    for share in (1, 10, 10**6):
        found = {r.page_id: r.first.page_id for r in warc.decided(heads, 0, share).collect()}
        assert found == {i: 2999 if i % 3 else 6 * (i // 6) + 3 for i in range(3000)}
    small = {r.page_id: r.first.page_id for r in warc.decided(heads, 4).collect()}
    assert all((small[i] == i) if i % 3 else (small[i] == 6 * (i // 6) + 3) for i in range(3000))
    assert {r.record_type for r in read_archives(written_archives(frame, least_bytes=10**9)).collect()} == {"response"}


def records_of(data: bytes) -> list[tuple[dict, bytes]]:
    """An independent reader of whole files."""
    out = []
    while data:
        head, _, data = data.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        assert lines[0] == "WARC/1.1"
        fields = dict(line.split(": ", 1) for line in lines[1:])
        n = int(fields["Content-Length"])
        assert data[n : n + 4] == b"\r\n\r\n"
        out.append((fields, data[:n]))
        data = data[n + 4 :]
    return out


def test_files(spark, tmp_path):
    rows = pages(4)
    archives = written_archives(spark.createDataFrame(rows, SCHEMA).repartition(4), 5000)
    made = saved_files(archives, str(tmp_path)).collect()
    files = sorted(tmp_path.glob("*"))
    assert sorted(r.path for r in made) == [str(f) for f in files] and all(f.name.endswith(".warc.gz") for f in files)
    found = [r for f in files for r in records_of(gzip.decompress(f.read_bytes()))]
    kinds = [f["WARC-Type"] for f, _ in found]
    assert kinds.count("warcinfo") == len(files) and len(found) == len(rows) + len(files)
    names = {f["WARC-Record-ID"] for f, _ in found}
    assert len(names) == len(found)
    answers = {}
    for fields, block in found:
        if fields["WARC-Type"] == "response":
            http, _, payload = block.partition(b"\r\n\r\n")
            assert fields["WARC-Payload-Digest"] == "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode()
            answers[fields["WARC-Record-ID"]] = fields["WARC-Payload-Digest"]
        assert not re.search(r"[^\x21-\x7e]", fields.get("WARC-Target-URI", "x"))
    for fields, _ in found:
        if fields["WARC-Type"] == "revisit":
            assert answers[fields["WARC-Refers-To"]] == fields["WARC-Payload-Digest"]
    assert sorted(answers.values()) == sorted({"sha1:" + e[2] for e in expected(rows)})


def test_empty(spark):
    assert read_archives(written_archives(spark.createDataFrame([], SCHEMA))).collect() == []


def test_damage():
    """Flipped payloads, cut members and wrong sizes are errors, not rows."""
    payload = b"payload " * 100
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    member = lambda body, size=len(payload): b"".join(d for _, d in gzip_parts(iter([record_head(1, 5, "u", size, digest, 5, 1, "d"), body, b"\r\n\r\n"]), 50, 6))
    good = member(payload)
    assert list(parsed(iter([good]))) == [(5, 800, digest, "response", None)]
    assert list(parsed(iter([good[i : i + 1] for i in range(len(good))] + [good]), step=3)) == [(5, 800, digest, "response", None)] * 2
    for bad in ([member(payload[:-1] + b"!")], [member(payload + b"more")], [member(payload[:-4])], [good[:-20]], [member(payload, 900)]):
        with pytest.raises(ValueError):
            list(parsed(iter(bad)))
    assert list(inflated(iter([gzip.compress(b"a" * 10_000) * 2]), 999)) and b"".join(inflated(iter([gzip.compress(b"ab" * 9000)]), 999)) == b"ab" * 9000


def test_sql(spark, tmp_path):
    rows = [(i, f"http://{i}.example", None if i % 7 == 0 else f"body {i % 40}") for i in range(300)]
    spark.createDataFrame(rows, SCHEMA).withColumn("more", F.lit(1)).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{tmp_path}/pages.parquet/*.parquet'")
    assert sorted_rows(warc.op12_warc(spark, str(tmp_path)).collect()) == sorted_rows(con.execute(ORACLE_SQL["op12_warc"]).fetchall())
