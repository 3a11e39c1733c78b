"""Footers, trees and layouts on made files."""

import datetime as dt
import hashlib

import pyarrow as pa
import pyarrow.parquet as pq

from tidemill.sources import footers, layouts


def write(path, table, **kw):
    path.parent.mkdir(parents=True, exist_ok=True)
    pq.write_table(table, path, **kw)


def test_footers(spark, tmp_path):
    table = pa.table({"n": pa.array([3, None, -5, 10, 200, 7], pa.int64()), "s": ["10", "9", "é", None, "b", "a"], "d": pa.array([dt.date(2020, 1, i + 1) for i in range(6)]), "none": pa.array([None] * 6, pa.float64())})
    write(tmp_path / "t/a.parquet", table, row_group_size=2)
    write(tmp_path / "t/deep/b.parquet", table.slice(0, 3))
    write(tmp_path / "t/_hidden.parquet", table)
    rows = footers.footers(spark, str(tmp_path / "t")).collect()
    assert len(rows) == 4 * 4 and {(r.path.split("/t/")[1], r.row_group) for r in rows} == {("a.parquet", 0), ("a.parquet", 1), ("a.parquet", 2), ("deep/b.parquet", 0)}
    assert all(r.bytes == (tmp_path / "t" / r.path.split("/t/")[1]).stat().st_size for r in rows)
    own = {(r.row_group, r.column): r for r in rows if r.path.endswith("a.parquet")}
    assert (own[1, "n"].least, own[1, "n"].most, own[1, "n"].nulls, own[0, "n"].nulls) == ("-5", "10", 0, 1)
    assert own[0, "none"].known and own[0, "none"].least is None
    got = {r.column: tuple(r)[1:] for r in footers.column_bounds(spark, f"{tmp_path}/t/a.parquet", ["n", "s", "d", "none"]).collect()}
    assert got == {"n": (6, 1, "-5", "200"), "s": (6, 1, "10", "é"), "d": (6, 0, "2020-01-01", "2020-01-06"), "none": (6, 6, None, None)}


def test_bounds_without_statistics(spark, tmp_path):
    table = pa.table({"n": [3, None, -5], "m": [1, 2, 3]})
    write(tmp_path / "t/a.parquet", table, write_statistics=["m"])
    write(tmp_path / "t/b.parquet", table)
    got = {r.column: tuple(r)[1:] for r in footers.column_bounds(spark, f"{tmp_path}/t", ["n", "m"]).collect()}
    assert got == {"n": (6, 2, "-5", "3"), "m": (6, 0, "1", "3")}


def test_trees(spark, tmp_path):
    for root in ("one", "two"):
        for name, text in (("x", "1"), ("a/y.b", "22"), ("a/b/z", "333"), ("c/z", "333")):
            p = tmp_path / root / name
            p.parent.mkdir(parents=True, exist_ok=True)
            p.write_text(text)
    one, two = (footers.tree(spark, f"{tmp_path}/{r}") for r in ("one", "two"))
    marks = lambda t: {r.folder: (r.files, r.bytes, r.mark) for r in footers.folders(t).collect()}
    before = marks(two)
    assert marks(one) == before and {k: v[:2] for k, v in before.items()} == {"": (4, 9), "a": (2, 5), "a/b": (1, 3), "c": (1, 3)}
    assert before["a/b"][2] != before["c"][2] and footers.tree_changes(one, two).collect() == []
    (tmp_path / "two/x").unlink()
    (tmp_path / "two/c/z").write_text("334")
    (tmp_path / "two/c/new").write_text("n")
    two = footers.tree(spark, f"{tmp_path}/two")
    assert {tuple(r) for r in footers.tree_changes(one, two).collect()} == {("x", "removed"), ("c/z", "touched"), ("c/new", "added")}
    after = marks(two)
    assert after["a"] == before["a"] and after["c"] != before["c"] and after[""] != before[""]
    quick = footers.tree(spark, f"{tmp_path}/two", whole=False)
    assert quick.count() == 4 and quick.select("mark").distinct().count() >= 3


def test_layouts(spark, tmp_path):
    row = lambda code, day, v: {"ts_code": code, "trade_date": day, "v": v}
    rows = [row("600519.SH", "20200105", 1), row("600519.SH", "20211231", 2), row("000001.SZ", "20210101", 3), row("000001.SZ", "20220630", 4)]
    table = lambda some: pa.Table.from_pylist(list(some))
    for y in (2020, 2021, 2022):
        write(tmp_path / f"years/{y}.parquet", table(r for r in rows if r["trade_date"].startswith(str(y))))
    for c in ("600519.SH", "000001.SZ"):
        write(tmp_path / f"codes/{c}.parquet", table(r for r in rows if r["ts_code"] == c))
    write(tmp_path / "single/all.parquet", table(rows))
    for p in ("2020", "2021"):
        write(tmp_path / f"mixed/{p}.parquet", table(r for r in rows if r["trade_date"].startswith(p)))
    write(tmp_path / "mixed/margin.parquet", table(r for r in rows if r["trade_date"].startswith("2022")))
    (tmp_path / "empty").mkdir()
    kinds = {k: layouts.layout(spark, f"{tmp_path}/{k}") for k in ("years", "codes", "single", "mixed", "empty", "absent")}
    assert {k: v.kind for k, v in kinds.items()} == {"years": "by_year", "codes": "by_code", "single": "single", "mixed": "single", "empty": "none", "absent": "none"}
    assert [k for k, v in kinds.items() if v.mixed] == ["mixed"] and kinds["years"].years == (2020, 2021, 2022)
    for k in ("years", "codes", "single", "mixed"):
        read = lambda *a, **kw: (lambda df: None if df is None else sorted(r.v for r in df.collect()))(layouts.read_table(spark, f"{tmp_path}/{k}", *a, **kw))  # noqa: B023, E731
        assert read() == [1, 2, 3, 4] and read("600519.SH") == [1, 2] and read(["600519.SH", "000001.SZ"], "20210101", "20211231") == [2, 3]
        assert read("000001.SZ", "2021-01-01", "2022-06-29") == [3] and read([]) is None
        assert read("none.SH") in (None, []) and read(columns=["v", "other"]) == [1, 2, 3, 4]
        assert read("600519.SH", code_column="absent") in ([1, 2, 3, 4], [1, 2])  # a condition on a missing column is left out
    assert layouts.read_table(spark, f"{tmp_path}/absent") is None and layouts.read_table(spark, f"{tmp_path}/years", start="20300101") is None
    plan = layouts.read_table(spark, f"{tmp_path}/years", start="20210101", end="20211231").inputFiles()
    assert [p.rsplit("/", 1)[1] for p in plan] == ["2021.parquet"]
    assert layouts.read_file(spark, f"{tmp_path}/years/1999.parquet") is None and layouts.read_file(spark, f"{tmp_path}/years/2020.parquet", ["v", "w"]).columns == ["v"]


def test_layouts_of_parts(spark, tmp_path):
    """A year's or a code's rows in several files: the same kinds and rows, and still only the files asked for."""
    rows = spark.range(0, 40, 1, 4).selectExpr("id as v", "if(id % 2 = 0, '600519.SH', 'BRK-1.X') as ts_code", "date_add(date'2020-12-20', cast(id as int)) as trade_date")
    for kind, parts in {"by_year": [("2020.parquet", "year(trade_date) = 2020"), ("2021.parquet", "year(trade_date) = 2021")], "by_code": [(f"{c}.parquet", f"ts_code = '{c}'") for c in ("600519.SH", "BRK-1.X")], "single": [("all.parquet", "true")]}.items():
        for name, test in parts:
            rows.where(test).write.parquet(f"{tmp_path}/{kind}_staged/{name}")
        layouts.gathered(spark, f"{tmp_path}/{kind}_staged", f"{tmp_path}/{kind}")
        found = layouts.layout(spark, f"{tmp_path}/{kind}")
        assert len(layouts.file_names(spark, f"{tmp_path}/{kind}")) > len(parts)
        assert found.kind == kind and not found.mixed and found.years == ((2020, 2021) if kind == "by_year" else ()) and found.codes == (("600519.SH", "BRK-1.X") if kind == "by_code" else ())
        x = layouts.read_table(spark, f"{tmp_path}/{kind}", "600519.SH", "2021-01-01", "2021-01-10")
        assert sorted(r.v for r in x.collect()) == [12, 14, 16, 18, 20]
        assert all({"by_year": "/2021-", "by_code": "/600519.SH-", "single": "/all-"}[kind] in f for f in x.inputFiles())


def test_tree_in_pieces(spark, tmp_path):
    """A file above a piece is read by several tasks; one up to it keeps the sha256 of its content."""
    sha = lambda b: hashlib.sha256(b).hexdigest()
    big, data = bytes(range(256)) * 10, {"one": b"x" * 1000, "a b/ü%20": b"y" * 999}
    for name, content in (data | {"big": big, "empty": b"", "_hidden": b"h"}).items():
        (tmp_path / "t" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "t" / name).write_bytes(content)
    found = footers.tree(spark, str(tmp_path / "t"), piece=1000)
    marks = {r.path: (r.bytes, r.mark) for r in found.collect()}
    assert marks == {k: (len(v), sha(v)) for k, v in data.items()} | {"big": (2560, sha(",".join(sha(big[i : i + 1000]) for i in (0, 1000, 2000)).encode()))}
