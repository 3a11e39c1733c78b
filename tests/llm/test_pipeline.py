"""The stages of corpus_pipeline against brute force on a small table of documents."""

import random
import re

import corpus_pipeline


def test_stages(spark, tmp_path):
    r = random.Random(3)
    vocabulary = [a + b + c for a in ("ba", "de", "fi", "go") for b in ("lo", "mu", "na", "pe") for c in ("r", "s", "t", "nd")]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    passage, item = text(60), text(20)
    docs = [(i, text(120)) for i in range(40)]
    docs += [(100 + i, docs[i][1]) for i in range(10)] + [(120 + i, docs[i][1] + " " + text(2)) for i in range(5)]
    docs += [(200 + i, text(60) + "\n" + passage + " " + text(60)) for i in range(4)] + [(300, text(50) + " " + item.upper() + " " + text(60)), (400, "too short"), (401, None), (402, "")]
    spark.createDataFrame([(i, t, "en", None, len(t or "")) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = now.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, str(tmp_path))
        assert name == "pieces" or out.columns == columns and out.schema.simpleString() == now.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append({x.doc_id: x for x in now.collect()})
    unique = set(range(40)) | {200, 201, 202, 203}
    assert set(seen[0]) == {i for i, t in docs if len(re.findall(r"\S+", t or "")) >= 50}
    assert set(seen[1]) == unique | {300}
    for i, x in seen[2].items():
        assert x.text == (dict(docs)[i] if i < 200 or i == 300 else " ".join(dict(docs)[i].replace(passage, "").split())) and x.n_chars == len(x.text)
    assert set(seen[3]) == set(seen[4]) == unique
    assert {x.doc_id for x in corpus_pipeline.run(spark, str(tmp_path)).collect()} == unique


def test_repeated_and_null_ids(spark, tmp_path):
    r = random.Random(6)
    text = lambda: " ".join("".join(r.choices("abcdefg", k=6)) for _ in range(80))
    a, b, c, d, e = (text() for _ in range(5))
    rows = [(1, a), (1, a), (1, a), (None, b), (None, b), (2, c), (3, c), (3, d), (None, e), (4, e)]
    docs = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long").repartition(3)
    kept = corpus_pipeline.jaccard_join(spark, docs, str(tmp_path))
    want = [(1, a), (2, c), (3, d), (4, e), (None, b)]
    assert sorted(map(str, (tuple(x)[:2] for x in kept.collect()))) == sorted(map(str, want))
    after = corpus_pipeline.substring_dedup(spark, kept, str(tmp_path))
    assert sorted(map(str, (tuple(x)[:2] for x in after.collect()))) == sorted(map(str, want))


def test_odd_tables(spark, tmp_path):
    """Empty tables, extra columns with the names that stages use, a very long text, empty texts and repeats."""
    r = random.Random(8)
    vocabulary = [a + b + c for a in ("ba", "de", "fi", "go") for b in ("lo", "mu", "na", "pe") for c in ("r", "s", "t", "nd")]
    text = lambda n: " ".join(r.choices(vocabulary, k=n))
    long, a = text(60_000), text(90)
    rows = [(1, long), (2, a), (2, a), (None, text(80)), (3, ""), (4, None), (5, " \n ")]
    fields = "doc_id long, text string, n_chars long, _m string, _kept int, _words string, row string, key long, block long, bucket string, kept string, n_removed string"
    docs = spark.createDataFrame([(i, t, len(t or ""), "m", 7, "w", "r", 1, 2, "b", "k", "n") for i, t in rows], fields)
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for now, want in ((docs.repartition(2), {(1, long), (2, a), (None, rows[3][1])}), (docs.limit(0), set())):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, now, str(tmp_path))
            assert out.schema.simpleString() == docs.schema.simpleString(), name
            path = f"{tmp_path}/{name}-{len(want)}"
            out.write.parquet(path)
            now = spark.read.parquet(path)
            assert all(tuple(x)[3:] == ("m", 7, "w", "r", 1, 2, "b", "k", "n") for x in now.collect()), name
        assert {(x.doc_id, x.text) for x in now.collect()} == want
        assert corpus_pipeline.pieces(spark, now, str(tmp_path)).count() == len(want)


def test_odd_names_meet_rules_and_items(spark, tmp_path):
    """Columns whose names hold dots, quotes and prefixes of our own, through stages in which rows are
    rejected, merged, cut and dropped."""
    r = random.Random(9)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=6)) for _ in range(n))
    item, passage, one = text(14), text(50), text(90)
    rows = [(1, one), (2, one), (3, text(80)), (4, text(70) + " " + item + " " + text(9)), (5, passage + " " + text(70)), (6, text(70) + " " + passage), (7, "| < > # * " * 40)]
    names = ["a.b", "q`r", "carried_x", "x", "column_0", "row.text"]
    fields = "doc_id long, text string, n_chars long, " + ", ".join(f"`{n.replace('`', '``')}` int" for n in names)
    docs = spark.createDataFrame([(i, t, len(t), *range(10 * i, 10 * i + 6)) for i, t in rows], fields).repartition(2)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame([(7, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.schema.simpleString() == docs.schema.simpleString(), name
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        assert all(tuple(x)[3:] == tuple(range(10 * x.doc_id, 10 * x.doc_id + 6)) for x in now.collect()), name
    found = {x.doc_id: len(x.text.split()) for x in now.collect()}
    assert found == {1: 90, 3: 80, 5: 70, 6: 70}
