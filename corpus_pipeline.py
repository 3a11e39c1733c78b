"""From documents to token digests: STAGES in order, each written as Parquet and read by the next.

1. quality_rules drops the documents that the base or the learned decision list rejects.
2. jaccard_join keeps one row of each group of near copies (5-word shingles, 0.8): that of the
   smallest doc_id, null last. Rows are told apart by a key of their own, not by doc_id.
3. substring_dedup removes words in repeated 35-word windows; a document keeps its row.
4. decontaminate drops documents that hold a window of a benchmark item.
5. pieces encodes and decodes what is left.

All stages but the last return the columns of documents; n_chars follows the text. Null and empty texts
fail the first stage. Rows are told apart by keys of their own, so rows that share a doc_id, or have
none, are judged each by its text; exact repeats are near copies, of which one row stays. Columns of
any name pass through. An empty table gives empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import shared_folder, table, written
from tidemill.llm.decontaminate import without_hits
from tidemill.llm.jaccard import linked
from tidemill.llm.pieces import coded
from tidemill.llm.quality import kept_rows, learned_rules
from tidemill.llm.substring import remove_repeats

ORACLE_SQL = None


def plainly_named(docs: DataFrame) -> DataFrame:
    """docs under names by place, but for the columns that stages use: other names may hold dots and quotes."""
    return docs.toDF(*(c if c in ("doc_id", "text", "n_chars") else f"column_{i}" for i, c in enumerate(docs.columns)))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that neither the base nor the learned list rejects."""
    plain = plainly_named(docs)
    return kept_rows(plain, learned_rules(plain, table(spark, sf_dir, "labels"))).toDF(*docs.columns)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every group of near copies, the one of the smallest doc_id, null last, first row first."""
    plain = plainly_named(docs)
    keyed = written(plain.select(F.monotonically_increasing_id().alias("key"), F.struct(*plain.columns).alias("row")))
    groups = linked(keyed.select(F.col("key").alias("doc_id"), "row.text"), k=5, percent=80).select(F.col("doc_id").alias("key"), "component_id")
    order = F.struct(F.col("row.doc_id").isNull(), "row.doc_id", "key")
    first = groups.join(keyed.select("key", F.struct("row.doc_id").alias("row")), "key").groupBy("component_id").agg(F.min(order)["key"].alias("key"))
    return keyed.join(first, "key", "left_semi").select("row.*").toDF(*docs.columns)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of repeated windows; a document left without words stays, empty."""
    plain = plainly_named(docs)
    carry = tuple(c for c in plain.columns if c not in ("doc_id", "text", "n_chars"))
    found = remove_repeats(plain, texts_too=True, carry=carry)
    types = dict(plain.dtypes)
    new = {"doc_id": F.col("doc_id"), "text": F.col("kept"), "n_chars": F.length("kept")} | {c: F.col(f"carried_{c}") for c in carry}
    return found.select(*(new[c].cast(types[c]).alias(c) for c in plain.columns)).toDF(*docs.columns)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in which no window of a benchmark item occurs."""
    return without_hits(plainly_named(docs), table(spark, sf_dir, "benchmark")).toDF(*docs.columns)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    import public_tokenizers

    return coded(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("quality_rules", quality_rules), ("jaccard_join", jaccard_join), ("substring_dedup", substring_dedup), ("decontaminate", decontaminate), ("pieces", pieces)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_folder(spark)}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
