"""From raw documents to packed training sequences, in five stages; each one's result is written and read again.

A stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents. Extra columns
pass through untouched, whatever their names; n_chars follows the text where a stage edits it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framelake.llm._common import cut
from framelake.llm.near_duplicates import content, members
from framelake.llm.packing import pack, tokenize
from framelake.llm.quality_rules import judge
from framelake.llm.repeated_text import remove_repeats
from framelake.llm.secrets import extend_ledger, findings, redact


def _aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that a stage uses, and all others in one struct out of its way."""
    others = [c for c in docs.columns if c not in used] or [F.lit(True).alias("none")]
    return docs.select(*used, F.struct(*others).alias("_row"))


def _whole(df: DataFrame, columns: list[str], edited: bool = False) -> DataFrame:
    """The documents' columns in their order."""
    length = F.length("text").cast("long")
    back = [F.col(c) if c in df.columns else length.alias(c) if c == "n_chars" and edited else F.col(f"_row.{c}").alias(c) for c in columns]
    return df.select(*back)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return _whole(judge(_aside(docs, "text", "lang")).filter("kept"), docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near duplicates one row stays: that with the least id, and of several texts with that id the one with the least hash; a
    row without an id stays only where no row of its class has one. Of repeated rows one stays, the first by its other columns' JSON."""
    found = cut(members(docs))
    none = F.col("doc_id").isNull().alias("none")
    best = found.groupBy("class").agg(F.min(F.struct(none, F.col("doc_id").alias("_id"), F.col("content").alias("_hash"))).alias("x")).select("x._id", "x._hash")
    rows = docs.select("doc_id", F.struct(*docs.columns).alias("_row"), content().alias("_content"))
    kept = rows.join(best.hint("merge"), (F.col("_content") == F.col("_hash")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    if not found.groupBy("doc_id", "content").count().filter("count > 1").isEmpty():
        kept = cut(kept).groupBy("_content").agg(F.min_by("_row", F.to_json("_row")).alias("_row"))
    return kept.select("_row.*")


def repeated_text(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 200 bytes or more that occur elsewhere are cut out of every text that has them, in whole characters."""
    return _whole(remove_repeats(_aside(docs, "doc_id", "text")), docs.columns, edited=True)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; the documents stay. Null texts stay null, repeated rows are treated alike."""
    found = findings(_aside(docs, "doc_id", "text"), extend_ledger(docs))
    return _whole(redact(found), docs.columns, edited=True)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in sequences of 2048 tokens."""
    pieces = tokenize(docs)
    return pack(pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))


STAGES = [
    ("quality rules", quality_rules),
    ("MinHash near-dedup", near_dedup),
    ("suffix-array dedup", repeated_text),
    ("secret scans", secrets),
    ("best-fit packing", packing),
]
#: Tokens, signatures and packing have no SQL; tests compare run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
