"""Shared helpers of the training-data operators."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    """The named columns of a table; Spark opens the path, so any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*columns)


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder (spark.checkpoint.dir). Only a local master without one gets a folder of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="framelake-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/framelake-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def aside(docs: DataFrame, *used: str) -> DataFrame:
    """The columns that an operator uses, and all others in one struct out of its way, whatever their names."""
    others = [c for c in docs.columns if c not in used] or [F.lit(True).alias("none")]
    return docs.select(*used, F.struct(*others).alias("_row"))


def restored(df: DataFrame, columns: list[str]) -> DataFrame:
    """What an operator made of aside(), with those of the first columns back that it has no column of the same name for."""
    made = [c for c in df.columns if c != "_row"]
    return df.select(*made, *[F.col("_row")[c].alias(c) for c in columns if c not in made])


def slots(df: DataFrame, group: str, out: str, rows_per_bucket: int = 8192) -> DataFrame:
    """Number the rows of each group from 0 without a gap, in `out`, in place of _number.

    df is a written table whose column _number tells all its rows apart. No task sees a whole group: rows fall into buckets by
    their number, the buckets' counts are added up in a small table, and a row's place is its bucket's start plus its place there."""
    buckets = max(1, -(-df.count() // rows_per_bucket))
    df = df.withColumn("_bucket", F.pmod(F.xxhash64("_number"), F.lit(buckets)))
    before = Window.partitionBy(group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(group, "_bucket").agg(F.count("*").alias("_n"))
        .select(group, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    )
    place = F.row_number().over(Window.partitionBy(group, "_bucket").orderBy("_number")) - 1
    return (
        df.withColumn("_place", place).join(starts, [group, "_bucket"])
        .withColumn(out, (F.col("_start") + F.col("_place")).cast("long")).drop("_bucket", "_place", "_start", "_number")
    )
