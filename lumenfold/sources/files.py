"""Files that jobs hand on: regions as JSON, tables as CSV, frames in the order of time, shifts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROI = "sample long, id long, x long, y long, w long, h long"


def table(df: DataFrame) -> DataFrame:
    """The rows of df by way of a Parquet table in the folder of spark.checkpoint.dir: cuts the lineage as a checkpoint does, at a small part of its size."""
    spark = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    path = f"{root.rstrip('/')}/lumenfold-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def write_rois(rois: DataFrame, path: str) -> None:
    """Regions as JSON lines, a folder for each of 16 groups of samples; Spark's marker tells a finished write."""
    rois.withColumn("part", F.pmod(F.xxhash64("sample"), F.lit(16))).write.mode("overwrite").partitionBy("part").json(path)


def read_rois(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(f"{ROI}, part int").json(path).drop("part")


def upserted(rois: DataFrame, added: DataFrame, removed: DataFrame) -> DataFrame:
    """rois without removed(sample, id), and with added(sample, x, y, w, h, at) under the next free ids of their sample in the order of at."""
    left = rois.join(removed, ["sample", "id"], "left_anti")
    top = left.groupBy("sample").agg(F.max("id").alias("top"))
    place = F.expr("row_number() OVER (PARTITION BY sample ORDER BY at)")
    new = added.select("*", place.alias("k")).join(top, "sample", "left").select("sample", (F.coalesce("top", F.lit(0)) + F.col("k")).cast("long").alias("id"), "x", "y", "w", "h")
    return left.select(*new.columns).union(new)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).csv(path)


def write_frames(frames: DataFrame, path: str, run: int = 100) -> None:
    """frames(t, z, y, x, v) in the order of time: a folder for each run of times, so that a block of times reads only its own folders."""
    laid = frames.withColumn("run", F.floor(F.col("t") / run).cast("int"))
    laid.repartition("run").sortWithinPartitions("t", "z", "y", "x").write.mode("overwrite").partitionBy("run").parquet(path)


def read_frames(spark: SparkSession, path: str, first: int | None = None, end: int | None = None, run: int = 100) -> DataFrame:
    """Frames with first <= t < end."""
    df = spark.read.schema("t long, z long, y long, x long, v long, run int").parquet(path)
    if first is not None:
        df = df.where((F.col("run") >= first // run) & (F.col("t") >= first))
    if end is not None:
        df = df.where((F.col("run") <= (end - 1) // run) & (F.col("t") < end))
    return df.drop("run")


def incomplete(frames: DataFrame, cells: int) -> DataFrame:
    """(t, z, n) of planes that don't have every cell once."""
    return frames.groupBy("t", "z").agg(F.count("*").alias("n"), F.countDistinct("y", "x").alias("d")).where((F.col("n") != cells) | (F.col("d") != cells)).select("t", "z", "n")
