"""What several operators share: scratch tables, labels, row numbers, words."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A word: a run of anything but the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a temporary one only where none is set, as in tests."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        root = tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df by way of a Parquet table in the shared folder: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lumenfold-{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clustered(df: DataFrame, key: str, buckets: int, name: str) -> DataFrame:
    """Like written, in buckets of `key`: what is grouped by it afterwards isn't shuffled. The catalog keeps no entry of the table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/lumenfold-{uuid.uuid4().hex}/{name}"
    entry = f"lumenfold_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", path).option("compression", "zstd").format("parquet").saveAsTable(entry)
    spark.sql(f"DROP TABLE {entry}")
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    spark.sql(f"CREATE TABLE {entry} ({columns}) USING parquet CLUSTERED BY (`{key}`) INTO {buckets} BUCKETS LOCATION '{path}'")
    found = spark.table(entry)
    found.schema  # resolved: the plan holds the files from here on
    spark.sql(f"DROP TABLE {entry}")
    return found


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def crc_of_id(column: str | Column) -> Column:
    """crc32 of an id as text; 0 for a null id."""
    column = F.col(column) if isinstance(column, str) else column
    return F.coalesce(F.crc32(column.cast("string").cast("binary")), F.lit(0).cast("long"))


def training_sample(labels: DataFrame, label: str, folds: int, held_out: int, max_rows: int, seed: int = 7) -> DataFrame:
    """(doc_id, label double): at most max_rows labelled documents outside the held-out fold, in the order of a seeded hash.

    Several labels of one document: the smallest counts. Null ids and labels other than 0 and 1 are left out.
    """
    return (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & (crc_of_id("doc_id") % folds != held_out))
        .groupBy("doc_id")
        .agg(F.min(label).cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id")
        .limit(max_rows)
    )


def numbered(df: DataFrame, order: list[str], name: str = "row_no") -> DataFrame:
    """df with a gapless global row number from 0 in the given order; equal rows in any order.

    Rows are dealt out by range (a tie-breaker splits runs of equal keys), sorted within partitions and written once;
    the offsets come from one count per partition, so nothing passes through a single task.
    """
    kept = df.columns
    ranged = df.withColumn("_tie", F.monotonically_increasing_id())
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = ranged.repartitionByRange(n, *order, "_tie").sortWithinPartitions(*order, "_tie")
    at = F.monotonically_increasing_id()
    fixed = written(ranged.select(*kept, F.spark_partition_id().alias("_part"), at.bitwiseAND(F.lit((1 << 33) - 1)).alias("_at")), "numbered")
    sizes = fixed.groupBy("_part").agg((F.max("_at") + 1).alias("_n"))  # a row per partition
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    return fixed.join(F.broadcast(starts), "_part").select(*kept, (F.col("_start") + F.col("_at")).cast("long").alias(name))
