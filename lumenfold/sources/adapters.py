"""The given tables as the relations that the operators work on, and the same as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, x, v): sums of quantities on a 64 x 64 grid for each return flag; only cells with a value."""
    lines = read(spark, sf_dir, "lineitem")
    key = [F.col("l_returnflag").alias("image"), (F.col("l_partkey") % 64).alias("y"), (F.col("l_suppkey") % 64).alias("x")]
    return lines.groupBy(*key).agg(F.sum("l_quantity").cast("long").alias("v"))


PIXELS = "pixels AS (SELECT l_returnflag AS image, l_partkey % 64 AS y, l_suppkey % 64 AS x, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY 1, 2, 3)"


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, roi_id, m1, m2, m3): an order is a region of interest of its customer."""
    orders = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("roi_id"), F.col("o_custkey").alias("sample"), F.col("o_totalprice").alias("m3"))
    lines = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("roi_id")).agg(F.count("*").cast("double").alias("m1"), F.sum("l_quantity").alias("m2"))
    return orders.join(lines, "roi_id").select("sample", "roi_id", "m1", "m2", "m3")


METRICS = """metrics AS (SELECT o_custkey AS sample, o_orderkey AS roi_id, m1, m2, o_totalprice AS m3 FROM orders JOIN
  (SELECT l_orderkey, count(*)::DOUBLE AS m1, sum(l_quantity) AS m2 FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey)"""


def groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, geno): customers of one market segment are the controls."""
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.when(F.col("c_mktsegment") == "BUILDING", "WT").otherwise("HET").alias("geno"), "c_mktsegment", "c_acctbal", "c_nationkey")


GROUPS = "grp AS (SELECT c_custkey AS sample, CASE WHEN c_mktsegment = 'BUILDING' THEN 'WT' ELSE 'HET' END AS geno, c_mktsegment, c_acctbal, c_nationkey FROM customer)"


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(t, z, y, x, v): a vector is a frame of 8 x 8 whole numbers, its label the plane."""
    cells = read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("t"), F.col("label").alias("z"), F.posexplode("embedding").alias("i", "e"))
    return cells.select("t", "z", F.floor(F.col("i") / 8).alias("y"), (F.col("i") % 8).cast("long").alias("x"), F.floor(F.col("e").cast("double") * 100).alias("v"))


FRAMES = "frames AS (SELECT vec_id AS t, label AS z, (i - 1) // 8 AS y, (i - 1) % 8 AS x, floor(embedding[i]::DOUBLE * 100)::BIGINT AS v FROM embeddings, unnest(range(1, len(embedding) + 1)) u(i))"


def shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, t, rs): the mean value of an hour's events, users modulo 8 being the planes."""
    hour = F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / 3600)
    return read(spark, sf_dir, "events").groupBy((F.col("user_id") % 8).alias("z"), hour.alias("t")).agg(F.round(F.avg("value"), 9).alias("rs"))


SHIFTS = "shifts AS (SELECT user_id % 8 AS z, floor(epoch(ts) / 3600)::BIGINT AS t, round(avg(value), 9) AS rs FROM events GROUP BY 1, 2)"


def seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(label, yc, xc, blob, compact, tube, rprom, n_dirs, lc_area, lc_ecc, lc_sol): parts as cell seeds on a plane."""
    p = read(spark, sf_dir, "part")
    k, size = F.col("p_partkey"), F.col("p_size")
    return p.select(k.alias("label"), (k * 37 % 1009).alias("yc"), (k * 53 % 1013).alias("xc"), (size % 10 / 10.0).alias("blob"), (k % 7 / 7.0).alias("compact"), (size % 4 / 4.0).alias("tube"), (k % 5 - 1).cast("double").alias("rprom"), (size % 8).alias("n_dirs"), (k % 220).alias("lc_area"), (k % 11 / 11.0).alias("lc_ecc"), (k % 13 / 13.0).alias("lc_sol"))


SEEDS = "seeds AS (SELECT p_partkey AS label, p_partkey * 37 % 1009 AS yc, p_partkey * 53 % 1013 AS xc, (p_size % 10) / 10.0::DOUBLE AS blob, (p_partkey % 7) / 7.0::DOUBLE AS compact, (p_size % 4) / 4.0::DOUBLE AS tube, (p_partkey % 5 - 1)::DOUBLE AS rprom, p_size % 8 AS n_dirs, p_partkey % 220 AS lc_area, (p_partkey % 11) / 11.0::DOUBLE AS lc_ecc, (p_partkey % 13) / 13.0::DOUBLE AS lc_sol FROM part)"


#: Rows and columns of a scene.
SIDE = 32


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(image, y, x, v): sums of quantities on a 32 x 32 grid for each supplier, so the number of images grows with the table."""
    key = [F.col("l_suppkey").alias("image"), (F.col("l_partkey") % SIDE).alias("y"), (F.col("l_orderkey") % SIDE).alias("x")]
    return read(spark, sf_dir, "lineitem").groupBy(*key).agg(F.sum("l_quantity").cast("long").alias("v"))


SCENES = f"scene AS (SELECT l_suppkey AS image, l_partkey % {SIDE} AS y, l_orderkey % {SIDE} AS x, sum(l_quantity)::BIGINT AS v FROM lineitem GROUP BY 1, 2, 3)"


def rois(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, id, x, y, w, h): a rectangle for each order of a customer, numbered by order key; some reach over the edge of the plane."""
    o = read(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    n = F.row_number().over(Window.partitionBy("o_custkey").orderBy(k)).cast("long")
    return o.select(F.col("o_custkey").alias("sample"), n.alias("id"), (k * 7 % 52 - 4).alias("x"), (k * 11 % 52 - 4).alias("y"), (k % 5 * 2 + 4).alias("w"), (k % 7 + 4).alias("h"))


ROIS = "roi AS (SELECT o_custkey AS sample, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS id, o_orderkey * 7 % 52 - 4 AS x, o_orderkey * 11 % 52 - 4 AS y, o_orderkey % 5 * 2 + 4 AS w, o_orderkey % 7 + 4 AS h FROM orders)"


def scene_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, id, x, y, w, h): three rectangles on each supplier's scene, some of which overlap or reach over its edge."""
    k, i = F.col("s_suppkey"), F.explode(F.array(*[F.lit(n).cast("long") for n in (1, 2, 3)])).alias("id")
    three = read(spark, sf_dir, "supplier").select(k.alias("sample"), i)
    return three.select("sample", "id", ((F.col("sample") * 7 + F.col("id") * 5) % 24 - 2).alias("x"), ((F.col("sample") * 11 + F.col("id") * 9) % 24 - 2).alias("y"), F.lit(14).cast("long").alias("w"), F.lit(12).cast("long").alias("h"))


SCENE_BOXES = "rect AS (SELECT s_suppkey AS sample, id, (s_suppkey * 7 + id * 5) % 24 - 2 AS x, (s_suppkey * 11 + id * 9) % 24 - 2 AS y, 14 AS w, 12 AS h FROM supplier, range(1, 4) r(id))"


def planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample, y, x, v): what a customer's order lines sum to on a 48 x 48 plane."""
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_partkey") % 48).alias("y"), (F.col("l_suppkey") * 5 % 48).alias("x"), "l_quantity")
    own = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("sample"))
    return lines.join(own, "o_orderkey").groupBy("sample", "y", "x").agg(F.sum("l_quantity").cast("long").alias("v"))


PLANES = "px AS (SELECT o_custkey AS sample, l_partkey % 48 AS y, l_suppkey * 5 % 48 AS x, sum(l_quantity)::BIGINT AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2, 3)"
