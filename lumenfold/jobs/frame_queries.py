"""Registered queries over frames and shifts, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.operators import registration as reg
from lumenfold.sources import adapters as src

CHUNK, SIDE, CAP = 20, 8, 2


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    return reg.chunked(src.frames(spark, sf), CHUNK)


def _steps(spark: SparkSession, sf: str) -> DataFrame:
    """Shifts of every frame to the one before it in its plane."""
    f = reg.chunked(src.frames(spark, sf), CHUNK).select("z", "i", "y", "x", "v")
    return reg.whole_shifts(f.where("i > 0"), f.withColumn("i", F.col("i") + 1), ["z", "i"], SIDE)


def chunk_numbers(spark: SparkSession, sf: str) -> DataFrame:
    return _chunks(spark, sf).select("z", "t", F.col("i").cast("long").alias("i"), "chunk").distinct()


def reference_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return reg.references(_chunks(spark, sf))


def reference_difference(spark: SparkSession, sf: str) -> DataFrame:
    """Of each frame the mean absolute difference from its chunk's reference, which is stretched over the chunk's frames."""
    c = _chunks(spark, sf)
    d = c.join(reg.references(c), ["z", "chunk", "y", "x"])
    return d.groupBy("z", "t").agg(F.round(F.avg(F.abs(F.col("v") - F.col("mean"))), 6).alias("off"))


def frame_shifts(spark: SparkSession, sf: str) -> DataFrame:
    return _steps(spark, sf).select("z", F.col("i").cast("long").alias("i"), "dy", "dx", "peak")


def trusted_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """Running totals of the shifts within the cap, centred at the median of their plane."""
    g = reg.trusted(_steps(spark, sf), CAP)
    up = Window.partitionBy("z").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    t = g.select("z", "i", F.sum("dy").over(up).alias("dy"), F.sum("dx").over(up).alias("dx"))
    med = t.groupBy("z").agg(F.median("dy").alias("my"), F.median("dx").alias("mx"))
    return t.join(med, "z").select("z", F.col("i").cast("long").alias("i"), (F.col("dy") - F.col("my")).alias("dy"), (F.col("dx") - F.col("mx")).alias("dx"))


def moved_frames(spark: SparkSession, sf: str) -> DataFrame:
    f = reg.chunked(src.frames(spark, sf), CHUNK).select("z", "i", "y", "x", "v")
    return reg.moved(f, _steps(spark, sf), ["z", "i"], SIDE).select("z", F.col("i").cast("long").alias("i"), "y", "x", "v")


def shift_summary(spark: SparkSession, sf: str) -> DataFrame:
    s = _steps(spark, sf).withColumn("far", F.hypot("dy", "dx"))
    return s.groupBy("z").agg(F.round(F.median("far"), 6).alias("median"), F.round(F.percentile("far", 0.95), 6).alias("p95"), F.median("dy").alias("dy"), F.median("dx").alias("dx"))


def depth_shift(spark: SparkSession, sf: str) -> DataFrame:
    stack = src.frames(spark, sf).groupBy("z", "y", "x").agg(F.avg("v").alias("v"))
    return reg.depth_shifted(stack, 1.25)


def plane_range(spark: SparkSession, sf: str) -> DataFrame:
    """Projection over the middle half of the planes, zeros left out."""
    f = src.frames(spark, sf)
    nz = f.agg((F.max("z") + 1).alias("nz"))
    half = f.join(F.broadcast(nz)).where((F.col("z") + 1 >= F.floor(0.25 * F.col("nz") + 0.5)) & (F.col("z") + 1 <= F.floor(0.75 * F.col("nz") + 0.5)))
    v = F.nullif(F.col("v"), F.lit(0))
    return half.groupBy("y", "x").agg(F.round(F.coalesce(F.avg(v), F.lit(0.0)), 6).alias("mean"), F.coalesce(F.max(v), F.lit(0)).alias("max"), F.coalesce(F.median(v), F.lit(0.0)).alias("median"))


def best_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Of each plane the frame that agrees best with the plane's mean."""
    f = src.frames(spark, sf)
    mean = f.groupBy("z", "y", "x").agg(F.round(F.avg("v"), 6).alias("w"))
    r = f.join(mean, ["z", "y", "x"]).groupBy("z", "t").agg(F.round(F.corr("v", "w"), 6).alias("r"))
    return r.groupBy("z").agg(F.min(F.struct((-F.col("r")).alias("r"), "t")).alias("b")).select("z", F.col("b.t").alias("t"), (-F.col("b.r")).alias("r"))


def subpixel_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """Each frame against its plane's mean, blurred, to a hundredth of a pixel."""
    f = src.frames(spark, sf)
    fixed = reg.as_rows(f.groupBy("z", "y", "x").agg(F.avg("v").alias("v")), ["z"], "fixed")
    return reg.registered(reg.as_rows(f, ["z", "t"], "moving").join(fixed, "z"), SIDE, 100, 0.5)


def chain_shifts(spark: SparkSession, sf: str) -> DataFrame:
    rows = reg.as_rows(_chunks(spark, sf), ["z", "chunk", "t"], "moving")
    return reg.chained(rows, SIDE, 4)


_C = f"""{src.FRAMES}, n AS (SELECT z, t, row_number() OVER (PARTITION BY z ORDER BY t) - 1 AS i, count(*) OVER (PARTITION BY z) AS n FROM (SELECT DISTINCT z, t FROM frames)),
    k AS (SELECT z, t, i, greatest(1, floor(n / {CHUNK}.0::DOUBLE + 0.5))::BIGINT AS c, n FROM n), ch AS (SELECT z, t, i, i // (n // c) AS chunk FROM k WHERE i // (n // c) < c), cf AS (SELECT z, t, y, x, v, i, chunk FROM frames JOIN ch USING (z, t))"""
_SH = f"""{_C}, cc AS (SELECT a.z, a.i, (b.y - a.y + {SIDE}) % {SIDE} AS sy, (b.x - a.x + {SIDE}) % {SIDE} AS sx, sum(a.v * b.v)::BIGINT AS c FROM cf a JOIN cf b ON a.z = b.z AND b.i = a.i - 1 GROUP BY 1, 2, 3, 4),
    sh AS (SELECT z, i, first(CASE WHEN sy >= 4 THEN sy - 8 ELSE sy END ORDER BY abs(c) DESC, sx, sy) AS dy, first(CASE WHEN sx >= 4 THEN sx - 8 ELSE sx END ORDER BY abs(c) DESC, sx, sy) AS dx, first(c ORDER BY abs(c) DESC, sx, sy) AS peak FROM cc GROUP BY 1, 2)"""

ALL = {
    "chunk_numbers": (chunk_numbers, f"WITH {_C} SELECT z, t, i, chunk FROM ch"),
    "reference_blocks": (reference_blocks, f"WITH {_C} SELECT z, chunk, y, x, round(avg(v), 6) AS mean, median(v) AS median FROM cf GROUP BY 1, 2, 3, 4"),
    "reference_difference": (reference_difference, f"WITH {_C}, r AS (SELECT z, chunk, y, x, round(avg(v), 6) AS mean FROM cf GROUP BY 1, 2, 3, 4) SELECT z, t, round(avg(abs(v - mean)), 6) AS off FROM cf JOIN r USING (z, chunk, y, x) GROUP BY 1, 2"),
    "frame_shifts": (frame_shifts, f"WITH {_SH} SELECT * FROM sh"),
    "trusted_shifts": (trusted_shifts, f"WITH {_SH}, g AS (SELECT z, i, sum(CASE WHEN greatest(abs(dy), abs(dx)) <= {CAP} THEN dy ELSE 0 END) OVER w AS dy, sum(CASE WHEN greatest(abs(dy), abs(dx)) <= {CAP} THEN dx ELSE 0 END) OVER w AS dx FROM sh WINDOW w AS (PARTITION BY z ORDER BY i)) SELECT z, i, dy - median(dy) OVER (PARTITION BY z) AS dy, dx - median(dx) OVER (PARTITION BY z) AS dx FROM g"),
    "moved_frames": (moved_frames, f"WITH {_SH} SELECT a.z, a.i, a.y, a.x, coalesce(b.v, 0) AS v FROM cf a JOIN sh USING (z, i) LEFT JOIN cf b ON b.z = a.z AND b.i = a.i AND b.y = a.y - dy AND b.x = a.x - dx UNION ALL SELECT z, i, y, x, v FROM cf WHERE i = 0"),
    "shift_summary": (shift_summary, f"WITH {_SH} SELECT z, round(median(sqrt(dy * dy + dx * dx)), 6) AS median, round(quantile_cont(sqrt(dy * dy + dx * dx), 0.95), 6) AS p95, median(dy) AS dy, median(dx) AS dx FROM sh GROUP BY 1"),
    "depth_shift": (depth_shift, f"WITH {src.FRAMES}, s AS (SELECT z, y, x, avg(v) AS v FROM frames GROUP BY 1, 2, 3) SELECT a.z, a.y, a.x, round(0.75::DOUBLE * coalesce(b.v, 0) + 0.25::DOUBLE * coalesce(c.v, 0), 9) AS v FROM s a LEFT JOIN s b ON b.z = a.z - 1 AND b.y = a.y AND b.x = a.x LEFT JOIN s c ON c.z = a.z - 2 AND c.y = a.y AND c.x = a.x"),
    "plane_range": (plane_range, f"WITH {src.FRAMES}, h AS (SELECT y, x, nullif(v, 0) AS v FROM frames, (SELECT max(z) + 1 AS nz FROM frames) WHERE z + 1 BETWEEN floor(0.25 * nz + 0.5) AND floor(0.75 * nz + 0.5)) SELECT y, x, round(coalesce(avg(v), 0), 6) AS mean, coalesce(max(v), 0) AS max, coalesce(median(v), 0) AS median FROM h GROUP BY 1, 2"),
    "best_frame": (best_frame, f"WITH {src.FRAMES}, m AS (SELECT z, y, x, round(avg(v), 6) AS w FROM frames GROUP BY 1, 2, 3), r AS (SELECT z, t, round(corr(v, w), 6) AS r FROM frames JOIN m USING (z, y, x) GROUP BY 1, 2) SELECT z, first(t ORDER BY r DESC, t) AS t, max(r) AS r FROM r GROUP BY 1"),
    "subpixel_shifts": (subpixel_shifts, None),
    "chain_shifts": (chain_shifts, None),
}
QUERIES = {k: f for k, (f, _) in ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in ALL.items() if s}
