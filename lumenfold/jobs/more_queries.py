"""Registered queries over neighbourhoods, thresholds, first frames and edited regions, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.jobs import frame_queries as fq
from lumenfold.jobs import mask_queries as mq
from lumenfold.operators import frames as fr
from lumenfold.operators import grid, spatial, stats
from lumenfold.operators import registration as reg
from lumenfold.sources import adapters as src
from lumenfold.sources import files


def annulus_trunks(spark: SparkSession, sf: str) -> DataFrame:
    """Of each seed the connected pieces of the mask in a ring around it."""
    ring = spatial.ring_pixels(mq._seeds(spark, sf), mq._mask(spark, sf), 3, 9)
    pieces = grid.components(ring.select(F.col("id").alias("image"), "y", "x"))
    return pieces.groupBy(F.col("image").alias("id")).agg(F.countDistinct("label").alias("trunks"))


def local_scores(spark: SparkSession, sf: str) -> DataFrame:
    """Each pixel against the median, and the median deviation, of the 5 x 5 square around it."""
    z = (F.col("v") - F.col("med")) / F.greatest(1.4826 * F.col("mad"), F.lit(2.0))
    return spatial.window_spread(mq._px(spark, sf), 2).select("image", "y", "x", F.round(z, 6).alias("z"))


def tissue_thresholds(spark: SparkSession, sf: str) -> DataFrame:
    """The greater of a low percentile and a quarter of Otsu's threshold, over every second pixel of each image."""
    px = mq._px(spark, sf).where("y % 2 = 0 and x % 2 = 0")
    low = px.groupBy("image").agg(F.percentile("v", 0.2).alias("p20"))
    otsu = stats.otsu(px.groupBy("image", "v").agg(F.count("*").alias("n")), "image")
    return low.join(otsu, "image").select("image", F.round(F.greatest("p20", 0.25 * F.col("threshold")), 6).alias("threshold"))


def long_branches(spark: SparkSession, sf: str) -> DataFrame:
    """Pixels between nodes (at most two neighbours), in pieces of at least four."""
    plain = grid.components(grid.degree(mq._mask(spark, sf)).where("degree <= 2").select("image", "y", "x"))
    large = plain.groupBy("image", "label").agg(F.count("*").alias("n")).where("n >= 4").select("image", "label")
    return plain.join(large, ["image", "label"], "left_semi").select("image", "y", "x", "label")


def field_noise(spark: SparkSession, sf: str) -> DataFrame:
    """Of each plane's mean the power of the fastest change from row to row against the median power of the upper half of the band.

    Columns are centred first; power is averaged over columns. Null where the plane has too few rows for four frequencies, or no power there.
    """
    mean = src.frames(spark, sf).groupBy("z", "y", "x").agg(F.avg("v").alias("v"))
    return fr.nyquist_ratio(mean.join(mean.groupBy("z", "x").agg(F.avg("v").alias("m")), ["z", "x"]).select("z", "x", "y", (F.col("v") - F.col("m")).alias("v")))


def first_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Each plane's projections of its first fifty frames."""
    chunks = reg.chunked(src.frames(spark, sf), 20).where("i < 50")
    return fr.project(chunks, "t", ["z", "y", "x"])


def edited_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions after the first of each sample is deleted and one is added for each order of a high price."""
    r = src.rois(spark, sf)
    o = src.read(spark, sf, "orders").where("o_totalprice >= 250000")
    k = F.col("o_orderkey")
    added = o.select(F.col("o_custkey").alias("sample"), (k % 40).alias("x"), (k % 37).alias("y"), F.lit(8).cast("long").alias("w"), F.lit(8).cast("long").alias("h"), k.alias("at"))
    return files.upserted(r, added, r.where("id = 1").select("sample", "id"))


def stitched_times(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks put back in order: each frame's time from its chunk and its place there."""
    c = reg.chunked(src.frames(spark, sf).select("z", "t").distinct(), 20)
    local = c.select("z", "t", "chunk", (F.row_number().over(Window.partitionBy("z", "chunk").orderBy("t")) - 1).alias("k"))
    size = local.where("chunk = 0").groupBy("z").agg(F.count("*").alias("size"))
    return local.join(size, "z").select("z", "t", (F.col("chunk") * F.col("size") + F.col("k")).alias("place"))


def labelled_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Nations' customer counts as JSON, as base64 of their name, and as formatted text."""
    n = src.read(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("n"), F.avg("c_acctbal").alias("m"))
    j = src.read(spark, sf, "nation").join(n, "n_nationkey", "left")
    text = F.when(F.col("m").isNull(), "—").otherwise(F.floor("m").cast("long").cast("string"))
    return j.select("n_nationkey", F.to_json(F.struct("n_nationkey", F.coalesce("n", F.lit(0)).alias("n"))).alias("json"), F.base64(F.col("n_name").cast("binary")).alias("code"), text.alias("mean"))


_S, _D2 = mq._S, "(m.y - s.y) * (m.y - s.y) + (m.x - s.x) * (m.x - s.x)"
_WIN = "JOIN {0} b ON a.image = b.image AND abs(a.y - b.y) <= 2 AND abs(a.x - b.x) <= 2"

ALL = {
    "annulus_trunks": (annulus_trunks, f"{_S}, {mq._SEEDS}, ring AS (SELECT s.id AS image, m.y, m.x FROM seed s JOIN mask m ON m.image = s.image AND {_D2} >= 9 AND {_D2} <= 81), {mq._label('rl', 'ring')} SELECT image AS id, count(DISTINCT label) AS trunks FROM rl GROUP BY 1"),
    "local_scores": (local_scores, f"{_S}, w AS (SELECT a.image, a.y, a.x, a.v, median(b.v) AS med FROM scene a {_WIN.format('scene')} GROUP BY 1, 2, 3, 4), r AS (SELECT *, abs(v - med) AS r FROM w), d AS (SELECT a.image, a.y, a.x, a.v, a.med, median(b.r) AS mad FROM r a {_WIN.format('r')} GROUP BY 1, 2, 3, 4, 5) SELECT image, y, x, round((v - med) / greatest(1.4826::DOUBLE * mad, 2.0::DOUBLE), 6) AS z FROM d"),
    "tissue_thresholds": (tissue_thresholds, f"""WITH {src.SCENES}, s AS (SELECT * FROM scene WHERE y % 2 = 0 AND x % 2 = 0), h AS (SELECT image, v, count(*) AS n FROM s GROUP BY 1, 2),
        c AS (SELECT a.image, a.v, sum(b.n) FILTER (b.v <= a.v) AS w0, sum(b.n * b.v) FILTER (b.v <= a.v) AS s0, sum(b.n) AS w, sum(b.n * b.v) AS s FROM h a JOIN h b ON a.image = b.image GROUP BY 1, 2),
        g AS (SELECT image, v, round((w0::DOUBLE * (w - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)), 3) AS g FROM c WHERE w0 < w), o AS (SELECT image, first(v ORDER BY g DESC, v) AS threshold FROM g GROUP BY 1)
        SELECT image, round(greatest(p20, 0.25::DOUBLE * threshold), 6) AS threshold FROM o JOIN (SELECT image, quantile_cont(v, 0.2) AS p20 FROM s GROUP BY 1) USING (image)"""),
    "long_branches": (long_branches, f"{_S}, {mq._DEG}, plain AS (SELECT image, y, x FROM deg WHERE degree <= 2), {mq._label('pl', 'plain')} SELECT image, y, x, label FROM pl SEMI JOIN (SELECT image, label FROM pl GROUP BY 1, 2 HAVING count(*) >= 4) USING (image, label)"),
    "field_noise": (field_noise, f"""WITH {src.FRAMES}, i AS (SELECT z, y, x, avg(v) AS v FROM frames GROUP BY 1, 2, 3), c AS (SELECT z, x, y, v - avg(v) OVER (PARTITION BY z, x) AS d FROM i), n AS (SELECT z, max(y) + 1 AS n FROM i GROUP BY 1),
        w AS (SELECT z, k, x, sum(d * cos(2 * pi() * k * y / n)) AS re, sum(d * sin(2 * pi() * k * y / n)) AS im FROM c JOIN n USING (z), unnest(range(0, n // 2 + 1)) u(k) GROUP BY 1, 2, 3), p AS (SELECT z, k, avg(re * re + im * im) AS p FROM w GROUP BY 1, 2),
        s AS (SELECT z, count(*) AS bins FROM p GROUP BY 1), b AS (SELECT z, any_value(bins) AS bins, median(p) FILTER (k >= bins // 2 AND k < bins - 1) AS band, max(p) FILTER (k = bins - 1) AS last FROM p JOIN s USING (z) GROUP BY 1) SELECT z, CASE WHEN bins >= 4 AND band > 0 THEN round(last / band, 6) END AS ratio FROM b"""),
    "first_frames": (first_frames, f"WITH {fq._C} SELECT z, y, x, round(avg(v), 6) AS mean, max(v) AS max, median(v) AS median, count(*) AS n FROM cf WHERE i < 50 GROUP BY 1, 2, 3"),
    "edited_regions": (edited_regions, f"WITH {src.ROIS}, kept AS (SELECT sample, id, x, y, w, h FROM roi WHERE id > 1), a AS (SELECT o_custkey AS sample, o_orderkey % 40 AS x, o_orderkey % 37 AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k FROM orders WHERE o_totalprice >= 250000) SELECT * FROM kept UNION ALL SELECT sample, coalesce(top, 0) + k, x, y, 8, 8 FROM a LEFT JOIN (SELECT sample, max(id) AS top FROM kept GROUP BY 1) USING (sample)"),
    "stitched_times": (stitched_times, f"WITH {fq._C} SELECT z, t, i AS place FROM ch"),
    "labelled_rows": (labelled_rows, """WITH n AS (SELECT c_nationkey AS n_nationkey, count(*) AS n, avg(c_acctbal) AS m FROM customer GROUP BY 1) SELECT n_nationkey, '{"n_nationkey":' || n_nationkey || ',"n":' || coalesce(n, 0) || '}' AS json, base64(encode(n_name)) AS code, CASE WHEN m IS NULL THEN '—' ELSE floor(m)::BIGINT::VARCHAR END AS mean FROM nation LEFT JOIN n USING (n_nationkey)"""),
}

