"""Registered queries over regions, tiles, groups and names, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumenfold.functions.numeric import half_away, natural_key
from lumenfold.operators import rois as roi
from lumenfold.operators import stats
from lumenfold.sources import adapters as src

SIDE, ROUNDS = 48, 99
VALUES = ["m1", "m2", "m3"]


def _boxes(spark: SparkSession, sf: str) -> DataFrame:
    return roi.cropped(src.rois(spark, sf), SIDE)


def _long(spark: SparkSession, sf: str) -> DataFrame:
    med = stats.sample_medians(src.metrics(spark, sf), "sample", VALUES, "roi_id")
    return stats.long_form(med.join(src.groups(spark, sf).select("sample", "geno"), "sample"), ["sample", "geno"], VALUES)


def _tiles(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles of 8 pixels with enough foreground: counts, shares, values rounded before they are used."""
    t = src.scenes(spark, sf).groupBy("image", F.floor(F.col("y") / 8).alias("ty"), F.floor(F.col("x") / 8).alias("tx"))
    t = t.agg(F.count("*").alias("n"), F.count_if(F.col("v") >= 45).alias("fg"), F.sum("v").alias("total"), F.count_if(F.col("v") % 3 == 0).alias("tips"))
    kept = t.where("fg / 64.0 >= 0.03 and total >= 1")
    return kept.select("image", "ty", "tx", "n", "fg", F.round(F.col("fg") / 64, 3).alias("fg_share"), F.round(F.col("total") / F.greatest("fg", F.lit(1)), 3).alias("mean"), F.round(F.col("tips") / F.greatest("fg", F.lit(1)), 3).alias("tips_per"))


def _scored(spark: SparkSession, sf: str) -> DataFrame:
    z = stats.standard_scores(_tiles(spark, sf), ["tips_per", "mean", "fg_share"], ["image", "ty", "tx"])
    return z.select("image", "ty", "tx", F.round(F.col("tips_per") + F.col("mean") - F.col("fg_share"), 3).alias("score"))


def _hot(spark: SparkSession, sf: str) -> DataFrame:
    s = _scored(spark, sf)
    return s.join(F.broadcast(s.agg(F.percentile("score", 0.75).alias("cut")))).select("image", "ty", "tx", "score", (F.col("score") > F.col("cut")).alias("hot"))


def roi_clamped(spark: SparkSession, sf: str) -> DataFrame:
    return roi.clamped(src.rois(spark, sf), SIDE, 10)


def roi_cropped(spark: SparkSession, sf: str) -> DataFrame:
    return roi.cropped(src.rois(spark, sf), SIDE, 20)


def roi_tasks(spark: SparkSession, sf: str) -> DataFrame:
    return roi.with_earlier(src.rois(spark, sf))


def roi_covered(spark: SparkSession, sf: str) -> DataFrame:
    return roi.covered(_boxes(spark, sf))


def roi_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return roi.measured(_boxes(spark, sf), src.planes(spark, sf), 30)


def roi_metrics_corrected(spark: SparkSession, sf: str) -> DataFrame:
    return roi.measured(_boxes(spark, sf), src.planes(spark, sf), 30, True)


def tile_features(spark: SparkSession, sf: str) -> DataFrame:
    return _tiles(spark, sf)


def fragmentation(spark: SparkSession, sf: str) -> DataFrame:
    return _hot(spark, sf)


def best_window(spark: SparkSession, sf: str) -> DataFrame:
    """Of each image the tile whose 3 x 3 neighbourhood, of at least 5 tiles, has the greatest mean score, the first in scan order on ties."""
    s = _scored(spark, sf)
    axis = F.array(*[F.lit(k) for k in (-1, 0, 1)])
    around = s.select("image", F.explode(axis).alias("dy"), "ty", "tx", "score").select("*", F.explode(axis).alias("dx"))
    means = around.groupBy("image", (F.col("ty") + F.col("dy")).alias("ty"), (F.col("tx") + F.col("dx")).alias("tx")).agg(F.count("*").alias("n"), F.round(F.avg("score"), 6).alias("mean")).where("n >= 5 and ty between 0 and 3 and tx between 0 and 3")
    return means.groupBy("image").agg(F.min(F.struct((-F.col("mean")).alias("m"), "ty", "tx")).alias("b")).select("image", F.col("b.ty").alias("ty"), F.col("b.tx").alias("tx"), (-F.col("b.m")).alias("mean"))


def image_summary(spark: SparkSession, sf: str) -> DataFrame:
    both = _tiles(spark, sf).join(_hot(spark, sf), ["image", "ty", "tx"])
    return both.groupBy("image").agg(F.count("*").alias("n"), F.round(F.avg("mean"), 6).alias("mean"), F.round(100 * F.avg(F.col("hot").cast("int")), 6).alias("hot_pct"), F.round(F.median("tips_per"), 6).alias("median"), F.round(F.percentile("mean", 0.9), 6).alias("p90"))


def master_table(spark: SparkSession, sf: str) -> DataFrame:
    """Image means by metric and condition, their difference in percent and the least and greatest image."""
    t = _tiles(spark, sf).groupBy("image").agg(*[F.round(F.avg(c), 8).alias(c) for c in ("fg_share", "mean", "tips_per")])
    u = t.unpivot(["image"], ["fg_share", "mean", "tips_per"], "metric", "value")
    wt, het = F.col("image") % 2 == 0, F.col("image") % 2 == 1
    g = u.groupBy("metric").agg(F.avg(F.when(wt, F.col("value"))).alias("a"), F.avg(F.when(het, F.col("value"))).alias("b"), F.round(F.min("value"), 6).alias("least"), F.round(F.max("value"), 6).alias("most"))
    return g.select("metric", F.round("a", 6).alias("wt"), F.round("b", 6).alias("het"), F.round(F.try_divide(100 * (F.col("b") - F.col("a")), F.col("a")), 1).alias("pct"), "least", "most")


def morphotypes(spark: SparkSession, sf: str) -> DataFrame:
    """Tiles in 4 clusters of their standard scores, numbered by falling mean; clusters are learned, so there is no SQL."""
    names = ["tips_per", "mean", "fg_share"]
    z = stats.standard_scores(_tiles(spark, sf), names, ["image", "ty", "tx"]).withColumn("features", array_to_vector(F.array(*names)))
    found = KMeans(k=4, seed=0, maxIter=30).fit(z).transform(z).select("image", "ty", "tx", "mean", "prediction")
    order = found.groupBy("prediction").agg(F.avg("mean").alias("m"))
    order = order.select("prediction", (F.row_number().over(Window.orderBy(F.col("m").desc())) - 1).alias("cluster"))  # four rows
    return found.join(F.broadcast(order), "prediction").select("image", "ty", "tx", "cluster")


def permutation_test(spark: SparkSession, sf: str) -> DataFrame:
    rows = _long(spark, sf).checkpoint()
    p = stats.permutation_p(rows, "sample", "geno", "WT", ROUNDS, 7)
    q = stats.benjamini_hochberg(p.withColumn("family", F.lit(1)), "p", "family").select("metric", F.round("p", 6).alias("p"), F.round("q", 6).alias("q"))
    med = stats.compare(rows, "geno", "WT", "HET").select("metric", F.round("median_a", 6).alias("median_a"), F.round("median_b", 6).alias("median_b"), F.round("hedges_g", 6).alias("hedges_g"))
    return med.join(q, "metric")


def rank_tests(spark: SparkSession, sf: str) -> DataFrame:
    return stats.two_samples(_long(spark, sf), "geno", "WT")


def histogram_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Ten equal bins between the least and greatest price of a segment, the last one closed, with densities."""
    c = src.read(spark, sf, "customer").select("c_mktsegment", F.col("c_acctbal").alias("v"))
    ends = c.groupBy("c_mktsegment").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("*").alias("n"))
    at = F.least(F.lit(9), F.floor(10 * (F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo"))))
    h = c.join(F.broadcast(ends), "c_mktsegment").groupBy("c_mktsegment", at.cast("long").alias("bin")).agg(F.count("*").alias("k"), F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("n").alias("n"))
    return h.select("c_mktsegment", "bin", "k", F.round(F.col("k") / F.col("n") / ((F.col("hi") - F.col("lo")) / 10), 9).alias("density"))


def knot_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    return stats.knot_percentile(src.scenes(spark, sf), "image", "v", 99.0)


def cast_values(spark: SparkSession, sf: str) -> DataFrame:
    """Prices as saturated 16-bit numbers, as display levels with gamma, and rescaled between two ends."""
    o = src.read(spark, sf, "orders")
    v = F.col("o_totalprice")
    unit = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - 1000) / (300000 - 1000)))
    return o.select("o_orderkey", F.least(F.lit(65535), F.greatest(F.lit(0), half_away(v / 4 - 100))).cast("long").alias("u16"), F.floor(F.sqrt(unit) * 255).cast("long").alias("level"), F.round(unit * 2 - 1, 6).alias("scaled"))


def difference_report(spark: SparkSession, sf: str) -> DataFrame:
    """Planes of two images compared pixel by pixel: equal, greatest difference, share that differs."""
    px = src.scenes(spark, sf)
    a = px.select("image", "y", "x", "v")
    b = px.select((F.col("image") - 1).alias("image"), "y", "x", F.col("v").alias("w"))
    d = a.join(b, ["image", "y", "x"], "full").select("image", F.abs(F.coalesce("v", F.lit(0)) - F.coalesce("w", F.lit(0))).alias("d"))
    return d.groupBy("image").agg(F.bool_and(F.col("d") == 0).alias("same"), F.max("d").alias("most"), F.round(F.avg((F.col("d") > 0).cast("int")), 6).alias("differs"))


def probe_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Of each customer the worst, middle and best order, and whether it is one of five evenly spaced probes."""
    o = src.read(spark, sf, "orders")
    w = Window.partitionBy("o_custkey")
    r = o.select("o_custkey", "o_orderkey", F.row_number().over(w.orderBy("o_totalprice", "o_orderkey")).alias("i"), F.count("*").over(w).alias("n"))
    role = F.when(F.col("i") == 1, "worst").when(F.col("i") == F.col("n"), "best").when(F.col("i") == F.floor(F.col("n") / 2) + 1, "middle")
    probe = F.exists(F.sequence(F.lit(0), F.lit(4)), lambda k: F.floor(k * (F.col("n") - 1) / 4) == F.col("i") - 1)
    return r.select("o_custkey", "o_orderkey", role.alias("role"), probe.alias("probe")).where(F.col("role").isNotNull() | F.col("probe"))


def natural_order(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a folder numbered in natural order of names: every run of digits counts as a number."""
    p = src.read(spark, sf, "part").select("p_partkey", (F.col("p_partkey") % 50).alias("folder"), F.concat(F.lit("scan_T"), (F.col("p_partkey") % 13).cast("string"), F.lit("_C"), F.col("p_partkey").cast("string"), F.lit(".tif")).alias("name"))
    return p.select("folder", "name", F.row_number().over(Window.partitionBy("folder").orderBy(natural_key("name"), "name")).cast("long").alias("place"))


def dimensions(spark: SparkSession, sf: str) -> DataFrame:
    """Of file names with channel, plane and time the greatest of each, by folder, and how many files are missing."""
    l = src.read(spark, sf, "lineitem").select((F.col("l_suppkey") % 20).alias("folder"), F.concat_ws("", F.lit("r_C"), (F.col("l_linenumber") % 2 + 1).cast("string"), F.lit("Z"), F.lpad((F.col("l_partkey") % 9 + 1).cast("string"), 3, "0"), F.lit("T"), F.lpad((F.col("l_orderkey") % 30 + 1).cast("string"), 3, "0"), F.lit(".tif")).alias("name")).distinct()
    part = lambda k: F.regexp_extract("name", r"C(\d+)Z(\d+)T(\d+)\.tif$", k).cast("long")
    d = l.groupBy("folder").agg(F.max(part(1)).alias("nc"), F.max(part(2)).alias("nz"), F.max(part(3)).alias("nt"), F.count("*").alias("n"))
    return d.withColumn("missing", F.col("nc") * F.col("nz") * F.col("nt") - F.col("n"))


def image_names(spark: SparkSession, sf: str) -> DataFrame:
    """Customers' names as image keys: a first pattern, else a second, else the whole; the condition read from the key; repeated keys keep the whole."""
    c = src.read(spark, sf, "customer").select("c_custkey", F.concat_ws("_", F.substring("c_mktsegment", 1, 1), F.when(F.col("c_custkey") % 3 == 0, "WT").when(F.col("c_custkey") % 3 == 1, "HET").otherwise("x"), (F.col("c_custkey") % 200).cast("string"), F.lit("raw")).alias("stem"))
    key = F.coalesce(F.nullif(F.regexp_extract("stem", "^([A-Z]_(?:WT|HET)_[0-9]+)", 1), F.lit("")), F.nullif(F.regexp_extract("stem", "_([0-9]+)_", 1), F.lit("")), F.col("stem"))
    k = c.withColumn("key", key).withColumn("i", F.row_number().over(Window.partitionBy("key").orderBy("c_custkey")))
    return k.select("c_custkey", F.when(F.col("i") > 1, F.concat_ws("_", "stem", F.col("i").cast("string"))).otherwise(F.col("key")).alias("key"), F.when(F.contains(F.upper("key"), F.lit("WT")), "WT").otherwise("HET").alias("condition"))


def seeded_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Of each customer's orders three without replacement, by a seeded digest."""
    o = src.read(spark, sf, "orders").select("o_custkey", "o_orderkey")
    place = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.md5(F.concat(F.lit("20260524:"), F.col("o_orderkey").cast("string")).cast("binary")), "o_orderkey"))
    return o.withColumn("i", place).where("i <= 3").select("o_custkey", "o_orderkey")


def digests(spark: SparkSession, sf: str) -> DataFrame:
    """SHA-256 of each page against a list of known ones (of the longer pages, some of them altered)."""
    p = src.read(spark, sf, "pages").select("page_id", F.sha2(F.coalesce("html", F.lit("")).cast("binary"), 256).alias("digest"), F.length("html").alias("n"))
    known = p.where("n > 1500").select("page_id", F.when(F.startswith("digest", F.lit("0")), F.reverse("digest")).otherwise(F.col("digest")).alias("known"))
    return p.join(known, "page_id", "left").select("page_id", "digest", F.when(F.col("known").isNull(), "unknown").when(F.col("known") == F.col("digest"), "same").otherwise("differs").alias("state"))


def longest_thin_run(spark: SparkSession, sf: str) -> DataFrame:
    """Of each order's lines, as a path of radii, the longest run thinner than half the thinner end, ends trimmed, and the neck's ratio."""
    w = Window.partitionBy("l_orderkey")
    place = F.row_number().over(w.orderBy("l_linenumber", "l_partkey", "l_quantity"))
    l = src.read(spark, sf, "lineitem").select("l_orderkey", place.alias("i"), F.col("l_quantity").alias("r"))
    e = l.select("*", F.first("r").over(w.orderBy("i")).alias("a"), F.first("r").over(w.orderBy(F.col("i").desc())).alias("b"), F.min("i").over(w).alias("i0"), F.max("i").over(w).alias("i1"))
    inner = e.where((F.col("i") > F.col("i0")) & (F.col("i") < F.col("i1"))).withColumn("thin", F.col("r") < 0.5 * F.least("a", "b"))
    run = inner.where("thin").withColumn("g", F.col("i") - F.row_number().over(w.orderBy("i"))).groupBy("l_orderkey", "g").agg(F.count("*").alias("n")).groupBy("l_orderkey").agg(F.max("n").alias("n"))
    neck = inner.groupBy("l_orderkey").agg(F.min("r").alias("least"), F.first(F.least("a", "b")).alias("ends"))
    return neck.join(run, "l_orderkey", "left").select("l_orderkey", F.coalesce("n", F.lit(0)).alias("longest"), F.round(F.col("least") / F.col("ends"), 6).alias("neck"))


def screening_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Parts through a cascade of gates: how many fail at which gate first, by tier of size."""
    p = src.read(spark, sf, "part")
    reason = F.when(F.col("p_size") < 6, "small").when(F.col("p_size") > 45, "large").when(F.col("p_retailprice") < 950, "dim").when(F.contains("p_type", F.lit("STEEL")), "long").otherwise("accepted")
    tier = F.when(F.col("p_size") >= 30, "ramified").when(F.col("p_size") >= 15, "middle").otherwise("bare")
    return p.groupBy(reason.alias("reason"), tier.alias("tier")).agg(F.count("*").alias("n"))


def combined_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Two generations of seeds under one another, each with its source, columns that one lacks being null."""
    s = src.seeds(spark, sf)
    old = s.where("n_dirs >= 3").select("label", "blob", "compact").withColumn("source", F.lit("first"))
    new = s.where("n_dirs < 3 and blob >= 0.5").select("label", "blob", "tube").withColumn("source", F.lit("second"))
    return old.unionByName(new, allowMissingColumns=True)


def version_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts by version and class, side by side, with the baseline's share or a default text."""
    o = src.read(spark, sf, "orders").groupBy((F.col("o_orderkey") % 11).alias("version")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).fillna(0)
    base = src.read(spark, sf, "orders").where("o_orderstatus = 'P' and o_totalprice > 400000").groupBy((F.col("o_orderkey") % 11).alias("version")).agg(F.count("*").alias("was"))
    return o.join(base, "version", "left").select("version", "F", "O", "P", F.coalesce(F.col("was").cast("string"), F.lit("none")).alias("was"))


def order_spectrum(spark: SparkSession, sf: str) -> DataFrame:
    """Of each customer the shares of orders with three, four and five or more lines; those with fewer are no junctions."""
    l = src.read(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("k"))
    j = l.where("k >= 3").join(src.read(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey")
    pct = lambda c: F.round(100 * F.avg(c.cast("int")), 6)
    return j.groupBy("o_custkey").agg(F.count("*").alias("n"), F.round(F.avg("k"), 6).alias("mean"), pct(F.col("k") == 3).alias("pct3"), pct(F.col("k") == 4).alias("pct4"), pct(F.col("k") >= 5).alias("pct5"))


def calibration(spark: SparkSession, sf: str) -> DataFrame:
    """At each of a few thresholds the share of wanted and of unwanted seeds that it keeps."""
    s = src.seeds(spark, sf)
    tried = s.select("compact", (F.col("n_dirs") >= 4).alias("wanted"), F.explode(F.array(*[F.lit(t / 10) for t in range(1, 10)])).alias("cut"))
    keep = F.col("compact") >= F.col("cut")
    return tried.groupBy("cut").agg(F.round(100 * F.avg(F.when(F.col("wanted"), keep.cast("int"))), 6).alias("keep_pct"), F.round(100 * F.avg(F.when(~F.col("wanted"), (~keep).cast("int"))), 6).alias("cut_pct"))


def seed_rules(spark: SparkSession, sf: str) -> DataFrame:
    """The two reject rules of the first detector, and its counts with 0 for accepted seeds that nothing was counted for."""
    s = src.seeds(spark, sf).withColumn("ok", ~((F.col("lc_ecc") > 0.85) & (F.col("n_dirs") <= 2)) & ~((F.col("tube") > F.col("blob")) & (F.col("n_dirs") <= 2)))
    counts = src.read(spark, sf, "lineitem").where("l_quantity >= 45").groupBy(F.col("l_partkey").alias("label")).agg(F.count("*").alias("n"))
    return s.where("ok").join(counts, "label", "left").select("label", F.coalesce("n", F.lit(0)).alias("n"))


_B = f"{src.ROIS}, box AS (SELECT *, greatest(0, x1 - x0) * greatest(0, y1 - y0) AS area FROM (SELECT sample, id, greatest(0, x) AS x0, least({SIDE}, x + w) AS x1, greatest(0, y) AS y0, least({SIDE}, y + h) AS y1 FROM roi))"
_IN = f"{_B}, {src.PLANES}, inside AS (SELECT b.sample, b.id, b.area, p.y, p.x, p.v FROM box b JOIN px p ON p.sample = b.sample AND p.y >= y0 AND p.y < y1 AND p.x >= x0 AND p.x < x1 WHERE area >= 1)"
_MEASURE = "SELECT sample, id, count(*) AS n, sum(v)::BIGINT AS total, round(sum(v) / count(*)::DOUBLE, 6) AS mean, max(v) AS peak, round(100 * count(*) FILTER (v >= 30) / count(*)::DOUBLE, 6) AS bright_pct, round(sum(v) / any_value(area)::DOUBLE, 6) AS per_area FROM {} GROUP BY 1, 2"
_T = f"{src.SCENES}, tile AS (SELECT image, ty, tx, n, fg, round(fg / 64.0::DOUBLE, 3) AS fg_share, round(total / greatest(fg, 1)::DOUBLE, 3) AS mean, round(tips / greatest(fg, 1)::DOUBLE, 3) AS tips_per FROM (SELECT image, y // 8 AS ty, x // 8 AS tx, count(*) AS n, count(*) FILTER (v >= 45) AS fg, sum(v)::BIGINT AS total, count(*) FILTER (v % 3 = 0) AS tips FROM scene GROUP BY 1, 2, 3) WHERE fg / 64.0 >= 0.03 AND total >= 1)"
_Z = lambda c: f"({c} - (SELECT avg({c}) FROM tile)) / ((SELECT stddev_pop({c}) FROM tile) + 1e-9::DOUBLE)"
_SC = f"{_T}, sc AS (SELECT image, ty, tx, round({_Z('tips_per')} + {_Z('mean')} - {_Z('fg_share')}, 3) AS score FROM tile)"
_HOT = f"{_SC}, hot AS (SELECT *, score > (SELECT quantile_cont(score, 0.75) FROM sc) AS hot FROM sc)"
_MED = f"{src.METRICS}, medians AS (SELECT sample, median(m1) AS m1, median(m2) AS m2, median(m3) AS m3 FROM metrics GROUP BY 1), {src.GROUPS}, long AS (SELECT sample, geno, metric, value FROM (SELECT sample, geno, m1, m2, m3 FROM medians JOIN grp USING (sample)) UNPIVOT (value FOR metric IN (m1, m2, m3)))"

ALL = {
    "roi_clamped": (roi_clamped, f"WITH {src.ROIS} SELECT sample, id, greatest(0, least(x, {SIDE} - least(w, 10))) AS x, greatest(0, least(y, {SIDE} - least(h, 10))) AS y, least(w, 10) AS w, least(h, 10) AS h FROM roi"),
    "roi_cropped": (roi_cropped, f"WITH {_B} SELECT * FROM box WHERE area >= 20"),
    "roi_tasks": (roi_tasks, f"WITH {src.ROIS} SELECT sample, id, id - 1 AS n_earlier, coalesce(string_agg(concat_ws(':', x, y, w, h), ';') OVER (PARTITION BY sample ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS earlier FROM roi"),
    "roi_covered": (roi_covered, f"WITH {_B}, cell AS (SELECT sample, id, y, x FROM box, unnest(range(y0, y1)) a(y), unnest(range(x0, x1)) b(x)), o AS (SELECT a.sample, a.id, count(*) AS n FROM cell a WHERE EXISTS (SELECT 1 FROM cell b WHERE b.sample = a.sample AND b.y = a.y AND b.x = a.x AND b.id < a.id) GROUP BY 1, 2) SELECT sample, id, area, coalesce(n, 0) AS overlap FROM box LEFT JOIN o USING (sample, id) WHERE area >= 1"),
    "roi_metrics": (roi_metrics, f"WITH {_IN} {_MEASURE.format('inside')}"),
    "roi_metrics_corrected": (roi_metrics_corrected, f"WITH {_IN}, left_over AS (SELECT * FROM inside i WHERE NOT EXISTS (SELECT 1 FROM box b WHERE b.sample = i.sample AND b.id < i.id AND i.y >= y0 AND i.y < y1 AND i.x >= x0 AND i.x < x1)) {_MEASURE.format('left_over')}"),
    "tile_features": (tile_features, f"WITH {_T} SELECT * FROM tile"),
    "fragmentation": (fragmentation, f"WITH {_HOT} SELECT * FROM hot"),
    "best_window": (best_window, f"WITH {_SC}, m AS (SELECT c.image, c.ty, c.tx, round(avg(s.score), 6) AS mean FROM (SELECT DISTINCT image, a.ty, b.tx FROM sc, range(0, 4) a(ty), range(0, 4) b(tx)) c JOIN sc s ON s.image = c.image AND abs(s.ty - c.ty) <= 1 AND abs(s.tx - c.tx) <= 1 GROUP BY 1, 2, 3 HAVING count(*) >= 5) SELECT image, first(ty ORDER BY mean DESC, ty, tx) AS ty, first(tx ORDER BY mean DESC, ty, tx) AS tx, max(mean) AS mean FROM m GROUP BY 1"),
    "image_summary": (image_summary, f"WITH {_HOT} SELECT image, count(*) AS n, round(avg(mean), 6) AS mean, round(100 * avg(hot::INT), 6) AS hot_pct, round(median(tips_per), 6) AS median, round(quantile_cont(mean, 0.9), 6) AS p90 FROM tile JOIN hot USING (image, ty, tx) GROUP BY 1"),
    "master_table": (master_table, f"""WITH {_T}, t AS (SELECT image, round(avg(fg_share), 8) AS fg_share, round(avg(mean), 8) AS mean, round(avg(tips_per), 8) AS tips_per FROM tile GROUP BY 1), u AS (UNPIVOT t ON fg_share, mean, tips_per INTO NAME metric VALUE value),
        g AS (SELECT metric, avg(value) FILTER (image % 2 = 0) AS a, avg(value) FILTER (image % 2 = 1) AS b, round(min(value), 6) AS least, round(max(value), 6) AS most FROM u GROUP BY 1) SELECT metric, round(a, 6) AS wt, round(b, 6) AS het, round(100 * (b - a) / a, 1) AS pct, least, most FROM g"""),
    "morphotypes": (morphotypes, None),
    "permutation_test": (permutation_test, f"""WITH {_MED}, u AS (SELECT *, count(*) FILTER (geno = 'WT') OVER (PARTITION BY metric) AS na FROM long WHERE value IS NOT NULL), d AS (SELECT metric, value, r, row_number() OVER (PARTITION BY metric, r ORDER BY md5('7:' || r || ':' || sample), sample) <= na AS in_a FROM u, range(1, {ROUNDS + 1}) k(r)),
        s AS (SELECT metric, avg(value) FILTER (geno = 'WT') - avg(value) FILTER (geno <> 'WT') AS d, median(value) FILTER (geno = 'WT') AS da, median(value) FILTER (geno <> 'WT') AS db, avg(value) FILTER (geno = 'WT') AS ma, avg(value) FILTER (geno <> 'WT') AS mb, var_samp(value) FILTER (geno = 'WT') AS va, var_samp(value) FILTER (geno <> 'WT') AS vb, count(*) FILTER (geno = 'WT') AS na, count(*) FILTER (geno <> 'WT') AS nb FROM long GROUP BY 1),
        e AS (SELECT metric, r, avg(value) FILTER (in_a) - avg(value) FILTER (NOT in_a) AS e FROM d GROUP BY 1, 2), p AS (SELECT metric, (count(*) FILTER (abs(e) >= abs(d) - 1e-12::DOUBLE) + 1) / {ROUNDS + 1}::DOUBLE AS p FROM e JOIN s USING (metric) GROUP BY 1),
        q AS (SELECT metric, p, p * count(*) OVER () / (SELECT count(*) FROM p b WHERE b.p <= a.p) AS r FROM p a)
        SELECT metric, round(da, 6) AS median_a, round(db, 6) AS median_b, round((1 - 3 / (4 * (na + nb) - 9)::DOUBLE) * (ma - mb) / sqrt(((na - 1) * va + (nb - 1) * vb) / (na + nb - 2)), 6) AS hedges_g, round(p, 6) AS p, round(least(1, (SELECT min(b.r) FROM q b WHERE b.p >= a.p)), 6) AS q FROM q a JOIN s USING (metric)"""),
    "rank_tests": (rank_tests, f"""WITH {_MED}, r AS (SELECT metric, geno, value, rank() OVER (PARTITION BY metric ORDER BY value) + (count(*) OVER (PARTITION BY metric, value) - 1) / 2.0::DOUBLE AS k, count(*) OVER (PARTITION BY metric, value) AS t,
        count(*) FILTER (geno = 'WT') OVER (PARTITION BY metric ORDER BY value) AS ca, count(*) FILTER (geno <> 'WT') OVER (PARTITION BY metric ORDER BY value) AS cb, count(*) FILTER (geno = 'WT') OVER (PARTITION BY metric) AS na, count(*) FILTER (geno <> 'WT') OVER (PARTITION BY metric) AS nb FROM long),
        s AS (SELECT metric, any_value(na)::DOUBLE AS na, any_value(nb)::DOUBLE AS nb, sum(k) FILTER (geno = 'WT') AS r, max(abs(ca / na::DOUBLE - cb / nb::DOUBLE)) AS ks, sum(t::DOUBLE * t - 1) AS ties FROM r GROUP BY 1)
        SELECT metric, r - na * (na + 1) / 2 AS u, round((r - na * (na + 1) / 2 - na * nb / 2) / sqrt(na * nb / 12 * (na + nb + 1 - ties / ((na + nb) * (na + nb - 1)))), 6) AS z, round(ks, 6) AS ks FROM s"""),
    "histogram_bins": (histogram_bins, "WITH e AS (SELECT c_mktsegment, min(c_acctbal) AS lo, max(c_acctbal) AS hi, count(*) AS n FROM customer GROUP BY 1) SELECT c_mktsegment, least(9, floor(10 * (c_acctbal - lo) / (hi - lo)))::BIGINT AS bin, count(*) AS k, round(count(*) / any_value(n)::DOUBLE / ((any_value(hi) - any_value(lo)) / 10), 9) AS density FROM customer JOIN e USING (c_mktsegment) GROUP BY 1, 2"),
    "knot_percentiles": (knot_percentiles, f"WITH {src.SCENES}, r AS (SELECT image, v, row_number() OVER (PARTITION BY image ORDER BY v) AS i, count(*) OVER (PARTITION BY image) AS n FROM scene) SELECT image, round(sum(v * greatest(0, 1 - abs(i - greatest(1, least(n, 0.99::DOUBLE * n + 0.5))))), 6) AS p FROM r GROUP BY 1"),
    "cast_values": (cast_values, "SELECT o_orderkey, least(65535, greatest(0, sign(o_totalprice / 4 - 100) * floor(abs(o_totalprice / 4 - 100) + 0.5)))::BIGINT AS u16, floor(sqrt(greatest(0, least(1, (o_totalprice - 1000) / 299000))) * 255)::BIGINT AS level, round(greatest(0, least(1, (o_totalprice - 1000) / 299000)) * 2 - 1, 6) AS scaled FROM orders"),
    "difference_report": (difference_report, f"WITH {src.SCENES}, d AS (SELECT image, abs(coalesce(v, 0) - coalesce(w, 0)) AS d FROM scene FULL JOIN (SELECT image - 1 AS image, y, x, v AS w FROM scene) USING (image, y, x)) SELECT image, bool_and(d = 0) AS same, max(d) AS most, round(avg((d > 0)::INT), 6) AS differs FROM d GROUP BY 1"),
    "probe_rows": (probe_rows, """WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders),
        s AS (SELECT o_custkey, o_orderkey, CASE WHEN i = 1 THEN 'worst' WHEN i = n THEN 'best' WHEN i = n // 2 + 1 THEN 'middle' END AS role, i - 1 IN (0, (n - 1) // 4, (2 * (n - 1)) // 4, (3 * (n - 1)) // 4, n - 1) AS probe FROM r) SELECT * FROM s WHERE role IS NOT NULL OR probe"""),
    "natural_order": (natural_order, "SELECT p_partkey % 50 AS folder, 'scan_T' || p_partkey % 13 || '_C' || p_partkey || '.tif' AS name, row_number() OVER (PARTITION BY p_partkey % 50 ORDER BY p_partkey % 13, p_partkey) AS place FROM part"),
    "dimensions": (dimensions, "WITH l AS (SELECT DISTINCT l_suppkey % 20 AS folder, l_linenumber % 2 + 1 AS c, l_partkey % 9 + 1 AS z, l_orderkey % 30 + 1 AS t FROM lineitem) SELECT folder, max(c)::BIGINT AS nc, max(z)::BIGINT AS nz, max(t)::BIGINT AS nt, count(*) AS n, (max(c) * max(z) * max(t) - count(*))::BIGINT AS missing FROM l GROUP BY 1"),
    "image_names": (image_names, """WITH c AS (SELECT c_custkey, left(c_mktsegment, 1) || '_' || CASE c_custkey % 3 WHEN 0 THEN 'WT' WHEN 1 THEN 'HET' ELSE 'x' END || '_' || c_custkey % 200 || '_raw' AS stem, CASE WHEN c_custkey % 3 = 2 THEN (c_custkey % 200)::VARCHAR ELSE left(c_mktsegment, 1) || '_' || CASE c_custkey % 3 WHEN 0 THEN 'WT' ELSE 'HET' END || '_' || c_custkey % 200 END AS key FROM customer),
        k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c_custkey) AS i FROM c) SELECT c_custkey, CASE WHEN i > 1 THEN stem || '_' || i ELSE key END AS key, CASE WHEN key LIKE '%WT%' THEN 'WT' ELSE 'HET' END AS condition FROM k"""),
    "seeded_choice": (seeded_choice, "SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY md5('20260524:' || o_orderkey), o_orderkey) AS i FROM orders) WHERE i <= 3"),
    "digests": (digests, "SELECT page_id, sha256(coalesce(html, '')) AS digest, CASE WHEN html IS NULL OR length(html) <= 1500 THEN 'unknown' WHEN sha256(html) NOT LIKE '0%' THEN 'same' ELSE 'differs' END AS state FROM pages"),
    "longest_thin_run": (longest_thin_run, """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_quantity) AS i, l_quantity AS r FROM lineitem), e AS (SELECT *, least(first_value(r) OVER (PARTITION BY l_orderkey ORDER BY i), first_value(r) OVER (PARTITION BY l_orderkey ORDER BY i DESC)) AS ends, 1 AS i0, max(i) OVER (PARTITION BY l_orderkey) AS i1 FROM l),
        n AS (SELECT * FROM e WHERE i > i0 AND i < i1), g AS (SELECT l_orderkey, i - row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS g FROM n WHERE r < 0.5 * ends), c AS (SELECT l_orderkey, max(k) AS k FROM (SELECT l_orderkey, g, count(*) AS k FROM g GROUP BY 1, 2) GROUP BY 1)
        SELECT l_orderkey, coalesce(any_value(k), 0) AS longest, round(min(r) / any_value(ends), 6) AS neck FROM n LEFT JOIN c USING (l_orderkey) GROUP BY 1"""),
    "screening_reasons": (screening_reasons, "SELECT CASE WHEN p_size < 6 THEN 'small' WHEN p_size > 45 THEN 'large' WHEN p_retailprice < 950 THEN 'dim' WHEN contains(p_type, 'STEEL') THEN 'long' ELSE 'accepted' END AS reason, CASE WHEN p_size >= 30 THEN 'ramified' WHEN p_size >= 15 THEN 'middle' ELSE 'bare' END AS tier, count(*) AS n FROM part GROUP BY 1, 2"),
    "combined_seeds": (combined_seeds, f"WITH {src.SEEDS} SELECT label, blob, compact, NULL::DOUBLE AS tube, 'first' AS source FROM seeds WHERE n_dirs >= 3 UNION ALL SELECT label, blob, NULL, tube, 'second' FROM seeds WHERE n_dirs < 3 AND blob >= 0.5"),
    "version_counts": (version_counts, "SELECT version, F, O, P, CASE WHEN w > 0 THEN w::VARCHAR ELSE 'none' END AS was FROM (SELECT o_orderkey % 11 AS version, count(*) FILTER (o_orderstatus = 'P' AND o_totalprice > 400000) AS w, count(*) FILTER (o_orderstatus = 'F') AS F, count(*) FILTER (o_orderstatus = 'O') AS O, count(*) FILTER (o_orderstatus = 'P') AS P FROM orders GROUP BY 1)"),
    "order_spectrum": (order_spectrum, "WITH j AS (SELECT o_custkey, count(*) AS k FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_custkey, l_orderkey HAVING count(*) >= 3) SELECT o_custkey, count(*) AS n, round(avg(k), 6) AS mean, round(100 * avg((k = 3)::INT), 6) AS pct3, round(100 * avg((k = 4)::INT), 6) AS pct4, round(100 * avg((k >= 5)::INT), 6) AS pct5 FROM j GROUP BY 1"),
    "calibration": (calibration, f"WITH {src.SEEDS} SELECT cut, round(100 * avg((compact >= cut)::INT) FILTER (n_dirs >= 4), 6) AS keep_pct, round(100 * avg((compact < cut)::INT) FILTER (n_dirs < 4), 6) AS cut_pct FROM seeds, (SELECT t / 10.0::DOUBLE AS cut FROM range(1, 10) r(t)) GROUP BY 1"),
    "seed_rules": (seed_rules, f"WITH {src.SEEDS} SELECT label, coalesce(n, 0) AS n FROM seeds LEFT JOIN (SELECT l_partkey AS label, count(*) AS n FROM lineitem WHERE l_quantity >= 45 GROUP BY 1) USING (label) WHERE NOT (lc_ecc > 0.85 AND n_dirs <= 2) AND NOT (tube > blob AND n_dirs <= 2)"),
}
QUERIES = {k: f for k, (f, _) in ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in ALL.items() if s}
