"""Registered queries over the image relations, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.functions.numeric import half_away, percent_change, stretch
from lumenfold.jobs import cell_queries, frame_queries, mask_queries, more_queries, plane_queries, table_queries
from lumenfold.operators import cells, frames, grid, rois, spatial, stats
from lumenfold.sources import adapters as src

VALUES = ["m1", "m2", "m3"]


def _medians(spark: SparkSession, sf: str) -> DataFrame:
    return stats.sample_medians(src.metrics(spark, sf), "sample", VALUES, "roi_id")


def _long(spark: SparkSession, sf: str) -> DataFrame:
    both = _medians(spark, sf).join(src.groups(spark, sf).select("sample", "geno"), "sample")
    return stats.long_form(both, ["sample", "geno"], VALUES)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def animal_medians(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(_medians(spark, sf), *VALUES)


def group_compare(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.compare(_long(spark, sf), "geno", "WT", "HET"), "median_a", "median_b", "hedges_g", "cohens_d")


def group_deltas(spark: SparkSession, sf: str) -> DataFrame:
    means = _long(spark, sf).groupBy("metric").agg(*[F.avg(F.when(F.col("geno") == g, F.col("value"))).alias(g) for g in ("WT", "HET")])
    return means.select("metric", F.round(percent_change(F.col("HET"), F.col("WT")), 6).alias("pct"))


def spearman_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    both = _medians(spark, sf).join(src.groups(spark, sf), "sample")
    return _rounded(stats.spearman(both, "m2", "c_acctbal", "c_mktsegment"), "rho")


def fdr_by_nation(spark: SparkSession, sf: str) -> DataFrame:
    tested = src.groups(spark, sf).groupBy("c_nationkey").agg(((F.count_if(F.col("c_acctbal") < 0) + 1) / (F.count("*") + 1)).alias("p"))
    return _rounded(stats.benjamini_hochberg(tested.withColumn("family", F.col("c_nationkey") % 2), "p", "family").select("c_nationkey", "p", "q"), "p", "q")


def replicate_screen(spark: SparkSession, sf: str) -> DataFrame:
    image = src.groups(spark, sf).groupBy("c_nationkey", F.col("c_mktsegment").alias("metric")).agg(F.round(F.avg("c_acctbal"), 6).alias("value"))
    image = image.withColumn("condition", F.when(F.col("c_nationkey") % 2 == 0, "WT").otherwise("HET"))
    return stats.replicate_screen(image, "metric", "condition", "value", "WT")


def variation(spark: SparkSession, sf: str) -> DataFrame:
    cv = src.pixels(spark, sf).groupBy("image").agg(F.coalesce(F.try_divide(F.stddev_pop("v"), F.avg("v")), F.lit(0.0)).alias("cv"))
    return _rounded(cv, "cv")


def percentile_ladder(spark: SparkSession, sf: str) -> DataFrame:
    qs = [5, 25, 50, 75, 95]
    p = src.pixels(spark, sf).groupBy("image").agg(F.percentile("v", [q / 100 for q in qs]).alias("p"))
    return p.select("image", *[F.round(F.col("p")[i], 6).alias(f"p{q}") for i, q in enumerate(qs)])


def otsu_threshold(spark: SparkSession, sf: str) -> DataFrame:
    return stats.otsu(src.pixels(spark, sf).groupBy("image", "v").agg(F.count("*").alias("n")), "image")


def noise_floor(spark: SparkSession, sf: str) -> DataFrame:
    return _rounded(stats.noise_floor(src.pixels(spark, sf), "image", "v"), "sigma")


def stretched(spark: SparkSession, sf: str) -> DataFrame:
    px = src.pixels(spark, sf)
    ends = px.groupBy("image").agg(F.percentile("v", 0.02).alias("lo"), F.percentile("v", 0.98).alias("hi"))
    return px.join(F.broadcast(ends), "image").select("image", "y", "x", F.round(stretch(F.col("v"), F.col("lo"), F.col("hi")), 6).alias("u"), half_away(F.col("v") / 4).cast("long").alias("q"))


def z_scores(spark: SparkSession, sf: str) -> DataFrame:
    px = src.pixels(spark, sf)
    s = px.groupBy("image").agg(F.avg("v").alias("m"), F.stddev_pop("v").alias("s"))
    return px.join(F.broadcast(s), "image").select("image", "y", "x", F.round((F.col("v") - F.col("m")) / (F.col("s") + 1e-9), 6).alias("z"))


def value_counts(spark: SparkSession, sf: str) -> DataFrame:
    return src.pixels(spark, sf).groupBy("image", F.least(F.floor(F.col("v") / 10), F.lit(10)).alias("bin")).agg(F.count("*").alias("n"))


def composition(spark: SparkSession, sf: str) -> DataFrame:
    kinds = cells.scored_seeds(src.seeds(spark, sf)).groupBy((F.col("label") % 3).alias("image"), "type").agg(F.count("*").alias("n"))
    total = kinds.groupBy("image").agg(F.sum("n").alias("t"))
    return kinds.join(F.broadcast(total), "image").select("image", "type", "n", F.round(100 * F.col("n") / F.col("t"), 6).alias("pct"))


def tile_counts(spark: SparkSession, sf: str) -> DataFrame:
    return grid.tiles(src.pixels(spark, sf), 16)


def window_counts(spark: SparkSession, sf: str) -> DataFrame:
    return grid.windows(src.pixels(spark, sf), 16, 8, 64)


def _mask(spark: SparkSession, sf: str, q: float) -> DataFrame:
    px = src.pixels(spark, sf)
    cut = px.groupBy("image").agg(F.percentile("v", q).alias("cut"))
    return px.join(F.broadcast(cut), "image").where("v > cut").select("image", "y", "x", "v")


def pixel_degree(spark: SparkSession, sf: str) -> DataFrame:
    return grid.degree(_mask(spark, sf, 0.9))


def skeleton_nodes(spark: SparkSession, sf: str) -> DataFrame:
    d = grid.degree(_mask(spark, sf, 0.9))
    return d.groupBy("image").agg(F.count_if(F.col("degree") == 1).alias("endpoints"), F.count_if(F.col("degree") >= 3).alias("junction_px"), F.count("*").alias("px"))


def mask_components(spark: SparkSession, sf: str) -> DataFrame:
    return grid.components(_mask(spark, sf, 0.95))


def component_features(spark: SparkSession, sf: str) -> DataFrame:
    return grid.component_features(grid.components(_mask(spark, sf, 0.95)))


def large_components(spark: SparkSession, sf: str) -> DataFrame:
    labelled = grid.components(_mask(spark, sf, 0.95))
    big = labelled.groupBy("image", "label").agg(F.count("*").alias("n")).where("n >= 3").select("image", "label")
    return labelled.join(big, ["image", "label"], "left_semi").select("image", "y", "x", "label")


def seed_scores(spark: SparkSession, sf: str) -> DataFrame:
    return cells.scored_seeds(src.seeds(spark, sf)).select("label", F.round("score", 6).alias("score"), "type")


def threshold_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return cells.sweep(cells.scored_seeds(src.seeds(spark, sf)), [0.2, 0.3, 0.4, 0.5, 0.6], [0.2, 0.26, 0.3], [0.0, 1.0, 2.0])


def top_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return cells.scored_seeds(src.seeds(spark, sf)).orderBy(F.col("score").desc(), "label").limit(10).select("label", F.round("score", 6).alias("score"))


def seeds_without_near(spark: SparkSession, sf: str) -> DataFrame:
    s = src.seeds(spark, sf)
    return spatial.without_near(s.where("label % 3 <> 0"), s.where("label % 3 = 0"), 8).select("label", "yc", "xc")


def nearest_seed(spark: SparkSession, sf: str) -> DataFrame:
    s = src.seeds(spark, sf)
    return spatial.nearest(s.where("label % 3 <> 0"), s.where("label % 3 = 0"), 25)


def crowded_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.crowded(src.seeds(spark, sf), 25, 2)


def roi_overlap(spark: SparkSession, sf: str) -> DataFrame:
    s = src.read(spark, sf, "supplier")
    k = F.col("s_suppkey")
    boxes = s.select(F.col("s_nationkey").alias("sample"), k.alias("id"), (k * 7 % 48).alias("x"), (k * 11 % 48).alias("y"), F.lit(16).alias("w"), F.lit(16).alias("h"))
    return rois.covered(rois.cropped(boxes, 64)).select("sample", "id", "overlap")


def plane_projection(spark: SparkSession, sf: str) -> DataFrame:
    return frames.project(src.frames(spark, sf), "t", ["z", "y", "x"])


def frame_agreement(spark: SparkSession, sf: str) -> DataFrame:
    f = src.frames(spark, sf)
    mean = f.groupBy("z", "y", "x").agg(F.round(F.avg("v"), 6).alias("w"))
    return frames.agreement(f.select("t", "z", "y", "x", "v"), mean.withColumnRenamed("w", "v"), ["z", "y", "x"], "t")


def plane_sharpness(spark: SparkSession, sf: str) -> DataFrame:
    return frames.sharpness(src.frames(spark, sf).groupBy("z", "y", "x").agg(F.sum("v").alias("v")), "z")


def centred_shifts(spark: SparkSession, sf: str) -> DataFrame:
    return frames.centred(src.shifts(spark, sf))


def shift_steps(spark: SparkSession, sf: str) -> DataFrame:
    return frames.differences(src.shifts(spark, sf))


def sample_names(spark: SparkSession, sf: str) -> DataFrame:
    c = src.read(spark, sf, "customer")
    name = F.regexp_extract("c_name", r"^(\w+)#(\d+)$", 1)
    return c.select("c_custkey", name.alias("kind"), F.expr("try_cast(regexp_extract(c_name, '#0*([0-9]+)$', 1) as bigint)").alias("number"))


_SEEDS2 = f"{src.SEEDS}, scored AS (SELECT *, round(0.25 * compact + 0.20 * blob + 0.20 / (1 + exp(-greatest(-30, least(30, rprom)))) + 0.15 * CASE WHEN n_dirs >= 3 THEN 1.0 WHEN n_dirs = 2 THEN 0.4 WHEN n_dirs = 1 THEN 0.2 ELSE 0.05 END - 0.20 * tube, 9) AS score FROM seeds), " \
    "typed AS (SELECT *, CASE WHEN blob < 0.2 OR NOT (lc_area BETWEEN 6 AND 200 AND lc_ecc < 0.92 AND lc_sol > 0.5) THEN 'process_peak' WHEN score >= 0.4 AND n_dirs >= 3 AND rprom >= 1 THEN 'strong' WHEN score >= 0.26 THEN 'weak' ELSE 'process_peak' END AS type FROM scored)"
_MEDIANS = f"{src.METRICS}, medians AS (SELECT sample, median(m1) AS m1, median(m2) AS m2, median(m3) AS m3, count(roi_id) AS n_roi FROM metrics GROUP BY 1)"
_LONG = f"{_MEDIANS}, {src.GROUPS}, long AS (SELECT geno, metric, value FROM (SELECT geno, m1, m2, m3 FROM medians JOIN grp USING (sample)) UNPIVOT (value FOR metric IN (m1, m2, m3)))"


def _masked(q: float) -> str:
    return f"{src.PIXELS}, mask AS (SELECT image, y, x FROM pixels JOIN (SELECT image, quantile_cont(v, {q}) AS cut FROM pixels GROUP BY 1) USING (image) WHERE v > cut)"


_NEAR = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND (a.y <> b.y OR a.x <> b.x) AND a.image = b.image"
_LABELS = f"WITH RECURSIVE {_masked(0.95)}, reach AS (SELECT image, y, x, y * 1048576 + x AS label FROM mask UNION SELECT b.image, b.y, b.x, a.label FROM reach a JOIN mask b ON {_NEAR}), labelled AS (SELECT image, y, x, min(label) AS label FROM reach GROUP BY 1, 2, 3)"
_D2 = "(a.yc - b.yc) * (a.yc - b.yc) + (a.xc - b.xc) * (a.xc - b.xc)"

#: name: (query, SQL)
ALL = {
    "animal_medians": (animal_medians, f"WITH {_MEDIANS} SELECT sample, round(m1, 6) AS m1, round(m2, 6) AS m2, round(m3, 6) AS m3, n_roi FROM medians"),
    "group_compare": (group_compare, f"""WITH {_LONG}, s AS (SELECT metric, count(*) FILTER (geno = 'WT') AS na, count(*) FILTER (geno = 'HET') AS nb, avg(value) FILTER (geno = 'WT') AS ma, avg(value) FILTER (geno = 'HET') AS mb,
        median(value) FILTER (geno = 'WT') AS da, median(value) FILTER (geno = 'HET') AS db, var_samp(value) FILTER (geno = 'WT') AS va, var_samp(value) FILTER (geno = 'HET') AS vb FROM long GROUP BY 1),
        d AS (SELECT *, (ma - mb) / nullif(sqrt(((na - 1) * va + (nb - 1) * vb) / nullif(na + nb - 2, 0)), 0) AS d FROM s)
        SELECT metric, round(da, 6) AS median_a, round(db, 6) AS median_b, round((1 - 3 / (4 * (na + nb) - 9)::DOUBLE) * d, 6) AS hedges_g, round(d, 6) AS cohens_d FROM d"""),
    "group_deltas": (group_deltas, f"WITH {_LONG}, m AS (SELECT metric, avg(value) FILTER (geno = 'WT') AS w, avg(value) FILTER (geno = 'HET') AS h FROM long GROUP BY 1) SELECT metric, round(100 * (h - w) / nullif(w, 0), 6) AS pct FROM m"),
    "spearman_by_segment": (spearman_by_segment, f"""WITH {_MEDIANS}, {src.GROUPS}, b AS (SELECT c_mktsegment, m2, c_acctbal FROM medians JOIN grp USING (sample)),
        r AS (SELECT c_mktsegment, rank() OVER (PARTITION BY c_mktsegment ORDER BY m2) + (count(*) OVER (PARTITION BY c_mktsegment, m2) - 1) / 2 AS rx, rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal) + (count(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2 AS ry FROM b)
        SELECT c_mktsegment, CASE WHEN count(*) >= 3 THEN round(corr(rx, ry), 6) END AS rho, count(*) AS n FROM r GROUP BY 1"""),
    "fdr_by_nation": (fdr_by_nation, f"""WITH {src.GROUPS}, p AS (SELECT c_nationkey, (count(*) FILTER (c_acctbal < 0) + 1) / (count(*) + 1)::DOUBLE AS p FROM grp GROUP BY 1),
        r AS (SELECT *, p * count(*) OVER (PARTITION BY c_nationkey % 2) / (SELECT count(*) FROM p b WHERE b.p <= a.p AND b.c_nationkey % 2 = a.c_nationkey % 2) AS r FROM p a)
        SELECT c_nationkey, round(p, 6) AS p, round(least(1, (SELECT min(r) FROM r b WHERE b.p >= a.p AND b.c_nationkey % 2 = a.c_nationkey % 2)), 6) AS q FROM r a"""),
    "replicate_screen": (replicate_screen, f"""WITH {src.GROUPS}, i AS (SELECT c_nationkey, c_mktsegment AS metric, round(avg(c_acctbal), 6) AS v FROM grp GROUP BY 1, 2),
        s AS (SELECT metric, avg(v) FILTER (c_nationkey % 2 = 0) AS wt, avg(v) FILTER (c_nationkey % 2 = 1) AS het, min(v) FILTER (c_nationkey % 2 = 1) AS lo, max(v) FILTER (c_nationkey % 2 = 1) AS hi FROM i GROUP BY 1)
        SELECT metric, round(wt, 6) AS wt, round(het, 6) AS het, CASE WHEN wt <> 0 THEN round(100 * (het - wt) / wt, 1) END AS pct, CASE WHEN wt IS NULL OR het IS NULL OR wt = 0 THEN 'n/a' WHEN (lo > wt OR hi < wt) AND hi - lo < abs(het - wt) AND abs(het - wt) > 0 THEN 'CLEAN' WHEN lo > wt OR hi < wt THEN 'same-side' ELSE 'disagree' END AS verdict FROM s"""),
    "variation": (variation, f"WITH {src.PIXELS} SELECT image, round(coalesce(stddev_pop(v) / nullif(avg(v), 0), 0), 6) AS cv FROM pixels GROUP BY 1"),
    "percentile_ladder": (percentile_ladder, f"WITH {src.PIXELS} SELECT image, " + ", ".join(f"round(quantile_cont(v, {q / 100}), 6) AS p{q}" for q in (5, 25, 50, 75, 95)) + " FROM pixels GROUP BY 1"),
    "otsu_threshold": (otsu_threshold, f"""WITH {src.PIXELS}, h AS (SELECT image, v, count(*) AS n FROM pixels GROUP BY 1, 2),
        c AS (SELECT a.image, a.v, sum(b.n) FILTER (b.v <= a.v) AS w0, sum(b.n * b.v) FILTER (b.v <= a.v) AS s0, sum(b.n) AS w, sum(b.n * b.v) AS s FROM h a JOIN h b ON a.image = b.image GROUP BY 1, 2),
        g AS (SELECT image, v, round((w0::DOUBLE * (w - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)), 3) AS g FROM c WHERE w0 < w)
        SELECT image, first(v ORDER BY g DESC, v) AS threshold FROM g GROUP BY 1"""),
    "noise_floor": (noise_floor, f"""WITH {src.PIXELS}, low AS (SELECT image, v FROM pixels JOIN (SELECT image, quantile_cont(v, 0.7) AS cut FROM pixels GROUP BY 1) USING (image) WHERE v < cut)
        SELECT image, round(greatest(1e-6, 1.4826 * median(abs(v - med))), 6) AS sigma FROM low JOIN (SELECT image, median(v) AS med FROM low GROUP BY 1) USING (image) GROUP BY 1"""),
    "stretched": (stretched, f"""WITH {src.PIXELS} SELECT image, y, x, round(greatest(0, least(1, (v - lo) / (hi - lo + 1e-9::DOUBLE))), 6) AS u, (sign(v) * floor(abs(v) / 4::DOUBLE + 0.5))::BIGINT AS q
        FROM pixels JOIN (SELECT image, quantile_cont(v, 0.02) AS lo, quantile_cont(v, 0.98) AS hi FROM pixels GROUP BY 1) USING (image)"""),
    "z_scores": (z_scores, f"WITH {src.PIXELS} SELECT image, y, x, round((v - m) / (s + 1e-9::DOUBLE), 6) AS z FROM pixels JOIN (SELECT image, avg(v) AS m, stddev_pop(v) AS s FROM pixels GROUP BY 1) USING (image)"),
    "value_counts": (value_counts, f"WITH {src.PIXELS} SELECT image, least(v // 10, 10) AS bin, count(*) AS n FROM pixels GROUP BY 1, 2"),
    "composition": (composition, f"WITH {_SEEDS2} SELECT label % 3 AS image, type, count(*) AS n, round(100 * count(*) / (sum(count(*)) OVER (PARTITION BY label % 3))::DOUBLE, 6) AS pct FROM typed GROUP BY 1, 2"),
    "tile_counts": (tile_counts, f"WITH {src.PIXELS} SELECT image, y // 16 AS ty, x // 16 AS tx, count(*) AS n, sum(v)::BIGINT AS total FROM pixels GROUP BY 1, 2, 3"),
    "window_counts": (window_counts, f"WITH {src.PIXELS} SELECT image, wy, wx, count(*) AS n, sum(v)::BIGINT AS total FROM pixels, range(0, 7) a(wy), range(0, 7) b(wx) WHERE y >= wy * 8 AND y < wy * 8 + 16 AND x >= wx * 8 AND x < wx * 8 + 16 GROUP BY 1, 2, 3"),
    "pixel_degree": (pixel_degree, f"WITH {_masked(0.9)} SELECT a.image, a.y, a.x, count(b.y) AS degree FROM mask a LEFT JOIN mask b ON {_NEAR} GROUP BY 1, 2, 3"),
    "skeleton_nodes": (skeleton_nodes, f"WITH {_masked(0.9)}, d AS (SELECT a.image, a.y, a.x, count(b.y) AS degree FROM mask a LEFT JOIN mask b ON {_NEAR} GROUP BY 1, 2, 3) SELECT image, count(*) FILTER (degree = 1) AS endpoints, count(*) FILTER (degree >= 3) AS junction_px, count(*) AS px FROM d GROUP BY 1"),
    "mask_components": (mask_components, f"{_LABELS} SELECT image, y, x, label FROM labelled"),
    "component_features": (component_features, f"{_LABELS} SELECT image, label, count(*) AS area, round(avg(y), 6) AS yc, round(avg(x), 6) AS xc, max(y) - min(y) + 1 AS height, max(x) - min(x) + 1 AS width FROM labelled GROUP BY 1, 2"),
    "large_components": (large_components, f"{_LABELS} SELECT image, y, x, label FROM labelled WHERE (image, label) IN (SELECT (image, label) FROM labelled GROUP BY image, label HAVING count(*) >= 3)"),
    "seed_scores": (seed_scores, f"WITH {_SEEDS2} SELECT label, round(score, 6) AS score, type FROM typed"),
    "threshold_sweep": (threshold_sweep, f"""WITH {_SEEDS2}, k AS (SELECT blob_min, weak, rprom_min, CASE WHEN blob < blob_min OR NOT (lc_area BETWEEN 6 AND 200 AND lc_ecc < 0.92 AND lc_sol > 0.5) THEN 'process_peak' WHEN score >= 0.4 AND n_dirs >= 3 AND rprom >= rprom_min THEN 'strong' WHEN score >= weak THEN 'weak' END AS kind
        FROM scored, (VALUES (0.2::DOUBLE), (0.3::DOUBLE), (0.4::DOUBLE), (0.5::DOUBLE), (0.6::DOUBLE)) a(blob_min), (VALUES (0.2::DOUBLE), (0.26::DOUBLE), (0.3::DOUBLE)) c(weak), (VALUES (0.0::DOUBLE), (1.0::DOUBLE), (2.0::DOUBLE)) b(rprom_min))
        SELECT blob_min, weak, rprom_min, count(*) FILTER (kind = 'strong') AS n_strong, count(*) FILTER (kind = 'weak') AS n_weak FROM k GROUP BY 1, 2, 3"""),
    "top_seeds": (top_seeds, f"WITH {_SEEDS2} SELECT label, round(score, 6) AS score FROM typed ORDER BY typed.score DESC, label LIMIT 10"),
    "seeds_without_near": (seeds_without_near, f"WITH {src.SEEDS} SELECT label, yc, xc FROM seeds a WHERE label % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM seeds b WHERE b.label % 3 = 0 AND {_D2} < 64)"),
    "nearest_seed": (nearest_seed, f"WITH {src.SEEDS}, n AS (SELECT a.label, b.label AS match, {_D2} AS d2, row_number() OVER (PARTITION BY a.label ORDER BY {_D2}, b.label) AS r FROM seeds a JOIN seeds b ON a.label % 3 <> 0 AND b.label % 3 = 0 AND {_D2} <= 625) SELECT label, match, d2 FROM (SELECT label FROM seeds WHERE label % 3 <> 0) LEFT JOIN (SELECT label, match, d2 FROM n WHERE r = 1) USING (label)"),
    "crowded_seeds": (crowded_seeds, f"WITH {src.SEEDS} SELECT a.label, count(*) AS n FROM seeds a JOIN seeds b ON a.label <> b.label AND {_D2} <= 625 GROUP BY 1 HAVING count(*) >= 2"),
    "roi_overlap": (roi_overlap, """WITH c AS (SELECT s_nationkey AS sample, s_suppkey AS id, s_suppkey * 7 % 48 + dx AS x, s_suppkey * 11 % 48 + dy AS y FROM supplier, range(0, 16) a(dx), range(0, 16) b(dy)),
        f AS (SELECT sample, id, id > min(id) OVER (PARTITION BY sample, y, x) AS again FROM c) SELECT sample, id, count(*) FILTER (again) AS overlap FROM f GROUP BY 1, 2"""),
    "plane_projection": (plane_projection, f"WITH {src.FRAMES} SELECT z, y, x, round(avg(v), 6) AS mean, max(v) AS max, median(v) AS median, count(*) AS n FROM frames GROUP BY 1, 2, 3"),
    "frame_agreement": (frame_agreement, f"""WITH {src.FRAMES}, m AS (SELECT z, y, x, round(avg(v), 6) AS w FROM frames GROUP BY 1, 2, 3)
        SELECT t, round(corr(v, w), 6) AS pearson_r, round(sqrt(avg((v - w) * (v - w))) / nullif(max(v) - min(v), 0), 6) AS nrmse FROM frames JOIN m USING (z, y, x) GROUP BY 1"""),
    "plane_sharpness": (plane_sharpness, f"""WITH {src.FRAMES}, i AS (SELECT z, y, x, sum(v) AS v FROM frames GROUP BY 1, 2, 3),
        g AS (SELECT a.z, avg((b.v - a.v) * (b.v - a.v) + (c.v - a.v) * (c.v - a.v)) AS g FROM i a JOIN i b ON a.z = b.z AND b.y = a.y + 1 AND b.x = a.x JOIN i c ON a.z = c.z AND c.x = a.x + 1 AND c.y = a.y GROUP BY 1)
        SELECT z, round(g / nullif(m * m, 0), 6) AS sharpness FROM g JOIN (SELECT z, avg(v) AS m FROM i GROUP BY 1) USING (z)"""),
    "centred_shifts": (centred_shifts, f"WITH {src.SHIFTS} SELECT z, t, round(rs - median(rs) OVER (PARTITION BY t), 6) AS by_time, round(rs - (SELECT median(rs) FROM shifts), 6) AS overall FROM shifts"),
    "shift_steps": (shift_steps, f"WITH {src.SHIFTS}, d AS (SELECT z, t, round(rs - lag(rs) OVER (PARTITION BY z ORDER BY t), 6) AS step FROM shifts) SELECT * FROM d WHERE step IS NOT NULL"),
    "sample_names": (sample_names, r"SELECT c_custkey, regexp_extract(c_name, '^(\w+)#(\d+)$', 1) AS kind, try_cast(regexp_extract(c_name, '#0*([0-9]+)$', 1) AS BIGINT) AS number FROM customer"),
}
ALL |= mask_queries.ALL | table_queries.ALL | frame_queries.ALL | more_queries.ALL | plane_queries.ALL | cell_queries.ALL
QUERIES = {k: f for k, (f, _) in ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in ALL.items() if s}
