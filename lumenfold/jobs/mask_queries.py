"""Registered queries over scenes and their masks, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.operators import grid, spatial
from lumenfold.operators import morphology as mo
from lumenfold.sources import adapters as src

SIDE = src.SIDE


def _px(spark: SparkSession, sf: str) -> DataFrame:
    return src.scenes(spark, sf)


def _mask(spark: SparkSession, sf: str, least: int = 45) -> DataFrame:
    return _px(spark, sf).where(F.col("v") >= least)


def _odd(spark: SparkSession, sf: str) -> DataFrame:
    return _px(spark, sf).where("v % 3 = 0")


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    return grid.components(_mask(spark, sf))


def _seeds(spark: SparkSession, sf: str) -> DataFrame:
    """(image, id, y, x): a point between pixels for each order line of an image with full quantity."""
    line = src.read(spark, sf, "lineitem").where("l_quantity = 50")
    return line.select(F.col("l_suppkey").alias("image"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), (F.col("l_partkey") % 63 / 2).alias("y"), (F.col("l_orderkey") % 63 / 2).alias("x")).distinct()


def mask_union(spark: SparkSession, sf: str) -> DataFrame:
    return mo.union(_mask(spark, sf), _odd(spark, sf))


def mask_intersection(spark: SparkSession, sf: str) -> DataFrame:
    return mo.within(_mask(spark, sf), _odd(spark, sf))


def mask_difference(spark: SparkSession, sf: str) -> DataFrame:
    return mo.without(_mask(spark, sf), _odd(spark, sf))


def mask_dilation(spark: SparkSession, sf: str) -> DataFrame:
    return mo.dilated(_mask(spark, sf), mo.disk(2), SIDE)


def mask_erosion(spark: SparkSession, sf: str) -> DataFrame:
    return mo.eroded(_px(spark, sf), mo.disk(1))


def mask_closing(spark: SparkSession, sf: str) -> DataFrame:
    return mo.closed(_mask(spark, sf), mo.disk(1), SIDE)


def hole_fill(spark: SparkSession, sf: str) -> DataFrame:
    return mo.filled(_px(spark, sf), SIDE)


def junction_clusters(spark: SparkSession, sf: str) -> DataFrame:
    return mo.junction_clusters(_mask(spark, sf), 1, SIDE)


def clusters_by_component(spark: SparkSession, sf: str) -> DataFrame:
    return mo.clusters_by_label(_labels(spark, sf), mo.junction_clusters(_mask(spark, sf), 1, SIDE))


def components_touching(spark: SparkSession, sf: str) -> DataFrame:
    return mo.touching(_labels(spark, sf), _odd(spark, sf))


def blobs_with_core(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _labels(spark, sf)
    return labelled.join(mo.touching(labelled, mo.eroded(_mask(spark, sf), grid.OFFSETS4)), ["image", "label"], "left_semi").select("image", "y", "x", "label")


def component_values(spark: SparkSession, sf: str) -> DataFrame:
    return mo.label_values(_labels(spark, sf), _odd(spark, sf))


def component_size_of_pixels(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _labels(spark, sf)
    return mo.gathered(_px(spark, sf), labelled, labelled.groupBy("image", "label").agg(F.count("*").alias("size")), "size")


def gap_fraction(spark: SparkSession, sf: str) -> DataFrame:
    return mo.gap_fraction(_labels(spark, sf), _px(spark, sf), 0.9)


def web_filter(spark: SparkSession, sf: str) -> DataFrame:
    mask = _mask(spark, sf)
    return mo.web_kept(grid.components(mask), mask, _odd(spark, sf), mo.junction_clusters(mask, 1, SIDE), 6.0, 25)


def focus_filter(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _labels(spark, sf)
    clear = mo.label_values(labelled, _px(spark, sf)).where("mean >= 52").select("image", "label")
    return labelled.join(clear, ["image", "label"], "left_semi").select("image", "y", "x", "label")


def tiered_components(spark: SparkSession, sf: str) -> DataFrame:
    labelled = _labels(spark, sf)
    held = mo.touching(labelled, _odd(spark, sf)).withColumn("anchored", F.lit(True))
    sized = labelled.groupBy("image", "label").agg(F.count("*").alias("n")).join(held, ["image", "label"], "left")
    keep = sized.where(((F.col("n") >= 2) & F.col("anchored")) | (F.col("n") >= 5)).select("image", "label")
    return labelled.join(keep, ["image", "label"], "left_semi").select("image", "y", "x", "label")


def component_moments(spark: SparkSession, sf: str) -> DataFrame:
    return mo.moments(_labels(spark, sf))


def mask_distances(spark: SparkSession, sf: str) -> DataFrame:
    return mo.distances(_px(spark, sf), SIDE, 3)


def seed_components(spark: SparkSession, sf: str) -> DataFrame:
    return mo.mode_label(_seeds(spark, sf), _labels(spark, sf))


def endpoint_components(spark: SparkSession, sf: str) -> DataFrame:
    mask = _mask(spark, sf)
    ends = grid.degree(mask).where("degree = 1").select("image", "y", "x")
    return ends.join(grid.components(mask), ["image", "y", "x"])


def collar_labels(spark: SparkSession, sf: str) -> DataFrame:
    return mo.nearest_label(_px(spark, sf), _labels(spark, sf), 3)


def component_junctions(spark: SparkSession, sf: str) -> DataFrame:
    mask = _mask(spark, sf)
    plain = grid.components(grid.degree(mask).where("degree < 3").select("image", "y", "x"))
    return mo.adjacent(plain, mo.junction_clusters(mask, 1, SIDE))


def tree_identity(spark: SparkSession, sf: str) -> DataFrame:
    mask = _mask(spark, sf)
    d = grid.degree(mask).groupBy("image").agg(F.count_if(F.col("degree") == 1).alias("tips"))
    joints = mo.junction_clusters(mask, 1, SIDE).groupBy("image").agg(F.countDistinct("cluster").alias("joints"))
    parts = grid.components(mask).groupBy("image").agg(F.countDistinct("label").alias("parts"))
    both = d.join(parts, "image").join(joints, "image", "left").fillna(0, ["joints"])
    return both.select("image", "tips", "joints", "parts", F.abs(F.col("tips") - F.col("joints") - 2 * F.col("parts")).alias("off"))


def brightest_of_components(spark: SparkSession, sf: str) -> DataFrame:
    valued = _labels(spark, sf).join(_px(spark, sf), ["image", "y", "x"])
    top = valued.groupBy("image", "label").agg(F.min(F.struct((-F.col("v")).alias("v"), "y", "x")).alias("m"))
    return top.select("image", "label", F.col("m.y").alias("y"), F.col("m.x").alias("x"), (-F.col("m.v")).alias("v"))


def line_shift(spark: SparkSession, sf: str) -> DataFrame:
    return _px(spark, sf).select("image", "y", F.when(F.col("y") % 2 == 0, F.pmod(F.col("x") + 3, F.lit(SIDE).cast("long"))).otherwise(F.col("x")).alias("x"), "v")


def strided_pixels(spark: SparkSession, sf: str) -> DataFrame:
    return _px(spark, sf).where("y % 8 = 0 and x % 8 = 0").groupBy("image").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def central_crop(spark: SparkSession, sf: str) -> DataFrame:
    n = max(4, round(SIDE * 0.45))
    n -= n % 2
    lo = (SIDE - n) // 2
    return _px(spark, sf).where(F.col("y").between(lo, lo + n - 1) & F.col("x").between(lo, lo + n - 1))


def local_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Of each seed the mask's pixels, and their sectors in a ring, around it."""
    return spatial.around_points(_seeds(spark, sf), _mask(spark, sf), 6, 3, 12)


def radius_prominence(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.prominence(_seeds(spark, sf), _mask(spark, sf), 6)


def nearest_mask_pixel(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.nearest_pixel(_seeds(spark, sf), _mask(spark, sf), 4)


def seeds_outside_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return spatial.outside_boxes(_seeds(spark, sf), _mask(spark, sf, 120), 4)


def round_components(spark: SparkSession, sf: str) -> DataFrame:
    """Small components most of which lie near a core, and that are bright against the noise."""
    mask = _mask(spark, sf)
    near = mo.dilated(mo.eroded(mask, grid.OFFSETS4), mo.disk(3), SIDE).withColumn("near", F.lit(1))
    valued = grid.components(mask).join(mask.select("image", "y", "x", "v"), ["image", "y", "x"]).join(near, ["image", "y", "x"], "left").fillna(0, ["near"])
    s = valued.groupBy("image", "label").agg(F.count("*").alias("n"), F.avg("near").alias("share"), F.max("v").alias("peak"))
    return s.where("n < 20 and share > 0.6 and peak >= 70").select("image", "label", "n", "peak")


_NEAR8 = "abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.image = b.image"
_S = f"WITH RECURSIVE {src.SCENES}, mask AS (SELECT * FROM scene WHERE v >= 45), odd AS (SELECT * FROM scene WHERE v % 3 = 0)"
_SEEDS = "seed AS (SELECT DISTINCT l_suppkey AS image, l_orderkey * 10 + l_linenumber AS id, (l_partkey % 63) / 2.0::DOUBLE AS y, (l_orderkey % 63) / 2.0::DOUBLE AS x FROM lineitem WHERE l_quantity = 50)"


def _dilate(name: str, mask: str, r: float) -> str:
    k = int(r)
    return f"{name} AS (SELECT DISTINCT image, y + dy AS y, x + dx AS x FROM {mask}, range({-k}, {k + 1}) p(dy), range({-k}, {k + 1}) q(dx) WHERE dy * dy + dx * dx <= {r * r} AND y + dy BETWEEN 0 AND {SIDE - 1} AND x + dx BETWEEN 0 AND {SIDE - 1})"


def _erode(name: str, mask: str, centre: bool = True) -> str:
    return f"{name} AS (SELECT a.image, a.y, a.x FROM {mask} a JOIN {mask} b ON a.image = b.image AND abs(a.y - b.y) + abs(a.x - b.x) <= 1 GROUP BY 1, 2, 3 HAVING count(*) = 5)"


def _label(name: str, mask: str, label: str = "label") -> str:
    return f"{name}_r AS (SELECT image, y, x, y * 1048576 + x AS {label} FROM {mask} UNION SELECT b.image, b.y, b.x, a.{label} FROM {name}_r a JOIN {mask} b ON {_NEAR8}), {name} AS (SELECT image, y, x, min({label}) AS {label} FROM {name}_r GROUP BY 1, 2, 3)"


_DEG = f"deg AS (SELECT a.image, a.y, a.x, count(*) - 1 AS degree FROM mask a JOIN mask b ON {_NEAR8} GROUP BY 1, 2, 3)"
_JC = f"{_DEG}, joint AS (SELECT image, y, x FROM deg WHERE degree >= 3), {_dilate('wide', 'joint', 1)}, {_label('wl', 'wide', 'cluster')}, jc AS (SELECT image, y, x, cluster FROM joint JOIN wl USING (image, y, x))"
_L = _label("lab", "mask")
_VAL = "val AS (SELECT image, label, count(*) AS n, round(coalesce(avg(v), -1), 6) AS mean, coalesce(median(v), -1) AS median FROM lab LEFT JOIN {} USING (image, y, x) GROUP BY 1, 2)"
_TOUCH = "touch AS (SELECT DISTINCT image, label FROM lab JOIN {} USING (image, y, x))"
_PLANE = f"plane AS (SELECT image, y, x FROM (SELECT DISTINCT image FROM scene), range(0, {SIDE}) p(y), range(0, {SIDE}) q(x)), bg AS (SELECT * FROM plane ANTI JOIN scene USING (image, y, x))"
_LOCAL = "hood AS (SELECT s.image, s.id, s.y AS cy, s.x AS cx, m.y, m.x, m.v, (m.y - s.y) * (m.y - s.y) + (m.x - s.x) * (m.x - s.x) AS d2 FROM seed s JOIN mask m ON m.image = s.image)"

ALL = {
    "mask_union": (mask_union, f"{_S} SELECT image, y, x FROM mask UNION SELECT image, y, x FROM odd"),
    "mask_intersection": (mask_intersection, f"{_S} SELECT image, y, x FROM mask INTERSECT SELECT image, y, x FROM odd"),
    "mask_difference": (mask_difference, f"{_S} SELECT image, y, x FROM mask EXCEPT SELECT image, y, x FROM odd"),
    "mask_dilation": (mask_dilation, f"{_S}, {_dilate('d', 'mask', 2)} SELECT * FROM d"),
    "mask_erosion": (mask_erosion, f"{_S}, {_erode('e', 'scene')} SELECT * FROM e"),
    "mask_closing": (mask_closing, f"{_S}, {_dilate('d', 'mask', 1)}, {_erode('e', 'd')} SELECT * FROM e"),
    "hole_fill": (hole_fill, f"{_S}, {_PLANE}, sea AS (SELECT * FROM bg WHERE y IN (0, {SIDE - 1}) OR x IN (0, {SIDE - 1}) UNION SELECT b.image, b.y, b.x FROM sea a JOIN bg b ON a.image = b.image AND abs(a.y - b.y) + abs(a.x - b.x) = 1) SELECT image, y, x FROM plane ANTI JOIN sea USING (image, y, x)"),
    "junction_clusters": (junction_clusters, f"{_S}, {_JC} SELECT * FROM jc"),
    "clusters_by_component": (clusters_by_component, f"{_S}, {_L}, {_JC} SELECT image, label, count(DISTINCT cluster) AS n_clusters FROM lab LEFT JOIN jc USING (image, y, x) GROUP BY 1, 2"),
    "components_touching": (components_touching, f"{_S}, {_L}, {_TOUCH.format('odd')} SELECT * FROM touch"),
    "blobs_with_core": (blobs_with_core, f"{_S}, {_L}, {_erode('core', 'mask')}, {_TOUCH.format('core')} SELECT image, y, x, label FROM lab SEMI JOIN touch USING (image, label)"),
    "component_values": (component_values, f"{_S}, {_L}, {_VAL.format('odd')} SELECT * FROM val"),
    "component_size_of_pixels": (component_size_of_pixels, f"{_S}, {_L} SELECT image, y, x, coalesce(label, 0) AS label, coalesce(size, 0) AS size FROM scene LEFT JOIN (SELECT *, count(*) OVER (PARTITION BY image, label) AS size FROM lab) USING (image, y, x)"),
    "gap_fraction": (gap_fraction, f"{_S}, {_L}, w AS (SELECT image, v, median(v) OVER (PARTITION BY image, label) AS med FROM lab JOIN scene USING (image, y, x)) SELECT image, round(avg((v < 0.9::DOUBLE * med)::INT), 6) AS gap FROM w GROUP BY 1"),
    "web_filter": (web_filter, f"{_S}, {_L}, {_JC}, {_VAL.format('mask')}, {_TOUCH.format('odd')}, web AS (SELECT image, label FROM val SEMI JOIN (SELECT image, label FROM lab JOIN jc USING (image, y, x)) USING (image, label) ANTI JOIN touch USING (image, label) WHERE n < 25 AND median < 60) SELECT image, y, x, label FROM lab ANTI JOIN web USING (image, label)"),
    "focus_filter": (focus_filter, f"{_S}, {_L}, {_VAL.format('scene')} SELECT image, y, x, label FROM lab SEMI JOIN (SELECT * FROM val WHERE mean >= 52) USING (image, label)"),
    "tiered_components": (tiered_components, f"{_S}, {_L}, {_TOUCH.format('odd')}, z AS (SELECT image, label, count(*) AS n FROM lab GROUP BY 1, 2) SELECT image, y, x, label FROM lab SEMI JOIN (SELECT * FROM z WHERE n >= 5 UNION SELECT z.* FROM z SEMI JOIN touch USING (image, label) WHERE n >= 2) USING (image, label)"),
    "component_moments": (component_moments, f"""{_S}, {_L}, s AS (SELECT image, label, count(*) AS area, var_pop(y) + 1 / 12.0::DOUBLE AS a, var_pop(x) + 1 / 12.0::DOUBLE AS b, covar_pop(y, x) AS c FROM lab GROUP BY 1, 2), r AS (SELECT *, sqrt((a - b) * (a - b) / 4 + c * c) AS k FROM s)
        SELECT image, label, area, round(sqrt(greatest(0, 1 - ((a + b) / 2 - k) / ((a + b) / 2 + k))), 6) AS ecc FROM r"""),
    "mask_distances": (mask_distances, f"{_S}, {_PLANE} SELECT a.image, a.y, a.x, (min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)))::INTEGER AS d2 FROM scene a LEFT JOIN bg b ON a.image = b.image AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 9 GROUP BY 1, 2, 3"),
    "seed_components": (seed_components, f"""{_S}, {_L}, {_SEEDS}, votes AS (SELECT s.image, s.id, label, count(*) AS n FROM seed s JOIN lab b ON s.image = b.image AND abs(b.y - round_even(s.y, 0)) <= 2 AND abs(b.x - round_even(s.x, 0)) <= 2 GROUP BY 1, 2, 3)
        SELECT image, id, coalesce(label, 0) AS label FROM (SELECT image, id FROM seed) LEFT JOIN (SELECT image, id, first(label ORDER BY n DESC, label) AS label FROM votes GROUP BY 1, 2) USING (image, id)"""),
    "endpoint_components": (endpoint_components, f"{_S}, {_L}, {_DEG} SELECT image, y, x, label FROM deg JOIN lab USING (image, y, x) WHERE degree = 1"),
    "collar_labels": (collar_labels, f"""{_S}, {_L}, n AS (SELECT a.image, a.y, a.x, label, (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) AS d2 FROM scene a JOIN lab b ON a.image = b.image WHERE (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 9)
        SELECT image, y, x, first(label ORDER BY d2, label) AS label, min(d2)::INTEGER AS d2 FROM n GROUP BY 1, 2, 3"""),
    "component_junctions": (component_junctions, f"{_S}, {_JC}, plain AS (SELECT image, y, x FROM deg WHERE degree < 3), {_label('pl', 'plain')} SELECT DISTINCT a.image, label, cluster FROM pl a JOIN jc b ON a.image = b.image AND abs(a.y - b.y) + abs(a.x - b.x) <= 1"),
    "tree_identity": (tree_identity, f"""{_S}, {_L}, {_JC}, t AS (SELECT image, count(*) FILTER (degree = 1) AS tips FROM deg GROUP BY 1), c AS (SELECT image, count(DISTINCT label) AS parts FROM lab GROUP BY 1), j AS (SELECT image, count(DISTINCT cluster) AS joints FROM jc GROUP BY 1)
        SELECT image, tips, coalesce(joints, 0) AS joints, parts, abs(tips - coalesce(joints, 0) - 2 * parts) AS off FROM t JOIN c USING (image) LEFT JOIN j USING (image)"""),
    "brightest_of_components": (brightest_of_components, f"{_S}, {_L} SELECT image, label, first(y ORDER BY v DESC, y, x) AS y, first(x ORDER BY v DESC, y, x) AS x, max(v) AS v FROM lab JOIN scene USING (image, y, x) GROUP BY 1, 2"),
    "line_shift": (line_shift, f"{_S} SELECT image, y, CASE WHEN y % 2 = 0 THEN (x + 3) % {SIDE} ELSE x END AS x, v FROM scene"),
    "strided_pixels": (strided_pixels, f"{_S} SELECT image, count(*) AS n, sum(v)::BIGINT AS total FROM scene WHERE y % 8 = 0 AND x % 8 = 0 GROUP BY 1"),
    "central_crop": (central_crop, f"{_S} SELECT * FROM scene WHERE y BETWEEN 9 AND 22 AND x BETWEEN 9 AND 22"),
    "local_counts": (local_counts, f"""{_S}, {_SEEDS}, {_LOCAL} SELECT image, id, coalesce(n, 0) AS n, coalesce(total, 0) AS total, coalesce(dirs, 0) AS dirs FROM (SELECT image, id FROM seed) LEFT JOIN
        (SELECT image, id, count(*) AS n, sum(v)::BIGINT AS total, count(DISTINCT CASE WHEN d2 >= 9 THEN floor((atan2(y - cy, x - cx) + pi()) / (2 * pi()) * 12) % 12 END) AS dirs FROM hood WHERE d2 <= 36 GROUP BY 1, 2) USING (image, id)"""),
    "radius_prominence": (radius_prominence, f"""{_S}, {_SEEDS}, {_LOCAL}, b AS (SELECT *, median(v) OVER (PARTITION BY image, id) AS med, first_value(v) OVER (PARTITION BY image, id ORDER BY d2, y, x) AS here FROM hood WHERE abs(y - cy) <= 6 AND abs(x - cx) <= 6)
        SELECT image, id, round((any_value(here) - any_value(med)) / (median(abs(v - med)) + 1e-3::DOUBLE), 6) AS prominence FROM b GROUP BY 1, 2"""),
    "nearest_mask_pixel": (nearest_mask_pixel, f"""{_S}, {_SEEDS}, {_LOCAL}, c AS (SELECT image, id, y, x, greatest(abs(y - floor(cy)), abs(x - floor(cx))) AS ring, d2 FROM hood WHERE greatest(abs(y - floor(cy)), abs(x - floor(cx))) <= 4)
        SELECT image, id, first(y ORDER BY ring, d2, y, x) AS y, first(x ORDER BY ring, d2, y, x) AS x FROM c GROUP BY 1, 2"""),
    "seeds_outside_boxes": (seeds_outside_boxes, f"{_S}, {_SEEDS} SELECT image, id FROM seed s WHERE NOT EXISTS (SELECT 1 FROM scene m WHERE m.v >= 120 AND m.image = s.image AND abs(m.y - floor(s.y)) <= 4 AND abs(m.x - floor(s.x)) <= 4)"),
    "round_components": (round_components, f"{_S}, {_L}, {_erode('core', 'mask')}, {_dilate('near', 'core', 3)}, q AS (SELECT image, label, count(*) AS n, avg((near.y IS NOT NULL)::INT) AS share, max(v) AS peak FROM lab JOIN mask USING (image, y, x) LEFT JOIN near USING (image, y, x) GROUP BY 1, 2) SELECT image, label, n, peak FROM q WHERE n < 20 AND share > 0.6 AND peak >= 70"),
}
QUERIES = {k: f for k, (f, _) in ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in ALL.items() if s}
