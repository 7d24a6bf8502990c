"""Registered queries over filtered planes and skeletons, with SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.jobs import frame_queries as fq
from lumenfold.jobs import mask_queries as mq
from lumenfold.operators import geodesics, grid, halo, roi_block, rois, spatial, stats
from lumenfold.operators import morphology as mo
from lumenfold.operators import registration as reg
from lumenfold.operators import skeletons as sk
from lumenfold.sources import adapters as src

SIDE, TILE = src.SIDE, 16
SHAPE = (SIDE, SIDE)


def _lines(spark: SparkSession, sf: str) -> DataFrame:
    """The skeletons of the scenes."""
    return halo.skeleton(mq._px(spark, sf), SHAPE, TILE)


def ridges(spark: SparkSession, sf: str) -> DataFrame:
    """How much of a bright line each pixel is on, at a scale of 1.2 pixels."""
    return halo.ridges(mq._px(spark, sf), 1.2, SHAPE, TILE)


def seed_curvature(spark: SparkSession, sf: str) -> DataFrame:
    """Of each seed whether it is on a blob or a tube: both 0 where the plane doesn't curve down there."""
    seeds = mq._seeds(spark, sf).select("image", "id", F.floor("y").alias("y"), F.floor("x").alias("x"))
    curved = halo.blobs_and_tubes(mq._px(spark, sf), 2.0, SHAPE, TILE)
    return seeds.join(curved, ["image", "y", "x"], "left").select("image", "id", F.coalesce("blob", F.lit(0.0)).alias("blob"), F.coalesce("tube", F.lit(0.0)).alias("tube"))


def top_hat(spark: SparkSession, sf: str) -> DataFrame:
    """What is above the opening over squares of 5 x 5."""
    return halo.top_hat(mq._px(spark, sf), 2, SHAPE, TILE).select("image", "y", "x", F.col("v").cast("long").alias("v"))


def top_hat_mask(spark: SparkSession, sf: str) -> DataFrame:
    """What is over 0.7 of Otsu's threshold of the top hat, closed over a disk of 2."""
    above = top_hat(spark, sf)
    cut = stats.otsu(above.groupBy("image", "v").agg(F.count("*").alias("n")), "image")
    mask = above.join(cut, "image").where(F.col("v") > 0.7 * F.col("threshold")).select("image", "y", "x")
    return mo.closed(mask, mo.disk(2), SIDE)


def without_background(spark: SparkSession, sf: str) -> DataFrame:
    """Scenes without a rolling-ball background, on every second pixel."""
    return halo.without_background(mq._px(spark, sf), 3, 2, SHAPE, TILE)


def skeleton(spark: SparkSession, sf: str) -> DataFrame:
    return _lines(spark, sf)


def skeleton_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of the bright pixels as they are."""
    return sk.measured(*sk.parts(mq._mask(spark, sf)))


def line_segments(spark: SparkSession, sf: str) -> DataFrame:
    """Segments of the skeletons."""
    return sk.measured(*sk.parts(_lines(spark, sf)))


def merged_junctions(spark: SparkSession, sf: str) -> DataFrame:
    return sk.merged_junctions(*sk.parts(mq._mask(spark, sf)), 3)


def pruned_spurs(spark: SparkSession, sf: str) -> DataFrame:
    """One round: spurs of at most two pixels go."""
    return sk.pruned(mq._mask(spark, sf), 2, 1)


def clean_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Skeletons with loops around holes of at most 20 pixels cut where they are dimmest, until none is left that can be, and spurs shorter than 1.5 times the radius
    at their junction, or than 3, removed, all at once."""
    lines = sk.opened_planes(mq._px(spark, sf), 20, SIDE).checkpoint()
    return sk.pruned_by_width(lines, lines, 1.5, 3.0)


def opened_loops(spark: SparkSession, sf: str) -> DataFrame:
    """One round on the bright pixels: loops around holes of at most 20 pixels are cut."""
    px = mq._px(spark, sf)
    return sk.opened_loops(px.where("v >= 30"), px, 20, SHAPE, TILE, rounds=1)


def suppressed_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Bright pixels, the brightest first, none within four pixels of one before it."""
    points = mq._mask(spark, sf).select("image", (F.col("y") * SIDE + F.col("x")).alias("id"), "y", "x", F.col("v").alias("score"))
    return spatial.suppressed(points, 4.0).select("image", "id", "score")


def _sources(spark: SparkSession, sf: str) -> DataFrame:
    """The brightest pixels, in the order of their brightness."""
    at = (F.col("y") * SIDE + F.col("x")).alias("id")
    return mq._mask(spark, sf, 80).select("image", at, "y", "x", (-F.col("v") * SIDE * SIDE + at).alias("place"))


def attributed_pixels(spark: SparkSession, sf: str) -> DataFrame:
    """Bright pixels with the source that reaches them first."""
    return geodesics.attributed(mq._mask(spark, sf), _sources(spark, sf))


def source_hops(spark: SparkSession, sf: str) -> DataFrame:
    """How many steps each bright pixel is from the nearest source."""
    return attributed_pixels(spark, sf).select("image", "y", "x", F.col("hops").cast("long").alias("hops"))


def tip_hops(spark: SparkSession, sf: str) -> DataFrame:
    """How many steps each tip of the bright pixels is from the first source on its way."""
    tips = grid.degree(mq._mask(spark, sf)).where("degree = 1").select("image", (F.col("y") * SIDE + F.col("x")).alias("id"), "y", "x")
    goals = _sources(spark, sf).select("image", "y", "x", F.col("id").alias("label"))
    return geodesics.first_reached(mq._mask(spark, sf), tips, goals).select("image", "id", F.col("hops").cast("long").alias("hops"))


def exact_distances(spark: SparkSession, sf: str) -> DataFrame:
    """Of each pixel with a value the squared distance to the nearest one without, however far."""
    return mo.exact_distances(mq._px(spark, sf), SIDE, SIDE)


def translated_frames(spark: SparkSession, sf: str) -> DataFrame:
    """Frames moved by quarters of a pixel that depend on their time."""
    f = src.frames(spark, sf)
    quarter = lambda n: (F.col("t") % n - n // 2) / 4
    shifts = f.select("z", "t").distinct().select("z", "t", quarter(11).alias("dy"), quarter(7).alias("dx"))
    return reg.translated(f, shifts, ["z", "t"], 8, 8)


def volume_shifts(spark: SparkSession, sf: str) -> DataFrame:
    """Volumes, the frames of one number in each plane, against the mean of all, to half a voxel."""
    f = fq._chunks(spark, sf).select("z", "i", "y", "x", "v")
    full = f.groupBy("i").agg(F.countDistinct("z").alias("n"))
    planes = src.frames(spark, sf).agg(F.countDistinct("z").alias("n"))
    f = f.join(full.join(F.broadcast(planes), "n"), "i")  # one row
    cells = lambda name: F.transform(F.array_sort(F.collect_list(F.struct("z", "y", "x", F.col("v").cast("double").alias("v")))), lambda c: c["v"]).alias(name)
    moving = f.groupBy(F.col("i").alias("t")).agg(cells("moving"))
    fixed = f.groupBy("z", "y", "x").agg(F.avg("v").alias("v")).agg(cells("fixed"))
    n = planes.first()["n"]
    return reg.registered_volumes(moving.join(F.broadcast(fixed)), (n, 8, 8))  # one volume


def _layers(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Layers of the scenes: bright pixels in place of a skeleton and cell bodies, distances to the background up to 3, a noise level."""
    whole = mq._px(spark, sf).checkpoint()
    px = whole.withColumnRenamed("image", "sample")
    radius = mo.distances(whole, SIDE, 3).select(F.col("image").alias("sample"), "y", "x", F.sqrt(F.coalesce("d2", F.lit(16))).alias("r"))
    sigma = px.groupBy("sample").agg(F.lit(2.0).alias("sigma"))
    return {"mask": px.where("v >= 20"), "soma": px.where("v >= 80"), "px": px, "radius": radius, "sigma": sigma}


UNIT, MERGE, ROUND_Z = 0.7, 3.0, 45.0


def roi_block_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """The seventeen measurements of each region of the scenes, bright pixels being the skeleton."""
    boxes = roi_block.keyed(rois.cropped(src.scene_boxes(spark, sf), SIDE))
    sk_ = mq._mask(spark, sf).withColumnRenamed("image", "sample")
    return roi_block.block(boxes, sk_, **_layers(spark, sf), unit=UNIT, merge=MERGE, round_z=ROUND_Z)


def roi_block_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """The same on tissue, cells of 4 pixels with at least two bright ones, and outside of earlier regions, with the share of tissue."""
    boxes = roi_block.keyed(rois.cropped(src.scene_boxes(spark, sf), SIDE))
    sk_ = mq._mask(spark, sf).withColumnRenamed("image", "sample")
    tissue = sk_.groupBy("sample", F.floor(F.col("y") / 4).alias("ty"), F.floor(F.col("x") / 4).alias("tx")).agg(F.count("*").alias("n")).where("n >= 2")
    kept, share = roi_block.kept_cells(boxes, tissue, 4)
    found = roi_block.block(boxes, sk_, **_layers(spark, sf), unit=UNIT, merge=MERGE, round_z=ROUND_Z, kept=kept.checkpoint())
    return found.join(boxes.join(share, "image").select("sample", "id", "tissue_frac"), ["sample", "id"])


def roi_block_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The seventeen measurements on skeletons of the scenes."""
    boxes = roi_block.keyed(rois.cropped(src.scene_boxes(spark, sf), SIDE))
    return roi_block.block(boxes, _lines(spark, sf).withColumnRenamed("image", "sample"), **_layers(spark, sf), unit=UNIT, merge=MERGE, round_z=ROUND_Z)


_STEP = "CASE WHEN a.y <> b.y AND a.x <> b.x THEN sqrt(2.0::DOUBLE) ELSE 1.0::DOUBLE END"
_N8 = mq._NEAR8
_SEG = f"{mq._DEG}, joint AS (SELECT image, y, x FROM deg WHERE degree >= 3), plain AS (SELECT image, y, x, degree FROM deg WHERE degree < 3), {mq._label('jl', 'joint', 'junction')}, {mq._label('sl0', 'plain', 'segment')}, sl AS (SELECT image, y, x, segment, degree FROM sl0 JOIN plain USING (image, y, x))"
_MEAS = f"""{_SEG}, nb AS (SELECT a.image, a.segment, a.y, a.x, a.degree, count(b.y) AS n, coalesce(sum(CASE WHEN b.y IS NOT NULL THEN {_STEP} END), 0) AS s FROM sl a LEFT JOIN sl b ON {_N8} AND a.segment = b.segment AND (a.y <> b.y OR a.x <> b.x) GROUP BY 1, 2, 3, 4, 5),
    own AS (SELECT image, segment, count(*) AS px, sum(s) / 2 AS inn, count(*) FILTER (degree <= 1) AS tips, avg(y) FILTER (n <= 1) AS ey, avg(x) FILTER (n <= 1) AS ex, avg(y) AS ay, avg(x) AS ax FROM nb GROUP BY 1, 2),
    att AS (SELECT a.image, a.segment, b.junction, a.y, a.x, min({_STEP}) AS s FROM sl a JOIN jl b ON {_N8} GROUP BY 1, 2, 3, 4, 5), jo AS (SELECT image, segment, sum(s) AS out, count(DISTINCT junction) AS joints FROM att GROUP BY 1, 2),
    meas AS (SELECT image, segment, px, round(inn + coalesce(out, 0), 6) AS length, tips, coalesce(joints, 0) AS joints, CASE WHEN tips = 0 THEN CASE WHEN joints IS NULL THEN 3 ELSE 2 END ELSE CASE WHEN joints IS NULL THEN 0 ELSE 1 END END AS kind, round(coalesce(ey, ay), 6) AS my, round(coalesce(ex, ax), 6) AS mx FROM own LEFT JOIN jo USING (image, segment))"""
_MERGED = f"""{_SEG}, centre AS (SELECT image, junction, avg(y) AS cy, avg(x) AS cx FROM jl GROUP BY 1, 2), short AS (SELECT image, segment FROM sl GROUP BY 1, 2 HAVING count(*) < 3),
    ends AS (SELECT DISTINCT a.image, a.segment, b.junction FROM sl a SEMI JOIN short USING (image, segment) JOIN jl b ON a.image = b.image AND abs(a.y - b.y) + abs(a.x - b.x) = 1),
    link AS (SELECT DISTINCT e.image, e.junction AS id, f.junction AS other FROM ends e JOIN ends f USING (image, segment)), reach AS (SELECT image, junction AS id, junction AS label FROM centre UNION SELECT l.image, l.other, r.label FROM reach r JOIN link l ON r.image = l.image AND r.id = l.id),
    root AS (SELECT image, id AS junction, min(label) AS label FROM reach GROUP BY 1, 2) SELECT image, label AS junction, round(avg(cy), 6) AS y, round(avg(cx), 6) AS x, count(*) AS merged FROM centre JOIN root USING (image, junction) GROUP BY 1, 2"""
_ROWS = "ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING"
_DENSE = f"dense AS (SELECT image, y, x, coalesce(v, 0) AS v FROM (SELECT image, y, x FROM (SELECT DISTINCT image FROM scene), range(0, {SIDE}) p(y), range(0, {SIDE}) q(x)) LEFT JOIN scene USING (image, y, x))"
_HAT = f"""{_DENSE}, e1 AS (SELECT *, min(v) OVER (PARTITION BY image, x ORDER BY y {_ROWS}) AS a FROM dense), e2 AS (SELECT image, y, x, v, min(a) OVER (PARTITION BY image, y ORDER BY x {_ROWS}) AS a FROM e1),
    d1 AS (SELECT image, y, x, v, max(a) OVER (PARTITION BY image, x ORDER BY y {_ROWS}) AS a FROM e2), d2 AS (SELECT image, y, x, v, max(a) OVER (PARTITION BY image, y ORDER BY x {_ROWS}) AS a FROM d1), hat AS (SELECT image, y, x, v - a AS v FROM d2 WHERE v > a)"""
_OTSU = """h AS (SELECT image, v, count(*) AS n FROM hat GROUP BY 1, 2), c AS (SELECT a.image, a.v, sum(b.n) FILTER (b.v <= a.v) AS w0, sum(b.n * b.v) FILTER (b.v <= a.v) AS s0, sum(b.n) AS w, sum(b.n * b.v) AS s FROM h a JOIN h b ON a.image = b.image GROUP BY 1, 2),
    g AS (SELECT image, v, round((w0::DOUBLE * (w - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)), 3) AS g FROM c WHERE w0 < w), o AS (SELECT image, first(v ORDER BY g DESC, v) AS threshold FROM g GROUP BY 1)"""
_DISK2 = "dy * dy + dx * dx <= 4"
_CLOSE = f"""over AS (SELECT image, y, x FROM hat JOIN o USING (image) WHERE v > 0.7::DOUBLE * threshold), {mq._dilate('wide', 'over', 2)}, shut AS (SELECT w.image, w.y + dy AS y, w.x + dx AS x FROM wide w, range(-2, 3) p(dy), range(-2, 3) q(dx) WHERE {_DISK2} GROUP BY 1, 2, 3 HAVING count(*) = 13)"""
_HOLES = f"""thick AS (SELECT image, y, x, v FROM scene WHERE v >= 30), bg AS (SELECT image, y, x FROM (SELECT image, y, x FROM (SELECT DISTINCT image FROM thick), range(0, {SIDE}) p(y), range(0, {SIDE}) q(x)) ANTI JOIN thick USING (image, y, x)),
    sea AS (SELECT * FROM bg WHERE y IN (0, {SIDE - 1}) OR x IN (0, {SIDE - 1}) UNION SELECT b.image, b.y, b.x FROM sea a JOIN bg b ON a.image = b.image AND abs(a.y - b.y) + abs(a.x - b.x) = 1), dry AS (SELECT * FROM bg ANTI JOIN sea USING (image, y, x)),
    hr AS (SELECT image, y, x, y * 1048576 + x AS hole FROM dry UNION SELECT b.image, b.y, b.x, a.hole FROM hr a JOIN dry b ON a.image = b.image AND abs(a.y - b.y) + abs(a.x - b.x) = 1), hl AS (SELECT image, y, x, min(hole) AS hole FROM hr GROUP BY 1, 2, 3),
    small AS (SELECT * FROM hl SEMI JOIN (SELECT image, hole FROM hl GROUP BY 1, 2 HAVING count(*) <= 20) USING (image, hole)), ring AS (SELECT DISTINCT t.image, t.y, t.x, t.v, h.hole FROM thick t JOIN small h ON t.image = h.image AND abs(t.y - h.y) + abs(t.x - h.x) = 1),
    cut AS (SELECT image, first(y ORDER BY v, y, x) AS y, first(x ORDER BY v, y, x) AS x FROM ring GROUP BY image, hole HAVING count(*) >= 3)"""

_HOPS = f"hop AS (SELECT image, y, x, 0 AS hops FROM mask WHERE v >= 80 UNION SELECT b.image, b.y, b.x, a.hops + 1 FROM hop a JOIN mask b ON {_N8} AND (a.y <> b.y OR a.x <> b.x) WHERE a.hops < 100 AND NOT (b.v >= 80))"


def _block(corrected: bool) -> str:
    """The block as SQL; corrected: on kept cells only."""
    inside = lambda name, layer, more="": f"{name} AS (SELECT b.image, r.y, r.x{more} FROM box b JOIN {layer} r ON r.image = b.sample AND r.y >= y0 AND r.y < y1 AND r.x >= x0 AND r.x < x1{' SEMI JOIN kept k ON k.image = b.image AND k.y = r.y AND k.x = r.x' if corrected else ''})"
    degree = "vs AS (SELECT a.image, a.y, a.x, count(*) - 1 AS degree FROM vs0 a JOIN vs0 b ON abs(a.y - b.y) <= 1 AND abs(a.x - b.x) <= 1 AND a.image = b.image GROUP BY 1, 2, 3)"
    skeleton = f"{inside('vs0', 'mask')}, {degree}" if corrected else f"{mq._DEG}, {inside('vs', 'deg', ', degree')}"
    cells = """cell AS (SELECT image, sample, id, y, x FROM (SELECT *, unnest(range(y0, y1)) AS y FROM box), range(0, 32) q(x) WHERE x >= x0 AND x < x1), tissue AS (SELECT image AS sample, y // 4 AS ty, x // 4 AS tx FROM mask GROUP BY 1, 2, 3 HAVING count(*) >= 2),
    kept AS (SELECT image, y, x FROM (SELECT *, row_number() OVER (PARTITION BY sample, y, x ORDER BY id) AS place, y // 4 AS ty, x // 4 AS tx FROM cell) SEMI JOIN tissue USING (sample, ty, tx) WHERE place = 1),
    frac AS (SELECT image, round(avg((t.ty IS NOT NULL)::INT), 4) AS tissue_frac FROM cell c LEFT JOIN tissue t ON t.sample = c.sample AND t.ty = c.y // 4 AND t.tx = c.x // 4 GROUP BY 1),"""
    count = lambda name, labelled: f"{name}_n AS (SELECT image, count(DISTINCT label) AS {name} FROM {labelled} GROUP BY 1)"
    all_ = f"""{mq._S}, {src.SCENE_BOXES}, box AS (SELECT sample || '/' || id AS image, *, (x1 - x0) * (y1 - y0) AS area FROM (SELECT sample, id, greatest(0, x) AS x0, least(32, x + w) AS x1, greatest(0, y) AS y0, least(32, y + h) AS y1 FROM rect)), {cells if corrected else ''}
    body AS (SELECT * FROM scene WHERE v >= 80), wide AS (SELECT * FROM scene WHERE v >= 20), {mq._PLANE}, rad AS (SELECT a.image, a.y, a.x, sqrt(coalesce(min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x)), 16)) AS r FROM scene a LEFT JOIN bg b ON a.image = b.image AND (a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x) <= 9 GROUP BY 1, 2, 3),
    {skeleton}, {inside('vm', 'wide', ', v')}, {inside('vb', 'body')}, {inside('vr', 'rad', ', r')}, {inside('vp', 'scene', ', v')},
    jd AS (SELECT DISTINCT s.image, s.y + dy AS y, s.x + dx AS x FROM vs s JOIN box b USING (image), range(-2, 3) p(dy), range(-2, 3) q(dx) WHERE degree >= 3 AND dy * dy + dx * dx <= 4 AND s.y + dy >= y0 AND s.y + dy < y1 AND s.x + dx >= x0 AND s.x + dx < x1),
    tip AS (SELECT image, y, x FROM vs WHERE degree = 1), {mq._label('jl', 'jd')}, {mq._label('tl', 'tip')}, {mq._label('bl', 'vb')}, {mq._label('pl', 'vs')}, {count('n_junctions', 'jl')}, {count('n_tips', 'tl')}, {count('n_soma', 'bl')}, {count('n_comp', 'pl')},
    gapv AS (SELECT image, v, median(v) OVER (PARTITION BY image, label) AS med FROM pl JOIN vp USING (image, y, x)), gaps AS (SELECT image, avg((v < 0.2::DOUBLE * med)::INT) AS gap FROM gapv GROUP BY 1), width AS (SELECT image, avg(2 * {UNIT}::DOUBLE * r) AS width FROM vs JOIN vr USING (image, y, x) GROUP BY 1),
    near AS (SELECT DISTINCT s.image, s.y + dy AS y, s.x + dx AS x FROM vb s JOIN box b USING (image), range(-3, 4) p(dy), range(-3, 4) q(dx) WHERE s.y + dy >= y0 AND s.y + dy < y1 AND s.x + dx >= x0 AND s.x + dx < x1),
    rc AS (SELECT image, label, min(y) AS y0, max(y) AS y1, min(x) AS x0, max(x) AS x1 FROM pl LEFT JOIN (SELECT *, 1 AS near FROM near) USING (image, y, x) GROUP BY 1, 2 HAVING count(*) * {UNIT} < 20 AND count(near) / count(*)::DOUBLE > 0.6),
    rp AS (SELECT c.image, c.label FROM rc c JOIN vm m ON m.image = c.image AND m.y >= c.y0 - 8 AND m.y <= c.y1 + 8 AND m.x >= c.x0 - 8 AND m.x <= c.x1 + 8 GROUP BY 1, 2 HAVING max(v) / 2.0 >= {ROUND_Z}), n_round_n AS (SELECT image, count(*) AS n_round FROM rp GROUP BY 1),
    area AS ({'SELECT image, count(*) AS cells FROM kept GROUP BY 1' if corrected else 'SELECT image, area AS cells FROM box'}), fg AS (SELECT image, count(*) AS fg FROM vm GROUP BY 1), ln AS (SELECT image, count(*) AS px FROM vs GROUP BY 1),
    t AS (SELECT sample, id, {'tissue_frac, ' if corrected else ''}cells, cells * ({UNIT}::DOUBLE / 1000) * ({UNIT}::DOUBLE / 1000) AS mm2, coalesce(fg, 0) AS fg, coalesce(px, 0) AS px, coalesce(px, 0) * {UNIT}::DOUBLE AS um, coalesce(gap, 0) AS gap, coalesce(width, 0) AS width, coalesce(n_junctions, 0) AS n_junctions, coalesce(n_tips, 0) AS n_tips, coalesce(n_comp, 0) AS n_comp, coalesce(n_soma, 0) AS n_soma, coalesce(n_round, 0) AS n_round
      FROM box JOIN area USING (image) {'JOIN frac USING (image)' if corrected else ''} LEFT JOIN fg USING (image) LEFT JOIN ln USING (image) LEFT JOIN gaps USING (image) LEFT JOIN width USING (image) LEFT JOIN n_junctions_n USING (image) LEFT JOIN n_tips_n USING (image) LEFT JOIN n_comp_n USING (image) LEFT JOIN n_soma_n USING (image) LEFT JOIN n_round_n USING (image))"""
    return f"""{all_} SELECT sample, id, {'tissue_frac, ' if corrected else ''}round(mm2, 5) AS area_mm2, round(100 * fg / cells::DOUBLE, 3) AS fg_pct, round(um, 1) AS skel_len_um, round(um / 1000 / mm2, 3) AS skel_mm_per_mm2, n_junctions, n_tips, n_comp, n_soma, round(n_junctions / mm2, 1) AS junc_per_mm2, round(n_tips / mm2, 1) AS tips_per_mm2,
    round(n_soma / mm2, 1) AS soma_per_mm2, CASE WHEN px > 0 THEN round(100 * n_junctions / um, 3) ELSE 0.0::DOUBLE END AS junc_per_100um, round(width, 3) AS mean_width_um, n_round, round(n_round / mm2, 1) AS round_per_mm2, round(n_round / greatest(n_comp, 1)::DOUBLE, 4) AS round_frac, round(gap, 4) AS skel_gap_frac FROM t"""


ALL = {
    "ridges": (ridges, None),
    "seed_curvature": (seed_curvature, None),
    "top_hat": (top_hat, f"WITH {src.SCENES}, {_HAT} SELECT * FROM hat"),
    "top_hat_mask": (top_hat_mask, f"WITH {src.SCENES}, {_HAT}, {_OTSU}, {_CLOSE} SELECT * FROM shut"),
    "without_background": (without_background, None),
    "skeleton": (skeleton, None),
    "skeleton_segments": (skeleton_segments, f"{mq._S}, {_MEAS} SELECT * FROM meas"),
    "line_segments": (line_segments, None),
    "merged_junctions": (merged_junctions, f"{mq._S}, {_MERGED}"),
    "pruned_spurs": (pruned_spurs, f"{mq._S}, {_MEAS} SELECT image, y, x FROM mask ANTI JOIN (SELECT image, y, x FROM sl SEMI JOIN (SELECT * FROM meas WHERE kind = 1 AND px <= 2) USING (image, segment)) USING (image, y, x)"),
    "clean_lines": (clean_lines, None),
    "opened_loops": (opened_loops, f"{mq._S}, {_HOLES} SELECT image, y, x FROM thick ANTI JOIN cut USING (image, y, x)"),
    "suppressed_pixels": (suppressed_pixels, None),
    "attributed_pixels": (attributed_pixels, None),
    "source_hops": (source_hops, f"{mq._S}, {_HOPS} SELECT image, y, x, min(hops)::BIGINT AS hops FROM hop GROUP BY 1, 2, 3"),
    "tip_hops": (tip_hops, f"{mq._S}, {mq._DEG}, {_HOPS} SELECT image, y * {SIDE} + x AS id, min(hops)::BIGINT AS hops FROM hop JOIN deg USING (image, y, x) WHERE degree = 1 GROUP BY 1, 2"),
    "exact_distances": (exact_distances, f"{mq._S}, {mq._PLANE} SELECT a.image, a.y, a.x, min((a.y - b.y) * (a.y - b.y) + (a.x - b.x) * (a.x - b.x))::BIGINT AS d2 FROM scene a LEFT JOIN bg b ON a.image = b.image GROUP BY 1, 2, 3"),
    "translated_frames": (translated_frames, f"""WITH {src.FRAMES}, s AS (SELECT *, (t % 11 - 5) / 4.0::DOUBLE AS dy, (t % 7 - 3) / 4.0::DOUBLE AS dx FROM frames),
        p AS (SELECT z, t, y + floor(dy)::BIGINT + a AS y, x + floor(dx)::BIGINT + b AS x, v * abs(1 - a - (dy - floor(dy))) * abs(1 - b - (dx - floor(dx))) AS v FROM s, range(0, 2) i(a), range(0, 2) j(b) WHERE (a = 0 OR dy > floor(dy)) AND (b = 0 OR dx > floor(dx)))
        SELECT z, t, y, x, round(sum(v), 9) AS v FROM p WHERE y BETWEEN 0 AND 7 AND x BETWEEN 0 AND 7 GROUP BY 1, 2, 3, 4"""),
    "volume_shifts": (volume_shifts, None),
    "roi_block_metrics": (roi_block_metrics, _block(False)),
    "roi_block_corrected": (roi_block_corrected, _block(True)),
    "roi_block_lines": (roi_block_lines, None),
}
QUERIES = {k: f for k, (f, _) in ALL.items()}
ORACLE_SQL = {k: s for k, (_, s) in ALL.items() if s}
