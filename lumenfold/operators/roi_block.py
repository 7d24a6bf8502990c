"""The block of measurements of each region: area, foreground, skeleton, junctions, tips, parts, cell bodies, width, round cells, gaps.

Layers are relations of a sample's pixels; a region's view of one holds the pixels in its box under the region's own key, so that whatever counts connected
parts counts them by region, cut off at its edge. All regions of all samples are measured together.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import grid
from lumenfold.operators import morphology as mo

KEY = ["image", "y", "x"]
#: A round cell has a skeleton under this length (in micrometres), more than this share of it near a cell body, and pixels this near count.
ROUND_LENGTH, ROUND_SHARE, ROUND_NEAR, ROUND_MARGIN = 20.0, 0.6, 3, 8
#: A skeleton pixel is a gap under this share of the median of its part.
GAP_SHARE = 0.2


def keyed(boxes: DataFrame) -> DataFrame:
    """Cropped boxes (sample, id, x0, x1, y0, y1, area) with their key as `image`."""
    return boxes.withColumn("image", F.concat_ws("/", F.col("sample").cast("string"), F.col("id").cast("string")))


def view(boxes: DataFrame, layer: DataFrame) -> DataFrame:
    """layer(sample, y, x, ...) as (image, y, x, ...): what each box of keyed boxes holds of its sample. The join is on sample and row."""
    rows = boxes.select("image", "sample", "x0", "x1", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"))
    inside = rows.hint("merge").join(layer, ["sample", "y"]).where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    return inside.select("image", "y", "x", *[c for c in layer.columns if c not in ("sample", "y", "x")])


def kept_cells(boxes: DataFrame, tissue: DataFrame, step: int) -> tuple[DataFrame, DataFrame]:
    """(image, y, x) of the cells of keyed boxes on tissue(sample, ty, tx), cells of `step` pixels, and in no earlier box of the sample; and (image, tissue_frac)."""
    rows = boxes.select("image", "sample", "id", "x0", "x1", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"))
    cells = rows.select("image", "sample", "id", "y", F.explode(F.sequence("x0", F.col("x1") - 1)).alias("x"))
    first = cells.groupBy("sample", "y", "x").agg(F.min(F.struct("id", "image")).alias("b")).select("sample", "y", "x", F.col("b.image").alias("image"))
    on = tissue.select("sample", "ty", "tx").distinct().withColumn("on", F.lit(1))
    at = lambda df: df.withColumn("ty", F.floor(F.col("y") / step)).withColumn("tx", F.floor(F.col("x") / step))
    share = at(cells).join(on.hint("merge"), ["sample", "ty", "tx"], "left").groupBy("image").agg(F.round(F.avg(F.coalesce("on", F.lit(0))), 4).alias("tissue_frac"))
    return at(first).hint("merge").join(on.hint("merge"), ["sample", "ty", "tx"], "left_semi").select(*KEY), share


def _clipped(px: DataFrame, boxes: DataFrame) -> DataFrame:
    ends = boxes.select("image", "x0", "x1", "y0", "y1")
    inside = (F.col("y") >= F.col("y0")) & (F.col("y") < F.col("y1")) & (F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1"))
    return px.join(ends.hint("merge"), "image").where(inside).select(*KEY)


def _counted(px: DataFrame, name: str) -> DataFrame:
    """(image, name): connected parts."""
    return grid.components(px.select(*KEY)).groupBy("image").agg(F.countDistinct("label").alias(name))


def _round_cells(parts: DataFrame, boxes: DataFrame, soma: DataFrame, bright: DataFrame, sigma: DataFrame, unit: float, least: float) -> DataFrame:
    """(image, n_round): short parts of the skeleton that lie mostly near a cell body, with a bright enough pixel of the mask around them."""
    square = [(a, b) for a in range(-ROUND_NEAR, ROUND_NEAR + 1) for b in range(-ROUND_NEAR, ROUND_NEAR + 1)]
    near = grid.beside(parts, "label", soma.withColumn("_", F.lit(0).cast("long")), "_", square).select("image", F.col("y0").alias("y"), F.col("x0").alias("x")).distinct()
    by = parts.join(near.withColumn("near", F.lit(1)).hint("merge"), KEY, "left").groupBy("image", "label").agg(
        F.count("*").alias("n"), F.count("near").alias("k"), F.min("y").alias("top"), F.max("y").alias("end"), F.min("x").alias("left"), F.max("x").alias("right")
    )
    small = by.where((F.col("n") * unit < ROUND_LENGTH) & (F.col("k") / F.col("n") > ROUND_SHARE))
    rows = small.select("image", "label", "left", "right", F.explode(F.sequence(F.col("top") - ROUND_MARGIN, F.col("end") + ROUND_MARGIN)).alias("y"))
    seen = rows.hint("merge").join(bright, ["image", "y"]).where((F.col("x") >= F.col("left") - ROUND_MARGIN) & (F.col("x") <= F.col("right") + ROUND_MARGIN))
    peak = seen.groupBy("image", "label").agg(F.max("v").alias("peak"))
    return peak.join(sigma, "image").where(F.col("peak") / F.greatest("sigma", F.lit(1e-9)) >= least).groupBy("image").agg(F.count("*").alias("n_round"))


def block(boxes: DataFrame, sk: DataFrame, mask: DataFrame, soma: DataFrame, px: DataFrame, radius: DataFrame, sigma: DataFrame, unit: float, merge: float, round_z: float, kept: DataFrame | None = None) -> DataFrame:
    """The measurements of each of the keyed boxes, with those of which there is none 0.

    Layers: sk, mask and soma (sample, y, x), px with v, radius with r; sigma (sample, sigma). A pixel without a value is 0. `unit` is micrometres a pixel;
    junctions whose disks of merge / 2 touch are one. Neighbours of skeleton pixels are counted on the whole skeleton, or, where only `kept`
    cells (image, y, x) are measured, on what of it is kept. Columns: area_mm2, fg_pct, skel_len_um, skel_mm_per_mm2, n_junctions, n_tips, n_comp,
    n_soma, junc_per_mm2, tips_per_mm2, soma_per_mm2, junc_per_100um, mean_width_um, n_round, round_per_mm2, round_frac, skel_gap_frac.
    """
    own = (lambda v: v.join(kept.hint("merge"), KEY, "left_semi")) if kept is not None else (lambda v: v)
    layer = lambda df: own(view(boxes, df)).checkpoint()
    v_mask, v_soma = layer(mask.select("sample", "y", "x")), layer(soma.select("sample", "y", "x"))
    if kept is None:
        counted = grid.degree(sk.select(F.col("sample").alias("image"), "y", "x")).withColumnRenamed("image", "sample")
        v_sk = layer(counted)
    else:
        v_sk = grid.degree(layer(sk.select("sample", "y", "x"))).checkpoint()
    v_px = view(boxes, px.select("sample", "y", "x", "v")).checkpoint()
    reach = mo.disk(max(1, round(merge / 2 / unit)))
    joints = _clipped(grid._around(v_sk.where("degree >= 3"), reach).select(*KEY).distinct(), boxes)
    parts = grid.components(v_sk.select(*KEY)).checkpoint()
    valued = parts.hint("merge").join(v_px, KEY, "left").fillna(0, ["v"])
    med = valued.groupBy("image", "label").agg(F.median("v").alias("med"))
    gaps = valued.join(med, ["image", "label"]).groupBy("image").agg(F.avg((F.col("v") < GAP_SHARE * F.col("med")).cast("int")).alias("gap"))
    width = v_sk.hint("merge").join(view(boxes, radius.select("sample", "y", "x", "r")), KEY).groupBy("image").agg(F.avg(2 * unit * F.col("r")).alias("width"))
    own_sigma = boxes.select("image", "sample").join(sigma, "sample").select("image", "sigma")
    found = [
        v_mask.groupBy("image").agg(F.count("*").alias("fg")), v_sk.groupBy("image").agg(F.count("*").alias("px")), gaps, width,
        _counted(joints, "n_junctions"), _counted(v_sk.where("degree = 1"), "n_tips"), _counted(v_soma, "n_soma"), parts.groupBy("image").agg(F.countDistinct("label").alias("n_comp")),
        _round_cells(parts, boxes, v_soma, v_mask.hint("merge").join(v_px, KEY, "left").fillna(0, ["v"]), own_sigma, unit, round_z),
    ]
    cells = boxes.select("image", "sample", "id", F.col("area").alias("cells"))
    if kept is not None:
        cells = cells.drop("cells").join(kept.groupBy("image").agg(F.count("*").alias("cells")), "image")
    for f in found:
        cells = cells.join(f.hint("merge"), "image", "left")
    cells = cells.fillna(0, ["fg", "px", "gap", "width", "n_junctions", "n_tips", "n_soma", "n_comp", "n_round"])
    mm2, um = F.col("cells") * (unit / 1e3) ** 2, F.col("px") * unit
    per = lambda c, k: F.round(c / mm2, k)
    return cells.select(
        "sample", "id", F.round(mm2, 5).alias("area_mm2"), F.round(100 * F.col("fg") / F.col("cells"), 3).alias("fg_pct"), F.round(um, 1).alias("skel_len_um"), per(um / 1e3, 3).alias("skel_mm_per_mm2"),
        "n_junctions", "n_tips", "n_comp", "n_soma", per(F.col("n_junctions"), 1).alias("junc_per_mm2"), per(F.col("n_tips"), 1).alias("tips_per_mm2"), per(F.col("n_soma"), 1).alias("soma_per_mm2"),
        F.when(F.col("px") > 0, F.round(100 * F.col("n_junctions") / um, 3)).otherwise(F.lit(0.0)).alias("junc_per_100um"), F.round("width", 3).alias("mean_width_um"), "n_round", per(F.col("n_round"), 1).alias("round_per_mm2"),
        F.round(F.col("n_round") / F.greatest("n_comp", F.lit(1)), 4).alias("round_frac"), F.round("gap", 4).alias("skel_gap_frac"),
    )
