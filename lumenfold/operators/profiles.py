"""What an image's skeleton is like: branches as walks from tips, how much of the foreground it covers, tips and junctions at the tissue's edge."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import grid, skeletons
from lumenfold.operators import morphology as mo


def branches(segments: DataFrame, junctions: DataFrame) -> DataFrame:
    """(image, segment, length): pixels of each segment with a tip. A walk from it also takes the junction pixel it ends at, if no walk from a tip before it (by
    row, then column) has."""
    tips = segments.where("degree = 1").groupBy("image", "segment").agg(F.min(F.struct("y", "x")).alias("tip"))
    size = segments.groupBy("image", "segment").agg(F.count("*").alias("px")).join(tips, ["image", "segment"])
    ends = skeletons.attached(segments, junctions).select("image", "segment", F.col("y").alias("jy"), F.col("x").alias("jx")).distinct().join(tips, ["image", "segment"])
    first = ends.groupBy("image", "jy", "jx").agg(F.min(F.struct("tip", "segment")).alias("f")).groupBy("image", F.col("f.segment").alias("segment")).agg(F.count("*").alias("more"))
    return size.join(first, ["image", "segment"], "left").select("image", "segment", (F.col("px") + F.coalesce("more", F.lit(0))).alias("length"))


def covered(sk: DataFrame, foreground: DataFrame, reaches: list[int]) -> DataFrame:
    """(image, n_fg, within_r for each reach): foreground pixels, and the share of them no farther than r from the skeleton, in one pass over the widest disk."""
    far = max(reaches)
    near = grid._around(sk, mo.disk(far)).withColumn("d2", (F.col("y") - F.col("y0")) * (F.col("y") - F.col("y0")) + (F.col("x") - F.col("x0")) * (F.col("x") - F.col("x0")))
    near = near.groupBy("image", "y", "x").agg(F.min("d2").alias("d2"))
    met = foreground.select("image", "y", "x").join(near, ["image", "y", "x"], "left")
    return met.groupBy("image").agg(F.count("*").alias("n_fg"), *[(F.count_if(F.col("d2") <= r * r) / F.count("*")).alias(f"within_{r}") for r in reaches])


def skeleton_profile(sk: DataFrame, foreground: DataFrame, pixels: int, reaches: list[int], short: int = 5) -> DataFrame:
    """A row for each image with foreground: sizes, tips and junction pixels, branches, the share of short ones, their mean length, coverage of the foreground."""
    segments, junctions = skeletons.parts(sk)
    points = segments.select("image", "degree").union(junctions.select("image", F.lit(3).cast(segments.schema["degree"].dataType)))
    counts = points.groupBy("image").agg(F.count("*").alias("n_skel"), F.count_if(F.col("degree") == 1).alias("n_endpoints"), F.count_if(F.col("degree") >= 3).alias("n_junctions"))
    walks = branches(segments, junctions).groupBy("image").agg(F.count("*").alias("n_branches"), F.avg((F.col("length") < short).cast("int")).alias("short_spur_frac"), F.avg("length").alias("mean_branch_len"))
    whole = ["n_skel", "n_endpoints", "n_junctions", "n_branches"]
    all_ = covered(sk, foreground, reaches).join(counts, "image", "left").join(walks, "image", "left").fillna(0, whole).fillna(0.0, ["short_spur_frac", "mean_branch_len"])
    per = {"skel_per_fg": F.col("n_skel") / F.col("n_fg"), "skel_per_px": F.col("n_skel") / pixels, "endpoint_per_fg": F.col("n_endpoints") / F.col("n_fg")}
    rounded = [F.round(c, 6).alias(n) for n, c in (per | {n: F.col(n) for n in ("short_spur_frac", "mean_branch_len", *[f"within_{r}" for r in reaches])}).items()]
    return all_.select("image", "n_fg", *whole, *rounded)


def edge_band(mask: DataFrame, sk: DataFrame, closing: float, band: float, side: int) -> DataFrame:
    """(image, tips, joints, ratio): of the skeleton's tips and junction pixels those on tissue, the closed and filled mask, nearer than band to what is none.

    ratio: tips for each junction pixel, of which at least one is assumed. Without anything but tissue there is no edge.
    """
    tissue = mo.filled(mo.closed(mask, mo.disk(closing), side), side)
    edge = mo.distances(tissue, side, math.ceil(band)).where(F.col("d2") < band * band).select("image", "y", "x")
    at = grid.degree(sk).join(edge, ["image", "y", "x"], "left_semi").groupBy("image").agg(F.count_if(F.col("degree") == 1).alias("tips"), F.count_if(F.col("degree") >= 3).alias("joints"))
    all_ = mask.select("image").distinct().join(at, "image", "left").fillna(0, ["tips", "joints"])
    return all_.select("image", "tips", "joints", F.round(F.col("tips") / F.greatest("joints", F.lit(1)), 6).alias("ratio"))
