"""Regions of interest: clamping, cropping, what earlier regions cover, measurements inside."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import stacks


def clamped(rois: DataFrame, side: int, most: int) -> DataFrame:
    """Boxes of at most `most` by `most`, moved until they lie on the plane."""
    w, h = F.least("w", F.lit(most)), F.least("h", F.lit(most))
    return rois.select("sample", "id", F.greatest(F.lit(0), F.least("x", side - w)).alias("x"), F.greatest(F.lit(0), F.least("y", side - h)).alias("y"), w.alias("w"), h.alias("h"))


def cropped(rois: DataFrame, side: int, least_area: int = 1) -> DataFrame:
    """What of each box lies on the plane, as half-open (x0, x1, y0, y1) with its area; those under least_area go."""
    ends = [F.greatest(F.lit(0), F.col("x")).alias("x0"), F.least(F.lit(side), F.col("x") + F.col("w")).alias("x1"), F.greatest(F.lit(0), F.col("y")).alias("y0"), F.least(F.lit(side), F.col("y") + F.col("h")).alias("y1")]
    area = F.greatest(F.lit(0), F.col("x1") - F.col("x0")) * F.greatest(F.lit(0), F.col("y1") - F.col("y0"))
    return rois.select("sample", "id", *ends).withColumn("area", area).where(F.col("area") >= least_area)


def with_earlier(rois: DataFrame) -> DataFrame:
    """(sample, id, n_earlier, earlier): each region with all regions of its sample before it, as text x:y:w:h;..."""
    w = Window.partitionBy("sample").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    before = F.collect_list(F.concat_ws(":", "x", "y", "w", "h")).over(w)
    return rois.select("sample", "id", F.size(before).cast("long").alias("n_earlier"), F.array_join(before, ";").alias("earlier"))


def covered(boxes: DataFrame) -> DataFrame:
    """(sample, id, area, overlap): how much of each cropped box the union of its sample's earlier ones covers.

    Each cell of the plane belongs to the first box that holds it: a sample's boxes are laid on a plane, the last one first, and what is seen of each is
    counted. A task holds the boxes of some samples and one plane.
    """

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out, ends = np.empty(len(f), np.int64), f[["y0", "y1", "x0", "x1"]].to_numpy(np.int64)
        order = np.lexsort((f["id"].to_numpy(), stacks.numbers(starts, len(f))))  # groups stay where they are
        ends, id_ = ends[order], f["id"].to_numpy()[order]
        for i, j in zip(starts.tolist(), [*starts.tolist()[1:], len(f)], strict=True):
            low, high = ends[i:j].min(0), ends[i:j].max(0)
            plane = np.full((high[1] - low[0], high[3] - low[2]), -1)
            number = np.cumsum(np.append(0, id_[i + 1 : j] != id_[i : j - 1]))  # boxes of one id are one
            for k in range(j - i - 1, -1, -1):
                a, b, c, d = ends[i + k]
                plane[a - low[0] : b - low[0], c - low[2] : d - low[2]] = number[k]
            own = np.bincount(plane[plane >= 0], minlength=j - i)
            out[order[i:j]] = own[number]
        return f[["sample", "id", "area"]].assign(overlap=f["area"].to_numpy() - out)

    long_ = boxes.select("sample", "id", *[F.col(c).cast("long").alias(c) for c in ("x0", "x1", "y0", "y1")], "area")
    kind = {c: boxes.schema[c].dataType.simpleString() for c in ("sample", "id", "area")}
    return stacks.whole_groups(long_, ["sample"], run, f"sample {kind['sample']}, id {kind['id']}, area {kind['area']}, overlap long")


def measured(boxes: DataFrame, px: DataFrame, bright: int, corrected: bool = False) -> DataFrame:
    """(sample, id, n, total, mean, peak, bright_pct, per_area) of the pixels in each box; corrected: of those in no earlier box of the sample.

    A sample's boxes meet its pixels row by row: the join is on sample and y.
    """
    rows = boxes.select("sample", "id", "x0", "x1", "area", F.explode(F.sequence("y0", F.col("y1") - 1)).alias("y"))
    inside = rows.join(px, ["sample", "y"]).where((F.col("x") >= F.col("x0")) & (F.col("x") < F.col("x1")))
    if corrected:
        inside = inside.withColumn("first", F.min("id").over(Window.partitionBy("sample", "y", "x"))).where("id = first")
    by = inside.groupBy("sample", "id").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.max("v").alias("peak"), F.count_if(F.col("v") >= bright).alias("k"), F.first("area").alias("a"))
    return by.select("sample", "id", "n", "total", F.round(F.col("total") / F.col("n"), 6).alias("mean"), "peak", F.round(100 * F.col("k") / F.col("n"), 6).alias("bright_pct"), F.round(F.col("total") / F.col("a"), 6).alias("per_area"))
