"""Cells found from the skeleton first: gates on its parts, cell bodies where it is thickest, tips and branches given to the body that reaches them first."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import geodesics, grid, halo, spatial, stacks
from lumenfold.sources import files

KEY = ["image", "y", "x"]


@dataclass(frozen=True)
class Gates:
    """Fixed values of the detector: pixels of a part, radius and brightness of a body, pixels between bodies, body to median radius and from how many pixels on
    that counts, tips of a cell, and where the ring for its trunks begins beyond the body, at least how far out, and its width."""

    pixels: int = 8
    radius: float = 4.0
    bright: float = 0.20
    apart: float = 12
    prominence: float = 1.50
    prominent_from: int = 25
    tips: int = 1
    pad: int = 2
    ring_from: int = 3
    ring: int = 6


def known(sk: DataFrame) -> DataFrame:
    """sk(image, y, x, r, v) with degree and the label of its part."""
    return grid.components(grid.degree(sk, keep=["r", "v"]), keep=["r", "v", "degree"])


def known_on_planes(px: DataFrame, reach: int, side: int, unit: float) -> DataFrame:
    """What `known` makes of the skeletons of planes of px(image, y, x, v) that fit a task, with distances to the background up to reach and v in units: see `halo.measured`."""

    def parts(f: pd.DataFrame) -> pd.DataFrame:
        f = f.assign(v=f["v"] / unit)[f["line"]]
        if len(f):  # none where all pixels are beside their planes
            f = grid.neighbours(f, stacks._starts(f, ["image"]), grid.OFFSETS8, "degree")
            f = grid.labelled(f, stacks._starts(f, ["image"]), grid.OFFSETS8, 1 << 20)
        return f.reindex(columns=[*KEY, "r", "v", "degree", "label"])

    return halo.measured(px, reach, side, parts, f"image {px.schema['image'].dataType.simpleString()}, y long, x long, r double, v double, degree long, label long")


def gated(parts: DataFrame, gates: Gates) -> DataFrame:
    """(image, label, n, reason): why a part of `known` pixels holds no cell, null where it may."""
    body = (F.col("r") >= gates.radius) & (F.col("v") >= gates.bright)
    by = parts.groupBy("image", "label").agg(F.count("*").alias("n"), F.count_if((F.col("degree") == 1) | (F.col("degree") >= 3)).alias("nodes"), F.median("r").alias("usual"), F.max(F.when(body, F.col("r"))).alias("best"))
    flat = (F.col("n") >= gates.prominent_from) & (F.col("usual") > 0) & (F.col("best") < gates.prominence * F.col("usual"))
    reason = F.when(F.col("n") < gates.pixels, "too_small").when(F.col("nodes") == 0, "no_morphology").when(F.col("best").isNull(), "no_fat_point").when(flat, "low_prominence")
    return by.select("image", "label", "n", reason.alias("reason"))


def bodies(parts: DataFrame, passed: DataFrame, gates: Gates, width: int) -> DataFrame:
    """(image, label, id, y, x, r, v, place): the thickest pixels of passed parts, none nearer than `apart` to one before it in its part. id: y * width + x."""
    at = parts.where((F.col("r") >= gates.radius) & (F.col("v") >= gates.bright)).join(passed.select("image", "label"), ["image", "label"], "left_semi")
    at = at.select("image", "label", (F.col("y") * width + F.col("x")).alias("id"), "y", "x", "r", "v").checkpoint()
    kept = spatial.suppressed(at.select(F.struct("image", "label").alias("image"), "id", "y", "x", F.col("r").alias("score")), gates.apart)
    place = F.row_number().over(Window.partitionBy("image", "label").orderBy(F.col("r").desc(), "id"))
    return at.join(kept.select(F.col("image.image").alias("image"), F.col("image.label").alias("label"), "id"), ["image", "label", "id"]).withColumn("place", place)


def trunks(at: DataFrame, sk: DataFrame, gates: Gates) -> DataFrame:
    """(image, id, r_in, r_out, n_trunks) of at(image, id, y, x, r): connected pieces of the skeleton in the ring around each body."""
    near = F.greatest(F.lit(gates.ring_from), F.bround("r").cast("int") + gates.pad)
    ring = at.select("image", "id", F.col("y").alias("cy"), F.col("x").alias("cx"), near.alias("r_in"), (near + gates.ring).alias("r_out"))
    # pixels and rings meet in cells of one width, so no ring is written out; its pixels are labelled by themselves
    wide = 2 * (gates.ring_from + gates.pad + gates.ring) + 1
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - F.col("r_out")) / wide), F.floor((F.col(c) + F.col("r_out")) / wide)))
    spread = ring.withColumn("ty", span("cy")).withColumn("tx", span("cx"))
    met = spread.hint("merge").join(sk.select(*KEY, F.floor(F.col("y") / wide).alias("ty"), F.floor(F.col("x") / wide).alias("tx")), ["image", "ty", "tx"])
    d2 = (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))
    met = met.where((d2 >= F.col("r_in") * F.col("r_in")) & (d2 <= F.col("r_out") * F.col("r_out"))).select("image", "id", "y", "x")

    def pieces(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return grid.labelled(f, starts, grid.OFFSETS8, 1 << 20).drop_duplicates(["image", "id", "label"]).groupby(["image", "id"], sort=False).size().rename("n_trunks").reset_index()

    kind, name = (met.schema[c].dataType.simpleString() for c in ("image", "id"))
    n = stacks.whole_groups(met, ["image", "id"], pieces, f"image {kind}, id {name}, n_trunks long")
    return ring.select("image", "id", "r_in", "r_out").join(n, ["image", "id"], "left").fillna(0, ["n_trunks"])


def cells(sk: DataFrame, gates: Gates = Gates(), width: int = 1 << 20) -> DataFrame:
    """A row for each cell of sk(image, y, x, r, v): its body, what it claims of the skeleton (n_endpoints, n_branches, skel_length), trunks, and its part.

    Pixels go to the body that reaches them first. A body that claims fewer tips than the gate is none, though its pixels stay with it.
    """
    return found(files.table(known(sk)), gates, width)


def found(parts: DataFrame, gates: Gates = Gates(), width: int = 1 << 20) -> DataFrame:
    """The `cells` of parts that are `known` and read from a table."""
    passed = files.table(gated(parts, gates).where("reason IS NULL").select("image", "label", F.col("n").alias("comp_skel_px")))
    at = files.table(bodies(parts, passed, gates, width))
    # no way leads from a body to another part, so parts that didn't pass need not be taken out
    claimed = geodesics.attributed(parts, at, ["degree"], tables=True).groupBy("image", "id")
    claimed = claimed.agg(F.count_if(F.col("degree") == 1).alias("n_endpoints"), F.count_if(F.col("degree") >= 3).alias("n_branches"), F.count("*").alias("skel_length"))
    true = files.table(at.join(claimed, ["image", "id"]).withColumn("somas_in_comp", F.count("*").over(Window.partitionBy("image", "label"))).where(F.col("n_endpoints") >= gates.tips))
    return true.join(passed, ["image", "label"]).join(trunks(true, parts, gates), ["image", "id"]).drop("place")
