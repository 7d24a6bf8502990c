"""Skeletons as relations of their pixels: segments between junctions, merged junctions, spurs, loops.

A pixel with three neighbours or more is a junction pixel; junction pixels that touch are one junction, pixels that touch without any are one segment. Both
are connected components (tiles first, rounds over tile borders only), so a long path is never walked pixel by pixel.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import grid, halo, stacks
from lumenfold.operators import morphology as mo

KEY = ["image", "y", "x"]


def _step(y0: str, x0: str) -> Column:
    """The length of a step between neighbours."""
    return F.when((F.col("y") != F.col(y0)) & (F.col("x") != F.col(x0)), F.lit(2.0**0.5)).otherwise(F.lit(1.0))


def parts(sk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(segments, junctions) of a skeleton: (image, y, x, segment, degree) and (image, y, x, junction)."""
    px = grid.degree(sk.select(*KEY).distinct()).checkpoint()
    joints = grid.components(px.where("degree >= 3").select(*KEY)).withColumnRenamed("label", "junction")
    plain = px.where("degree < 3")
    return grid.components(plain.select(*KEY)).withColumnRenamed("label", "segment").join(plain.hint("merge"), KEY).checkpoint(), joints


def attached(segments: DataFrame, junctions: DataFrame) -> DataFrame:
    """(image, segment, y0, x0, y, x, junction): pixels of segments beside pixels of junctions."""
    return grid.beside(segments, "segment", junctions, "junction", grid.OFFSETS8)


def measured(segments: DataFrame, junctions: DataFrame) -> DataFrame:
    """(image, segment, px, length, tips, joints, kind, my, mx) of each segment.

    `length` sums the steps along it, 1 or the root of 2, with the one to each junction, the shortest there is; `tips` are its ends without a
    junction (an isolated pixel is one), `joints` the junctions it touches. Kinds: 0 from tip to tip, 1 from a junction to a tip, 2 between
    junctions, 3 a ring. (my, mx) is the mean of its end pixels, those with at most one neighbour in it; of a ring the mean of all.
    """
    own = segments.select("image", "segment", "y", "x")
    near = grid.beside(own, "segment", own.withColumnRenamed("segment", "other"), "other", grid.OFFSETS8).where("segment = other")
    beside = near.groupBy("image", "segment", F.col("y0").alias("y"), F.col("x0").alias("x")).agg(F.count("*").alias("n"), F.sum(_step("y0", "x0")).alias("s"))
    px = segments.hint("merge").join(beside, ["image", "segment", "y", "x"], "left").fillna(0, ["n", "s"])
    end = F.col("n") <= 1
    by = px.groupBy("image", "segment").agg(
        F.count("*").alias("px"), (F.sum("s") / 2).alias("inner"), F.count_if(F.col("degree") <= 1).alias("tips"),
        F.avg(F.when(end, F.col("y"))).alias("ey"), F.avg(F.when(end, F.col("x"))).alias("ex"), F.avg("y").alias("ay"), F.avg("x").alias("ax"),
    )
    steps = attached(segments, junctions).groupBy("image", "segment", "junction", "y0", "x0").agg(F.min(_step("y0", "x0")).alias("s"))
    # a junction is touched at each end; an end pixel beside two of its pixels touches it once
    joined = steps.groupBy("image", "segment").agg(F.sum("s").alias("outer"), F.countDistinct("junction").alias("joints"))
    all_ = by.join(joined, ["image", "segment"], "left").fillna(0, ["outer", "joints"])
    kind = F.when(F.col("tips") == 0, F.when(F.col("joints") == 0, 3).otherwise(2)).otherwise(F.when(F.col("joints") == 0, 0).otherwise(1))
    mean = lambda e, a: F.round(F.coalesce(e, a), 6)
    return all_.select("image", "segment", "px", F.round(F.col("inner") + F.col("outer"), 6).alias("length"), "tips", "joints", kind.alias("kind"), mean("ey", "ay").alias("my"), mean("ex", "ax").alias("mx"))


def merged_junctions(segments: DataFrame, junctions: DataFrame, under: float) -> DataFrame:
    """(image, junction, y, x, merged): junctions, those that a segment of fewer than `under` pixels connects as one.

    Segment and junction have to meet at a side. (y, x) is the mean of the centres of the junctions that became one, each counting once.
    """
    centres = junctions.groupBy("image", "junction").agg(F.avg("y").alias("cy"), F.avg("x").alias("cx"))
    short = segments.groupBy("image", "segment").agg(F.count("*").alias("n")).where(F.col("n") < under)
    ends = grid.beside(segments.join(short, ["image", "segment"], "left_semi"), "segment", junctions, "junction", grid.OFFSETS4).select("image", "segment", "junction").distinct()
    first = ends.groupBy("image", "segment").agg(F.min("junction").alias("first"))
    pairs = ends.join(first, ["image", "segment"]).where("junction <> first").select("image", F.col("junction").alias("id"), F.col("first").alias("to"))
    both = pairs.union(pairs.select("image", F.col("to").alias("id"), F.col("id").alias("to"))).distinct().checkpoint()
    roots = grid.least_labels(both).select("image", F.col("id").alias("junction"), "label")
    one = centres.join(roots, ["image", "junction"], "left").withColumn("junction", F.coalesce("label", "junction"))
    return one.groupBy("image", "junction").agg(F.round(F.avg("cy"), 6).alias("y"), F.round(F.avg("cx"), 6).alias("x"), F.count("*").alias("merged"))


def _spurs(sk: DataFrame, radius: DataFrame | None, most: float, times: float) -> DataFrame:
    segments, junctions = parts(sk)
    spurs = measured(segments, junctions).where("kind = 1")
    if radius is None:
        short = spurs.where(F.col("px") <= most)
    else:
        wide = attached(segments, junctions).select("image", "segment", "y", "x").distinct().join(radius, KEY).groupBy("image", "segment").agg(F.max("r").alias("r"))
        short = spurs.join(wide, ["image", "segment"], "left").where(F.col("length") < F.greatest(times * F.greatest(F.coalesce("r", F.lit(1.0)), F.lit(1.0)), F.lit(float(most))))
    return segments.join(short, ["image", "segment"], "left_semi").select(*KEY)


def pruned(sk: DataFrame, most: int, rounds: int | None = None) -> DataFrame:
    """A skeleton without spurs: segments from a junction to a tip of at most `most` pixels go, all at once, round by round until there is none (at most
    most + 3 rounds, as a spur may be what a round leaves of a bush)."""
    now = sk.select(*KEY).distinct()
    for _ in range(rounds or most + 3):
        gone = _spurs(now, None, most, 0).checkpoint()
        if gone.isEmpty():
            break
        now = now.join(gone, KEY, "left_anti").checkpoint()
    return now


def pruned_by_width(sk: DataFrame, radius: DataFrame, times: float, least: float) -> DataFrame:
    """A skeleton without the spurs that are shorter than `times` the radius(image, y, x, r) of the mask at their junction (1 at least), or than `least`.

    The measure is the length in pixels with the step to the junction. All such spurs go at once.
    """
    return sk.select(*KEY).distinct().join(_spurs(sk, radius, least, times), KEY, "left_anti")


def opened_loops(sk: DataFrame, px: DataFrame, most: int, shape: tuple[int, int], tile: int = 256, plain: bool = False, least: int = 3, rounds: int | None = None) -> DataFrame:
    """A skeleton without small loops: around each hole of at most `most` pixels the dimmest pixel (px.v, 0 where it has none; the first by row and column on
    ties) is cut, until no loop is left that can be cut, or `rounds` times.

    The loop is what touches the hole at a side; one of fewer than `least` pixels stays. With `plain` it is what touches it at a side or corner, and only pixels
    with two neighbours are cut, so that nothing comes apart. Pixels without an image stay.
    """
    now, px = sk.select(*KEY).distinct().checkpoint(), px.select(*KEY, "v").checkpoint()
    for _ in itertools.count() if rounds is None else range(rounds):
        holes = halo.small_holes(now, most, shape, tile)
        reach = grid.OFFSETS8 if plain else grid.OFFSETS4
        may = grid.degree(now).where("degree = 2") if plain else now
        ring = grid.beside(holes, "hole", may.withColumn("_", F.lit(0).cast("long")), "_", reach).select(*KEY, "hole").distinct()
        loop = ring.hint("merge").join(px.select(*KEY, "v"), KEY, "left").fillna(0, ["v"])
        cut = loop.groupBy("image", "hole").agg(F.min(F.struct("v", "y", "x")).alias("c"), F.count("*").alias("n")).where(F.col("n") >= (1 if plain else least))
        cut = cut.where("image IS NOT NULL").select("image", "c.y", "c.x").distinct().checkpoint()
        if cut.isEmpty():
            break
        now = now.join(cut.hint("merge"), KEY, "left_anti").checkpoint()
    return now


def opened_planes(px: DataFrame, most: int, side: int) -> DataFrame:
    """(image, y, x, r): skeletons of planes px(image, y, x, v) that fit a task, without loops around holes of at most `most` pixels, as of opened_loops with `plain` until
    none is left that can be cut; r is the distance to the nearest pixel of the plane that px doesn't have, however far, infinite where it has all.

    A plane is dealt once and its rounds are its own. Pixels without an image are thinned only.
    """

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        image, y, x, v, g = f["image"].to_numpy(), f["y"].to_numpy(), f["x"].to_numpy(), f["v"].to_numpy(), stacks.numbers(starts, len(f))
        out, ends, many = [], np.append(starts, len(f)), max(1, stacks.CELLS // side**2)
        for k in range(0, len(starts), many):
            m = min(k + many, len(starts))
            rows = slice(ends[k], ends[m])
            at, mask, value = (g[rows] - k, y[rows], x[rows]), np.zeros((m - k, side, side), bool), np.zeros((m - k, side, side), v.dtype)
            mask[at], value[at] = True, v[rows]
            line, known = halo.thinned(mask), ~pd.isna(image[starts[k:m]])
            line[known] = halo.without_loops(line[known], value[known], most)
            at, r = np.nonzero(line), np.sqrt(mo.far_outside(mask))
            out.append(pd.DataFrame({"image": image[starts[k + at[0]]], "y": at[1], "x": at[2], "r": r[at]}))
        return pd.concat(out, ignore_index=True)

    inside = px.where(F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1)).select(*KEY, "v").fillna(0, ["v"])
    return stacks.whole_groups(inside, ["image"], run, f"image {px.schema['image'].dataType.simpleString()}, y long, x long, r double")
