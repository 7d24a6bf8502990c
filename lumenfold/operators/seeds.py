"""Seeds of one cell found twice, and process peaks taken for seeds: told apart by necks on the way between them along the skeleton."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import geodesics, grid, halo, spatial, stacks
from lumenfold.sources import files


@dataclass(frozen=True)
class Limits:
    """Fixed values of the detector, in pixels but for the ratios: the longest way, what is cut off at its ends, the farthest snap, seeds that
    are one cell, the thinnest neck that keeps a weak seed and that parts strong ones, how long and at most how wide a thin run is."""

    way: int = 80
    trim: int = 4
    snap: int = 10
    same: float = 8
    demote: float = 0.60
    split: float = 0.55
    run: int = 5
    thin: float = 2.5


def necks(ways: DataFrame, limits: Limits) -> DataFrame:
    """ways(..., radii) with the pixels n on them, neck (the least radius off the ends to the smaller end's) and run (the most pixels in a row that are
    thinner than half the smaller end, or than `thin` if that is less). Ways of fewer than two pixels have neither and are left out.

    Off the ends: without `trim` (at least 1) pixels on either side, or the middle pixel alone where nothing would be left.
    """
    n, end = F.size("radii"), F.least(F.col("radii")[0], F.element_at("radii", -1))
    middle = F.when(n <= 2 * limits.trim, F.slice("radii", F.floor(n / 2).cast("int") + 1, 1)).otherwise(F.slice("radii", limits.trim + 1, F.greatest(n - 2 * limits.trim, F.lit(1))))
    cut = ways.where(n >= 2).withColumns({"n": n, "end": end, "middle": middle})
    thin = F.least(0.5 * F.col("end"), F.lit(limits.thin))

    def longer(s, r):
        now = F.when(r < thin, s["now"] + 1).otherwise(0)
        return F.struct(now.alias("now"), F.greatest(s["most"], now).alias("most"))

    run = F.aggregate("middle", F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), longer, lambda s: s["most"])
    return cut.withColumns({"neck": F.array_min("middle") / (F.col("end") + 1e-6), "run": run}).drop("radii", "middle", "end")


def placed(seeds: DataFrame, sk: DataFrame, mask: DataFrame, limits: Limits) -> DataFrame:
    """Strong and weak seeds(image, id, y, x, score, type), at whole places, with their part of the mask and the nearest pixel (sy, sx) of the skeleton; those
    without either are left out."""
    snapped = spatial.nearest_pixel(seeds, sk, limits.snap).select("image", "id", F.col("y").alias("sy"), F.col("x").alias("sx"))
    parts = grid.components(mask.select("image", "y", "x")).withColumnRenamed("label", "part")
    return seeds.where(F.col("type").isin("strong", "weak")).join(snapped, ["image", "id"]).join(parts, ["image", "y", "x"])


def pairs(at: DataFrame, reach: float) -> DataFrame:
    """(image, a, b, a_type, b_score, d2, ay, ax, by, bx): strong b for each weak a of the same part, and for each strong a those after it, within reach.

    Strong ones are in the order of falling scores, then ids. Points meet in cells four times as wide as the reach; a strong one goes to each that it
    reaches into, at most four, so most go to one.
    """
    wide = 4 * reach
    cell = lambda c: F.floor(F.col(c) / wide)
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - reach) / wide), F.floor((F.col(c) + reach) / wide)))
    a = at.select("image", "part", F.col("id").alias("a"), F.col("type").alias("a_type"), F.col("score").alias("a_score"), F.col("y").alias("y1"), F.col("x").alias("x1"), F.col("sy").alias("ay"), F.col("sx").alias("ax"), cell("y").alias("cy"), cell("x").alias("cx"))
    b = at.where("type = 'strong'").select("image", "part", F.col("id").alias("b"), F.col("score").alias("b_score"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("sy").alias("by"), F.col("sx").alias("bx"))
    b = b.withColumn("cy", span("y2")).withColumn("cx", span("x2"))
    d2 = (F.col("y1") - F.col("y2")) * (F.col("y1") - F.col("y2")) + (F.col("x1") - F.col("x2")) * (F.col("x1") - F.col("x2"))
    after = (F.col("a_type") == "weak") | (F.col("a_score") > F.col("b_score")) | ((F.col("a_score") == F.col("b_score")) & (F.col("a") < F.col("b")))
    met = a.join(b.hint("merge"), ["image", "part", "cy", "cx"]).where(after & (d2 <= reach * reach))
    return met.select("image", "a", "b", "a_type", "b_score", d2.alias("d2"), "ay", "ax", "by", "bx")


def placed_on_planes(px: DataFrame, reach: int, weak: float, limits: Limits, side: int) -> DataFrame:
    """(image, y, x, v, r, line, part, sy, sx) of the lines and seeds of planes that fit a task, by `halo.measured`: seeds are the pixels of `weak` and more, placed as `placed`
    does it where all pixels are the mask and its skeleton (`line`) is the skeleton."""
    columns = ["image", "y", "x", "v", "r", "line", "part", "sy", "sx"]

    def placed(f: pd.DataFrame) -> pd.DataFrame:
        f = grid.labelled(f, stacks._starts(f, ["image"]), grid.OFFSETS8, 1 << 20).rename(columns={"label": "part"})
        f = spatial.snapped(f, stacks._starts(f, ["image"]), f["line"].to_numpy(), (f["v"] >= weak).to_numpy(), limits.snap)
        return f[columns][f["line"] | f["sy"].notna()]

    kind = {n: px.schema[n].dataType.simpleString() for n in ("image", "v")}
    return halo.measured(px, reach, side, placed, f"image {kind['image']}, y long, x long, v {kind['v']}, r double, line boolean, part long, sy long, sx long")


def resolved(seeds: DataFrame, sk: DataFrame, mask: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(image, id, type, into, parted, unsure) of seeds(image, id, y, x, score, type), given sk(image, y, x, r) with radii and the mask.

    A weak seed goes to the strong one that the way to is shortest (ties: the first): it becomes a `process_peak` `into` it if both are one cell or the
    way has a neck, thin for long enough, else a `low_confidence_soma`, as it does without a strong one to go to. Of strong seeds, one after the other, each takes all
    later ones that are one cell with it and that no neck parts from it: those are `merged_into_strong`, `into` the first that could take them.
    For those that stay, `parted` and `unsure` name the other strong ones with and without a neck between, each once. Seeds off the mask or far from
    the skeleton, and those of other types, keep their type.
    """
    return decided(seeds, files.table(sk), files.table(placed(seeds, sk, mask, limits)), limits)


def decided(seeds: DataFrame, sk: DataFrame, at: DataFrame, limits: Limits) -> DataFrame:
    """What `resolved` makes of seeds that are `placed`; sk and at are read from tables."""
    key = ["image", "id"]
    near = files.table(pairs(at, limits.way))
    carried = near.withColumn("weak", (F.col("a_type") == "weak").cast("int"))
    met = files.table(necks(geodesics.ways_between(sk, carried, limits.way, ["weak", "b_score", "d2"], tables=True), limits))
    one, long_ = F.col("d2") <= limits.same**2, F.col("run") >= limits.run
    goal = met.where("weak = 1").groupBy("image", F.col("a").alias("id")).agg(F.min(F.struct("n", (-F.col("b_score")).alias("s"), "b", "d2", "neck", "run")).alias("g"))
    goal = goal.select(*key, "g.*").where(one | ((F.col("neck") < limits.demote) & long_)).select(*key, F.col("b").alias("peak_of"))
    strong = met.where("weak = 0").withColumn("necked", (F.col("neck") < limits.split) & long_)
    takes = strong.where(one & ~F.col("necked")).select("image", F.col("b").alias("id"), F.col("a").alias("for")).checkpoint()
    lost = spatial.lost_in_order(takes)
    gone = lambda c: lost.select("image", F.col("id").alias(c))
    score = at.select("image", F.col("id").alias("for"), "score")
    taken = takes.join(lost, key).join(gone("for"), ["image", "for"], "left_anti").join(score, ["image", "for"])
    taken = taken.groupBy(*key).agg(F.min(F.struct((-F.col("score")).alias("s"), "for")).alias("t")).select(*key, F.col("t.for").alias("taken_by"))
    stay = strong.join(gone("a"), ["image", "a"], "left_anti").join(gone("b"), ["image", "b"], "left_anti")
    ends = F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")), F.struct(F.col("b").alias("id"), F.col("a").alias("other")))
    beside = stay.select("image", "necked", F.explode(ends).alias("e")).groupBy("image", F.col("e.id").alias("id"))
    beside = beside.agg(*[F.array_sort(F.collect_set(F.when(c, F.col("e.other")))).alias(n) for n, c in (("parted", F.col("necked")), ("unsure", ~F.col("necked")))])
    out = seeds.select(*key, "type").join(at.select(*key, F.lit(True).alias("known")), key, "left").join(goal, key, "left").join(taken, key, "left").join(beside, key, "left")
    weak = F.when(F.col("peak_of").isNotNull(), "process_peak").otherwise("low_confidence_soma")
    kind = F.when(F.col("known") & (F.col("type") == "weak"), weak).when(F.col("taken_by").isNotNull(), "merged_into_strong").otherwise(F.col("type"))
    none = F.array().cast(beside.schema["parted"].dataType)
    return out.select(*key, kind.alias("type"), F.coalesce("peak_of", "taken_by").alias("into"), F.coalesce("parted", none).alias("parted"), F.coalesce("unsure", none).alias("unsure"))
