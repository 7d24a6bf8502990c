"""Radius and rectangle joins. Points meet in grid cells as wide as the radius, so a pair costs an equi-join, not a cross join."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import stacks


def _cells(df: DataFrame, radius: float, spread: bool) -> DataFrame:
    cy, cx = F.floor(F.col("yc") / radius), F.floor(F.col("xc") / radius)
    if not spread:
        return df.withColumn("cy", cy).withColumn("cx", cx)
    return df.withColumn("cy", F.explode(F.sequence(cy - 1, cy + 1))).withColumn("cx", F.explode(F.sequence(cx - 1, cx + 1)))


def near_pairs(a: DataFrame, b: DataFrame, radius: float, strict: bool = False) -> DataFrame:
    """(label_a, label_b, d2) of points(label, yc, xc) no farther apart than the radius."""
    left = _cells(a.select("label", "yc", "xc"), radius, True).select(F.col("label").alias("label_a"), F.col("yc").alias("ya"), F.col("xc").alias("xa"), "cy", "cx")
    right = _cells(b.select("label", "yc", "xc"), radius, False).select(F.col("label").alias("label_b"), F.col("yc").alias("yb"), F.col("xc").alias("xb"), "cy", "cx")
    d2 = (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb")) + (F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb"))
    joined = left.join(right, ["cy", "cx"]).select("label_a", "label_b", d2.alias("d2"))
    return joined.where(F.col("d2") < radius * radius if strict else F.col("d2") <= radius * radius)


def _places(points: DataFrame) -> DataFrame:
    """(yc, xc, label, n): the different places of points(label, yc, xc), with the least label and the number of points there."""
    return points.groupBy(F.col("yc").cast("double").alias("yc"), F.col("xc").cast("double").alias("xc")).agg(F.min("label").alias("label"), F.count("*").alias("n"))


def _met(a: DataFrame, b: DataFrame, radius: float, what: str, run) -> DataFrame:
    """(yc, xc, what) of the places of a: run(d2, near places of b) for a block of them, by cells as wide as the radius.

    A cell meets the places of b in the cells around it, so a task holds those of nine cells and no pair of points is ever a row.
    """
    near = _cells(_places(b), radius, True).withColumn("own", F.lit(False))
    here = _cells(_places(a), radius, False).withColumn("own", F.lit(True))

    def cells(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for i, j in zip(starts, np.append(starts[1:], len(f)), strict=True):
            c, own = f.iloc[i:j], f["own"].to_numpy()[i:j]
            mine, other = c[own], c[~own].sort_values("label", ignore_index=True)
            y, x = other["yc"].to_numpy(), other["xc"].to_numpy()
            block = max(1, stacks.CELLS // max(len(other), 1))
            for k in range(0, len(mine), block):
                m = mine.iloc[k : k + block]
                dy, dx = m["yc"].to_numpy()[:, None] - y, m["xc"].to_numpy()[:, None] - x
                out.append(m[["yc", "xc"]].assign(**run(dy * dy + dx * dx, other)))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({"yc": [], "xc": []} | {w.split()[0]: pd.Series(dtype="Int64") for w in what.split(", ")})

    return stacks.whole_groups(here.unionByName(near), ["cy", "cx"], cells, f"yc double, xc double, {what}")


def _at(points: DataFrame, found: DataFrame) -> DataFrame:
    """points with what was found at their places."""
    return points.withColumn("_y", F.col("yc").cast("double")).withColumn("_x", F.col("xc").cast("double")).join(found.withColumnsRenamed({"yc": "_y", "xc": "_x"}).hint("merge"), ["_y", "_x"], "left").drop("_y", "_x")


def without_near(candidates: DataFrame, accepted: DataFrame, radius: float) -> DataFrame:
    """Candidates with no accepted point closer than the radius."""
    hit = _met(candidates, accepted, radius, "hits long", lambda d2, b: {"hits": (d2 < radius * radius).sum(1)})
    return _at(candidates, hit).where("coalesce(hits, 0) = 0").drop("hits")


def nearest(a: DataFrame, b: DataFrame, radius: float) -> DataFrame:
    """For each of a the nearest of b within the radius, ties to the smaller label; null where there is none."""

    def first(d2: np.ndarray, near: pd.DataFrame) -> dict:
        if not len(near):
            return {"match": None, "d2": np.nan}
        d2 = np.where(d2 <= radius * radius, d2, np.inf)
        at = d2.argmin(1)  # the first has the least label
        best = d2[np.arange(len(d2)), at]
        match = near["label"].to_numpy().astype(object)[at]
        match[np.isinf(best)] = None
        return {"match": match, "d2": np.where(np.isinf(best), np.nan, best)}

    at = a.select("label", "yc", "xc")
    kind, d2 = b.schema["label"].dataType.simpleString(), at.select((F.col("yc") * F.col("xc")).alias("d2")).schema["d2"].dataType.simpleString()
    met = _at(at, _met(at, b, radius, f"match {kind}, d2 double", first)).where("match IS NOT NULL")
    best = met.groupBy("label").agg(F.min(F.struct("d2", "match")).alias("m"))
    return a.select("label").join(best, "label", "left").select("label", F.col("m.match").alias("match"), F.col("m.d2").cast(d2).alias("d2"))


def crowded(points: DataFrame, radius: float, least: int) -> DataFrame:
    """(label, n): points with at least so many others within the radius."""
    at = points.select("label", "yc", "xc")
    met = _met(at, at, radius, "n long", lambda d2, b: {"n": (d2 <= radius * radius) @ b["n"].to_numpy().astype(float)})
    # rows of one label don't count for each other
    same = at.join(at.select("label", F.col("yc").alias("y2"), F.col("xc").alias("x2")).hint("merge"), "label")
    near = (F.col("yc") - F.col("y2")) * (F.col("yc") - F.col("y2")) + (F.col("xc") - F.col("x2")) * (F.col("xc") - F.col("x2")) <= radius * radius
    both = _at(at, met).select("label", "n").union(same.where(near).select("label", F.lit(-1).cast("long")))
    return both.groupBy("label").agg(F.sum("n").alias("n")).where((F.col("n") >= least) & (F.col("n") > 0))


def _near(points: DataFrame, px: DataFrame, reach: int) -> DataFrame:
    """points(image, id, y, x) as (cy, cx) with the pixels of px in the square around their whole-numbered place, and how far (dy, dx) those are from it.

    Both meet in cells as wide as the square, of which a point lies in at most four: pixels aren't copied, and no square is written out.
    """
    wide = 2 * reach + 1
    low, high = lambda c: F.floor((F.floor(c) - reach) / wide), lambda c: F.floor((F.floor(c) + reach) / wide)
    at = points.select("image", "id", F.col("y").alias("cy"), F.col("x").alias("cx"), F.explode(F.sequence(low("y"), high("y"))).alias("ty"))
    at = at.select("*", F.explode(F.sequence(low("cx"), high("cx"))).alias("tx"))
    met = at.hint("merge").join(px.withColumns({"ty": F.floor(F.col("y") / wide), "tx": F.floor(F.col("x") / wide)}), ["image", "ty", "tx"])
    met = met.withColumns({"dy": F.col("y") - F.floor("cy"), "dx": F.col("x") - F.floor("cx")})
    return met.where((F.abs("dy") <= reach) & (F.abs("dx") <= reach)).drop("ty", "tx")


def _d2() -> Column:
    return (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")) + (F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx"))


def around_points(points: DataFrame, px: DataFrame, radius: int, inner: int, sectors: int) -> DataFrame:
    """(image, id, n, total, dirs): pixels and their sum in a disk around each point, and the different sectors that those at least `inner` away lie in."""
    near = _near(points, px.select("image", "y", "x", "v"), radius + 1).withColumn("d2", _d2()).where(F.col("d2") <= radius * radius)
    sector = F.floor((F.atan2(F.col("y") - F.col("cy"), F.col("x") - F.col("cx")) + F.pi()) / (2 * F.pi()) * sectors) % sectors
    got = near.groupBy("image", "id").agg(F.count("*").alias("n"), F.sum("v").alias("total"), F.countDistinct(F.when(F.col("d2") >= inner * inner, sector)).alias("dirs"))
    return points.select("image", "id").join(got, ["image", "id"], "left").fillna(0, ["n", "total", "dirs"])


def _middle(values: Column) -> Column:
    """The median of an array in order."""
    n = F.size(values)
    return (F.element_at(values, F.floor((n + 1) / 2).cast("int")) + F.element_at(values, F.floor(n / 2).cast("int") + 1)) / 2


def prominence(points: DataFrame, px: DataFrame, reach: int) -> DataFrame:
    """(image, id, prominence): the value nearest to each point against the median and its absolute deviation in a square around it."""
    near = _near(points, px.select("image", "y", "x", "v"), reach + 1).where((F.abs(F.col("y") - F.col("cy")) <= reach) & (F.abs(F.col("x") - F.col("cx")) <= reach))
    by = near.groupBy("image", "id").agg(F.array_sort(F.collect_list("v")).alias("vs"), F.min(F.struct(_d2().alias("d2"), "y", "x", "v")).alias("m"))
    by = by.select("image", "id", "vs", F.col("m.v").alias("here"), _middle(F.col("vs")).alias("med"))
    out = by.withColumn("mad", _middle(F.array_sort(F.transform("vs", lambda v: F.abs(v - F.col("med"))))))
    return out.select("image", "id", F.round((F.col("here") - F.col("med")) / (F.col("mad") + 1e-3), 6).alias("prominence"))


def nearest_pixel(points: DataFrame, px: DataFrame, reach: int) -> DataFrame:
    """(image, id, y, x): the first pixel that a square growing around each point meets, the nearest of those; none beyond reach."""
    near = _near(points, px.select("image", "y", "x"), reach)
    ring = F.greatest(F.abs("dy"), F.abs("dx")).alias("ring")
    return near.groupBy("image", "id").agg(F.min(F.struct(ring, _d2().alias("d2"), "y", "x")).alias("m")).select("image", "id", F.col("m.y").alias("y"), F.col("m.x").alias("x"))


def snapped(f: pd.DataFrame, starts: np.ndarray, goal: np.ndarray, point: np.ndarray, reach: int) -> pd.DataFrame:
    """f with sy, sx: where `point` is true the pixel with `goal` of its group that `nearest_pixel` finds, null for others."""
    steps = range(-reach, reach + 1)
    order = sorted((max(abs(dy), abs(dx)), dy * dy + dx * dx, dy, dx) for dy in steps for dx in steps)
    y, x, g = f["y"].to_numpy(), f["x"].to_numpy(), stacks.numbers(starts, len(f))
    ly, lx = y - np.minimum.reduceat(y, starts)[g] + reach, x - np.minimum.reduceat(x, starts)[g] + reach
    h, w = int(ly.max()) + reach + 1, int(lx.max()) + reach + 1
    code = (g * h + ly) * w + lx
    goals, open_ = np.sort(code[goal]), np.flatnonzero(point)
    found, none = np.zeros((2, len(f)), np.int64), np.ones(len(f), bool)
    for _, _, dy, dx in order if len(goals) else ():
        want = code[open_] + dy * w + dx
        hit = goals[np.minimum(np.searchsorted(goals, want), len(goals) - 1)] == want
        at, open_ = open_[hit], open_[~hit]
        found[:, at], none[at] = (y[at] + dy, x[at] + dx), False
    return f.assign(**{c: pd.arrays.IntegerArray(v, none.copy()) for c, v in zip(("sy", "sx"), found, strict=True)})


def outside_boxes(points: DataFrame, px: DataFrame, reach: int) -> DataFrame:
    """(image, id) of points without any pixel in the square around them."""
    hit = _near(points, px.select("image", "y", "x"), reach).select("image", "id").distinct()
    return points.select("image", "id").join(hit, ["image", "id"], "left_anti")


def ring_pixels(points: DataFrame, px: DataFrame, inner: int, outer: int) -> DataFrame:
    """(image, id, y, x): pixels from inner to outer away from each point."""
    d2 = _d2()
    return _near(points, px.select("image", "y", "x"), outer + 1).where((d2 >= inner * inner) & (d2 <= outer * outer)).select("image", "id", "y", "x")


def _window_medians(plane: np.ndarray, at: tuple[np.ndarray, np.ndarray, np.ndarray], reach: int) -> np.ndarray:
    """The median of what isn't NaN in the squares around these places of a stack."""
    g, y, x = at
    steps = range(-reach, reach + 1)
    seen = np.sort(np.stack([plane[g, y + dy, x + dx] for dy in steps for dx in steps], axis=1), axis=1)
    n, rows = (~np.isnan(seen)).sum(1), np.arange(len(seen))
    return (seen[rows, (n - 1) // 2] + seen[rows, n // 2]) / 2


def window_median(px: DataFrame, value: str, reach: int) -> DataFrame:
    """(image, y, x, median) of the values in the square around each pixel."""

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        med, v = np.empty(len(f)), f["v"].to_numpy(float)
        for rows, g, y, x, shape, _, _ in stacks.planes(f, starts, reach):
            plane = np.full(shape, np.nan)
            plane[g, y, x] = v[rows]
            med[rows] = _window_medians(plane, (g, y, x), reach)
        return f[["image", "y", "x"]].assign(median=med)[stacks.own(f) & ~np.isnan(med)]

    kind = px.schema["image"].dataType.simpleString()
    return stacks.whole_groups(stacks.spread(px.select("image", "y", "x", F.col(value).cast("double").alias("v")), reach), ["image", "ty", "tx"], run, f"image {kind}, y long, x long, median double")


def window_spread(px: DataFrame, reach: int) -> DataFrame:
    """(image, y, x, v, med, mad) of px(image, y, x, v): the median of the square around each pixel, and the median there of how far pixels are from their own."""

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        med, mad, v = np.empty(len(f)), np.empty(len(f)), f["v"].to_numpy(float)
        for rows, g, y, x, shape, _, _ in stacks.planes(f, starts, reach):
            plane = np.full(shape, np.nan)
            plane[g, y, x] = v[rows]
            med[rows] = _window_medians(plane, (g, y, x), reach)
            plane[g, y, x] = np.abs(v[rows] - med[rows])
            mad[rows] = _window_medians(plane, (g, y, x), reach)
        return f[["image", "y", "x", "v"]].assign(med=med, mad=mad)[stacks.own(f)]

    schema = f"image {px.schema['image'].dataType.simpleString()}, y long, x long, v {px.schema['v'].dataType.simpleString()}, med double, mad double"
    return stacks.whole_groups(stacks.spread(px.select("image", "y", "x", "v"), 2 * reach), ["image", "ty", "tx"], run, schema)


def suppressed(points: DataFrame, radius: float) -> DataFrame:
    """points(image, id, y, x, score) that stay if one after the other, from the highest score on (then the least id), is kept unless a kept one is nearer than radius.

    A point waits for those before it that are near. In a round all points that wait for none are kept, and those near them go; that is what the
    sequential order gives. Points meet in grid cells as wide as the radius; only pairs that are near are held, and of them only those still undecided.
    """
    cell = lambda c: F.floor(F.col(c) / radius)
    here = points.select("image", "id", "y", "x", "score").withColumn("cy", cell("y")).withColumn("cx", cell("x"))
    steps = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    other = here.select("image", F.col("id").alias("to"), F.col("y").alias("y2"), F.col("x").alias("x2"), F.col("score").alias("s2"), F.explode(steps).alias("o"), "cy", "cx")
    other = other.withColumn("cy", F.col("cy") + F.col("o.a")).withColumn("cx", F.col("cx") + F.col("o.b")).drop("o")
    near = (F.col("y") - F.col("y2")) * (F.col("y") - F.col("y2")) + (F.col("x") - F.col("x2")) * (F.col("x") - F.col("x2")) < radius * radius
    before = (F.col("s2") > F.col("score")) | ((F.col("s2") == F.col("score")) & (F.col("to") < F.col("id")))
    waits = here.join(other, ["image", "cy", "cx"]).where(near & before).select("image", "id", F.col("to").alias("for")).checkpoint()
    return points.join(lost_in_order(waits), ["image", "id"], "left_anti")


def lost_in_order(waits: DataFrame) -> DataFrame:
    """(image, id) of those that go if one after the other is kept unless a kept one before it stands in its way: waits(image, id, for), checkpointed, names
    for each all before it that would."""
    gone = waits.select("image", "id").limit(0).checkpoint()
    while not waits.isEmpty():
        open_ = waits.select("image", "id").distinct()
        kept = waits.select("image", F.col("for").alias("id")).distinct().join(open_, ["image", "id"], "left_anti")  # wait for none
        lost = waits.join(kept.select("image", F.col("id").alias("for")), ["image", "for"], "left_semi").select("image", "id").distinct().checkpoint()
        gone = gone.union(lost).checkpoint()
        # who is lost neither waits nor is waited for; who waits for none any more is kept
        waits = waits.join(lost, ["image", "id"], "left_anti").join(lost.select("image", F.col("id").alias("for")), ["image", "for"], "left_anti").checkpoint()
    return gone
