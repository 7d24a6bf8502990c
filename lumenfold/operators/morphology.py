"""Masks as relations of their true pixels: set algebra, dilation and erosion, holes, labels and what is counted by label."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import grid, stacks

KEY = ["image", "y", "x"]


def disk(radius: float) -> list[tuple[int, int]]:
    """Offsets of a disk, its centre included."""
    r = int(radius)
    return [(dy, dx) for dy in range(-r, r + 1) for dx in range(-r, r + 1) if dy * dy + dx * dx <= radius * radius]


def _inside(side: int) -> Column:
    return F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1)


def dilated(mask: DataFrame, offsets: list[tuple[int, int]], side: int) -> DataFrame:
    """Pixels of the plane that an offset reaches from a pixel of the mask."""
    far = max(max(abs(dy), abs(dx)) for dy, dx in offsets)

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for rows, g, y, x, shape, y0, x0 in stacks.planes(f, starts, far):
            plane, first = np.zeros(shape, bool), f.iloc[rows.start + np.flatnonzero(np.diff(g, prepend=-1))]
            for dy, dx in offsets:
                plane[g, y + dy, x + dx] = True
            k, y, x = np.nonzero(plane)
            found = pd.DataFrame({"image": first["image"].to_numpy()[k], "y": y + y0[k], "x": x + x0[k], "ty": first["ty"].to_numpy()[k], "tx": first["tx"].to_numpy()[k]})
            out.append(found[stacks.own(found)][KEY])
        found = pd.concat(out, ignore_index=True)
        return found[found["y"].between(0, side - 1) & found["x"].between(0, side - 1)]

    return stacks.whole_groups(stacks.spread(mask.select(*KEY), far), ["image", "ty", "tx"], run, f"image {mask.schema['image'].dataType.simpleString()}, y long, x long")


def eroded(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    """Pixels of the mask from which every offset stays in it; beyond the plane there is none."""
    return grid.counted(mask, offsets).where(F.col("n") == len(offsets)).select(*KEY)


def closed(mask: DataFrame, offsets: list[tuple[int, int]], side: int) -> DataFrame:
    return eroded(dilated(mask, offsets, side), offsets)


def union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).union(b.select(*KEY)).distinct()


def without(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).join(b.select(*KEY), KEY, "left_anti")


def within(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select(*KEY).join(b.select(*KEY), KEY, "left_semi")


def filled(mask: DataFrame, side: int) -> DataFrame:
    """The mask and its holes: 4-connected parts of the background that don't touch the edge of the plane. Planes no larger than a tile are filled in a task."""
    if side <= stacks.TILE:
        return _filled_whole(mask, side)
    axis = F.sequence(F.lit(0).cast("long"), F.lit(side - 1).cast("long"))
    plane = mask.select("image").distinct().select("image", F.explode(axis).alias("y")).select("image", "y", F.explode(axis).alias("x"))
    labelled = grid.components(without(plane, mask), grid.OFFSETS4)
    edge = F.col("y").isin(0, side - 1) | F.col("x").isin(0, side - 1)
    inner = labelled.groupBy("image", "label").agg(F.bool_or(edge).alias("open")).where("not open")
    return mask.select(*KEY).union(labelled.join(inner, ["image", "label"], "left_semi").select(*KEY))


def _filled_whole(mask: DataFrame, side: int) -> DataFrame:
    def run(f: pd.DataFrame, _: np.ndarray) -> pd.DataFrame:
        out, f = [f[KEY]], f.dropna(subset=KEY).astype({"y": "int64", "x": "int64"})
        f = f[f["y"].between(0, side - 1) & f["x"].between(0, side - 1)]
        starts = stacks._starts(f, ["image"])
        for rows, g, y, x, shape, y0, x0 in stacks.planes(f, starts, 1) if len(f) else ():
            plane, first = np.zeros(shape, bool), f["image"].to_numpy()[rows][np.flatnonzero(np.diff(g, prepend=-1))]
            plane[g, y, x] = True
            k, y, x = np.nonzero(~plane)
            parts = grid.labelled(pd.DataFrame({"k": k, "y": y, "x": x}), np.flatnonzero(np.diff(k, prepend=-1)), grid.OFFSETS4, 1 << 20)
            parts = parts[parts["label"] != 0]  # what isn't connected with the rim around all pixels
            k = parts["k"].to_numpy()
            out.append(pd.DataFrame({"image": first[k], "y": parts["y"].to_numpy() + y0[k], "x": parts["x"].to_numpy() + x0[k]}))
        return pd.concat(out, ignore_index=True)

    kind = mask.schema["image"].dataType.simpleString()
    return stacks.whole_groups(mask.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x")), ["image"], run, f"image {kind}, y long, x long")


def junction_clusters(mask: DataFrame, radius: float, side: int) -> DataFrame:
    """(image, y, x, cluster): pixels with three or more neighbours, clustered where disks around them join."""
    joints = grid.degree(mask).where("degree >= 3").select(*KEY).checkpoint()
    wide = grid.components(dilated(joints, disk(radius), side)).withColumnRenamed("label", "cluster")
    return joints.hint("merge").join(wide, KEY)


def clusters_by_label(labelled: DataFrame, clusters: DataFrame) -> DataFrame:
    """(image, label, n_clusters): different junction clusters on each labelled component, 0 where there are none."""
    met = labelled.join(clusters, KEY).groupBy("image", "label").agg(F.countDistinct("cluster").alias("n_clusters"))
    return labelled.select("image", "label").distinct().join(met, ["image", "label"], "left").fillna(0, ["n_clusters"])


def touching(labelled: DataFrame, mask: DataFrame) -> DataFrame:
    """(image, label) of components that share a pixel with the mask."""
    return labelled.join(mask.select(*KEY), KEY, "left_semi").select("image", "label").distinct()


def label_values(labelled: DataFrame, px: DataFrame) -> DataFrame:
    """(image, label, n, mean, median) of px.v by label; -1 where a label has no valued pixel."""
    by = labelled.join(px.select(*KEY, "v"), KEY, "left").groupBy("image", "label")
    return by.agg(F.count("*").alias("n"), F.round(F.coalesce(F.avg("v"), F.lit(-1.0)), 6).alias("mean"), F.coalesce(F.median("v"), F.lit(-1.0)).alias("median"))


def gathered(px: DataFrame, labelled: DataFrame, by_label: DataFrame, value: str) -> DataFrame:
    """px with its label (0: background) and that label's value (0 for the background), by a join on the label."""
    known = labelled.join(by_label.select("image", "label", value), ["image", "label"])
    return px.select(*KEY).join(known, KEY, "left").fillna(0, ["label", value])


def gap_fraction(labelled: DataFrame, px: DataFrame, share: float = 0.2) -> DataFrame:
    """(image, gap): share of labelled pixels dimmer than that share of their own component's median."""
    valued = labelled.join(px.select(*KEY, "v"), KEY)
    med = valued.groupBy("image", "label").agg(F.median("v").alias("med"))
    return valued.join(med, ["image", "label"]).groupBy("image").agg(F.round(F.avg((F.col("v") < share * F.col("med")).cast("int")), 6).alias("gap"))


def web_kept(labelled: DataFrame, px: DataFrame, anchors: DataFrame, clusters: DataFrame, sigma: float, max_size: int, bright: float = 10.0) -> DataFrame:
    """Labelled pixels without speckle webs: components that aren't anchored, are small, have a junction cluster and are dim."""
    stats = clusters_by_label(labelled, clusters).join(label_values(labelled, px), ["image", "label"])
    held = touching(labelled, anchors).withColumn("anchored", F.lit(True))
    web = F.col("anchored").isNull() & (F.col("n") < max_size) & (F.col("n_clusters") >= 1) & (F.col("median") < bright * sigma)
    gone = stats.join(held, ["image", "label"], "left").where(web).select("image", "label")
    return labelled.join(gone, ["image", "label"], "left_anti").select(*KEY, "label")


def moments(labelled: DataFrame) -> DataFrame:
    """(image, label, area, ecc): eccentricity of the ellipse with the component's second moments, a pixel being a unit square."""
    by = labelled.groupBy("image", "label").agg(F.count("*").alias("area"), (F.var_pop("y") + 1 / 12).alias("a"), (F.var_pop("x") + 1 / 12).alias("b"), F.covar_pop("y", "x").alias("c"))
    root = F.sqrt((F.col("a") - F.col("b")) * (F.col("a") - F.col("b")) / 4 + F.col("c") * F.col("c"))
    big, small = (F.col("a") + F.col("b")) / 2 + root, (F.col("a") + F.col("b")) / 2 - root
    return by.select("image", "label", "area", F.round(F.sqrt(F.greatest(F.lit(0.0), 1 - small / big)), 6).alias("ecc"))


def outside(f: pd.DataFrame, starts: np.ndarray, side: int, reach: int) -> np.ndarray:
    """The squared distance of each row of f to the nearest pixel of the plane that its group doesn't have, 0 where none is nearer than reach + 1."""
    # the farthest first, so that nearer ones overwrite them
    steps = sorted(((dy * dy + dx * dx, dy, dx) for dy, dx in disk(reach) if dy or dx), reverse=True)
    d2 = np.zeros(len(f), np.int64)
    for rows, g, y, x, shape, y0, x0 in stacks.planes(f, starts, reach):
        row, column = y0[:, None] + np.arange(shape[1]), x0[:, None] + np.arange(shape[2])
        none = ((row >= 0) & (row < side))[:, :, None] & ((column >= 0) & (column < side))[:, None]
        none[g, y, x] = False
        least = d2[rows]
        for n, dy, dx in steps:
            least[none[g, y + dy, x + dx]] = n
    return d2


def far_outside(a: np.ndarray) -> np.ndarray:
    """The squared distance of each pixel of a stack of boolean planes to the nearest one that is False, however far; infinite where a plane has none."""
    vertical = np.full(a.shape, np.inf)
    for rows in (range(a.shape[1]), range(a.shape[1])[::-1]):
        run = np.full((a.shape[0], a.shape[2]), np.inf)
        for y in rows:
            run = np.where(a[:, y], run + 1, 0)
            vertical[:, y] = np.minimum(vertical[:, y], run)
    vertical **= 2
    d2 = vertical.copy()
    for k in range(1, a.shape[2]):
        if k * k >= d2.max(initial=0):  # nothing is nearer than that from so many columns off
            break
        np.minimum(d2[:, :, k:], vertical[:, :, :-k] + k * k, out=d2[:, :, k:])
        np.minimum(d2[:, :, :-k], vertical[:, :, k:] + k * k, out=d2[:, :, :-k])
    return d2


def distances(mask: DataFrame, side: int, reach: int, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(image, y, x, keep, d2): squared distance to the nearest pixel outside the mask (beyond the plane is none), for those nearer than reach + 1; others have none."""

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return f[[*KEY, *keep]].assign(d2=outside(f, starts, side, reach))[stacks.own(f)]

    near = stacks.whole_groups(stacks.spread(mask.select(*KEY, *keep), reach), ["image", "ty", "tx"], run, f"image {mask.schema['image'].dataType.simpleString()}, y long, x long{grid.kept(mask, keep)}, d2 int")
    return near.select(*KEY, *keep, F.nullif("d2", F.lit(0)).alias("d2"))


def exact_distances(mask: DataFrame, rows: int, columns: int) -> DataFrame:
    """(image, y, x, d2): squared distance of each pixel to the nearest one of the plane outside the mask, however far; null where the plane has none.

    Down a column it follows from the ends of the run the pixel is in; along a row the least of those distances with the offset to them is taken, within
    the pixel's run and to the background at its ends, behind which nothing can be nearer. Only pixels of the mask are held.
    """
    px = mask.select(*KEY).distinct()
    column = Window.partitionBy("image", "x")
    runs = px.withColumn("run", F.col("y") - F.row_number().over(column.orderBy("y")))
    ends = Window.partitionBy("image", "x", "run")
    up = F.when(F.min("y").over(ends) > 0, F.col("y") - F.min("y").over(ends) + 1)
    down = F.when(F.max("y").over(ends) < rows - 1, F.max("y").over(ends) - F.col("y") + 1)
    vertical = runs.withColumn("g", F.least(up, down)).select(*KEY, F.col("g").cast("double").alias("g"))

    def across(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(["y", "x"], ignore_index=True)
        x, g2 = f["x"].to_numpy(), f["g"].fillna(np.inf).to_numpy() ** 2
        best = np.full(len(x), np.inf)
        cuts = np.flatnonzero((np.diff(x) != 1) | (np.diff(f["y"].to_numpy()) != 0)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)], strict=True):
            sites = [(x[a:b], g2[a:b])] + [([at], [0.0]) for at in (x[a] - 1, x[b - 1] + 1) if 0 <= at < columns]
            at, cost = (np.concatenate(c) for c in zip(*sites, strict=True))
            at, cost = at[np.isfinite(cost)], cost[np.isfinite(cost)]
            for k in range(a, b, 256):  # a block of pixels against the run's sites
                if len(at):
                    best[k : min(b, k + 256)] = ((x[k : min(b, k + 256), None] - at[None]) ** 2 + cost[None]).min(1)
        return pd.DataFrame({"image": f["image"], "y": f["y"], "x": x, "d2": pd.array([int(v) if np.isfinite(v) else None for v in best], dtype="Int64")})

    kind = mask.schema["image"].dataType.simpleString()
    return vertical.groupBy("image", F.floor(F.col("y") / 64)).applyInPandas(across, f"image {kind}, y long, x long, d2 long")


def mode_label(points: DataFrame, labelled: DataFrame, reach: int = 2) -> DataFrame:
    """points(image, id, y, x) as (image, id, label): the commonest label around the rounded place (halves to even), the least on ties, 0 if there is none."""
    at = points.select("image", "id", F.bround("y").cast("long").alias("y"), F.bround("x").cast("long").alias("x"))
    box = [(dy, dx) for dy in range(-reach, reach + 1) for dx in range(-reach, reach + 1)]
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in box])
    seen = at.select("image", "id", F.explode(steps).alias("o"), "y", "x").select("image", "id", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"))
    votes = seen.join(labelled, KEY).groupBy("image", "id", "label").agg(F.count("*").alias("n"))
    best = votes.groupBy("image", "id").agg(F.min(F.struct((-F.col("n")).alias("n"), "label")).alias("m")).select("image", "id", F.col("m.label").alias("label"))
    return points.select("image", "id").join(best, ["image", "id"], "left").fillna(0, ["label"])


def nearest_label(px: DataFrame, labelled: DataFrame, reach: int) -> DataFrame:
    """(image, y, x, label, d2): of each pixel the nearest labelled one within reach (ties: the least label); none without."""
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in disk(reach)])
    spread = labelled.select("image", "y", "x", "label", F.explode(steps).alias("o"))
    d2 = (F.col("o.dy") * F.col("o.dy") + F.col("o.dx") * F.col("o.dx")).alias("d2")
    near = spread.select("image", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.struct(d2, "label").alias("s")).groupBy(*KEY).agg(F.min("s").alias("m"))
    return px.select(*KEY).join(near, KEY).select(*KEY, F.col("m.label").alias("label"), F.col("m.d2").alias("d2"))


def adjacent(labelled: DataFrame, clusters: DataFrame) -> DataFrame:
    """(image, label, cluster): pairs in which a pixel of the one is beside one of the other (4 neighbours, or the same pixel)."""
    return grid.beside(labelled, "label", clusters, "cluster", [(0, 0), *grid.OFFSETS4]).select("image", "label", "cluster").distinct()
