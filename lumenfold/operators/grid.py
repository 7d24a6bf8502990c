"""Pixels as sparse relations: tiles, windows, neighbours, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import stacks

OFFSETS8 = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1) if dy or dx]
OFFSETS4 = [(-1, 0), (1, 0), (0, -1), (0, 1)]


def tiles(px: DataFrame, size: int) -> DataFrame:
    return px.groupBy("image", F.floor(F.col("y") / size).alias("ty"), F.floor(F.col("x") / size).alias("tx")).agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def windows(px: DataFrame, size: int, stride: int, extent: int) -> DataFrame:
    """Overlapping windows [k stride, k stride + size) inside the extent: a pixel goes to each that covers it."""
    last = (extent - size) // stride
    cover = lambda c: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - size) / stride) + 1), F.least(F.lit(last), F.floor(F.col(c) / stride)))
    inside = px.where((F.floor(F.col("y") / stride) >= 0) & (F.col("y") < last * stride + size) & (F.col("x") < last * stride + size))
    return inside.withColumn("wy", F.explode(cover("y"))).withColumn("wx", F.explode(cover("x"))).groupBy("image", "wy", "wx").agg(F.count("*").alias("n"), F.sum("v").alias("total"))


def _around(mask: DataFrame, offsets: list[tuple[int, int]]) -> DataFrame:
    steps = F.array(*[F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy, dx in offsets])
    return mask.select("image", "y", "x", F.explode(steps).alias("o")).select("image", (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.col("y").alias("y0"), F.col("x").alias("x0"))


def kept(df: DataFrame, keep: list[str]) -> str:
    """The columns of df that go through a task as they are, for its schema."""
    return "".join(f", {n} {df.schema[n].dataType.simpleString()}" for n in keep)


def neighbours(f: pd.DataFrame, starts: np.ndarray, offsets: list[tuple[int, int]], name: str) -> pd.DataFrame:
    """Rows of f without repeated pixels, with how many other offsets lead to each of them within its group."""
    order, found = stacks.around(f, starts, [(-dy, -dx) for dy, dx in offsets])
    return f.iloc[order].assign(**{name: sum((at >= 0).astype(np.int64) for at in found)})


def counted(mask: DataFrame, offsets: list[tuple[int, int]], name: str = "n", keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(image, y, x, keep, name): of each pixel of the mask from how many other offsets lead to it. Tiles know what is around them, so nothing is multiplied by offsets."""

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        f = neighbours(f, starts, offsets, name)
        return f[["image", "y", "x", *keep, name]][stacks.own(f)]

    px = mask.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *keep)
    reach = max(max(abs(dy), abs(dx)) for dy, dx in offsets)
    return stacks.whole_groups(stacks.spread(px, reach), ["image", "ty", "tx"], run, f"image {px.schema['image'].dataType.simpleString()}, y long, x long{kept(px, keep)}, {name} long")


def degree(mask: DataFrame, offsets: list[tuple[int, int]] = OFFSETS8, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(image, y, x, keep, degree): neighbours in the mask."""
    return counted(mask, offsets, "degree", keep)


def beside(a: DataFrame, left: str, b: DataFrame, right: str, offsets: list[tuple[int, int]]) -> DataFrame:
    """(image, y0, x0, y, x, left, right): pixels of a(image, y, x, left) with those of b(image, y, x, right) that an offset leads to from them. Tiles hold both."""
    side = lambda df, name, is_left: df.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(name).alias("name"), F.lit(is_left).alias("is_left"))
    far = max(max(abs(dy), abs(dx)) for dy, dx in offsets)

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        y, x, g = f["y"].to_numpy(), f["x"].to_numpy(), stacks.numbers(starts, len(f))
        ly, lx = y - np.minimum.reduceat(y, starts)[g] + far, x - np.minimum.reduceat(x, starts)[g] + far
        h, w = int(ly.max()) + far + 1, int(lx.max()) + far + 1
        code, is_left = (g * h + ly) * w + lx, f["is_left"].to_numpy(bool)
        here, there = np.flatnonzero(is_left & stacks.own(f)), np.flatnonzero(~is_left)
        there = there[np.argsort(code[there], kind="stable")]
        one, other = [here[:0]], [here[:0]]
        for dy, dx in offsets:
            want = code[here] + dy * w + dx
            first, last = np.searchsorted(code[there], want), np.searchsorted(code[there], want, side="right")
            n = last - first
            one.append(np.repeat(here, n))
            other.append(there[np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())])
        i, j = np.concatenate(one), np.concatenate(other)
        label = f["name"].to_numpy()
        return pd.DataFrame({"image": f["image"].to_numpy()[i], "y0": y[i], "x0": x[i], "y": y[j], "x": x[j], "name": label[i], "other": label[j]})

    both = stacks.spread(side(a, left, True).union(side(b, right, False)), far)
    kind, name = both.schema["image"].dataType.simpleString(), both.schema["name"].dataType.simpleString()
    met = stacks.whole_groups(both, ["image", "ty", "tx"], run, f"image {kind}, y0 long, x0 long, y long, x long, name {name}, other {name}")
    return met.withColumnsRenamed({"name": left, "other": right})


def labelled(f: pd.DataFrame, starts: np.ndarray, offsets: list[tuple[int, int]], width: int) -> pd.DataFrame:
    """Labels the pixels of each group by themselves: every pixel takes the least number among its neighbours, then its number's own, until nothing changes."""
    order, found = stacks.around(f, starts, [o for o in offsets if o > (0, 0)])
    here = np.arange(len(order))
    a, b = np.concatenate([here[at >= 0] for at in found]), np.concatenate([at[at >= 0] for at in found])
    label = here.copy()
    while len(a):
        least = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], least)  # the least number goes to the roots of both
        np.minimum.at(label, label[b], least)
        while (label[label] != label).any():
            label = label[label]
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    f = f.iloc[order]
    y, x = f["y"].to_numpy(), f["x"].to_numpy()
    return f.assign(label=y[label] * width + x[label])


def components(mask: DataFrame, offsets: list[tuple[int, int]] = OFFSETS8, width: int = 1 << 20, tile: int = 256, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(image, y, x, keep, label): label is the least y * width + x of the pixel's component.

    Pixels are labelled tile by tile. Labels that meet where tiles do are edges of a graph, and only that graph, which has no more nodes than
    tiles have components at their borders, takes rounds of least labels, each of them checkpointed.
    """
    px = mask.select("image", F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), *keep)
    tiled = px.withColumns({"ty": F.floor(F.col("y") / tile), "tx": F.floor(F.col("x") / tile)})
    label = lambda f, starts: labelled(f, starts, offsets, width)[["image", "y", "x", *keep, "label"]]
    local = stacks.whole_groups(tiled, ["image", "ty", "tx"], label, f"image {px.schema['image'].dataType.simpleString()}, y long, x long{kept(px, keep)}, label long").checkpoint()
    # where all pixels are in tiles of one number no two tiles meet
    ends = [f(F.floor(F.col(c) / tile)).alias(f"{n}{c}") for c in "yx" for n, f in (("low", F.min), ("high", F.max))]
    reach = local.agg(*ends).first()
    if reach["lowy"] == reach["highy"] and reach["lowx"] == reach["highx"]:
        return local
    rim = local.where((F.pmod("y", F.lit(tile)) % (tile - 1) == 0) | (F.pmod("x", F.lit(tile)) % (tile - 1) == 0))
    beside = _around(rim, offsets).where((F.floor(F.col("y") / tile) != F.floor(F.col("y0") / tile)) | (F.floor(F.col("x") / tile) != F.floor(F.col("x0") / tile)))
    ends = beside.join(rim.select("image", "y", "x", F.col("label").alias("to")), ["image", "y", "x"])
    ends = ends.join(rim.select("image", F.col("y").alias("y0"), F.col("x").alias("x0"), F.col("label").alias("id")), ["image", "y0", "x0"])
    edges = ends.select("image", "id", "to").distinct().checkpoint()
    roots = least_labels(edges).select("image", F.col("id").alias("label"), F.col("label").alias("root"))
    return local.join(roots, ["image", "label"], "left").select("image", "y", "x", *keep, F.coalesce("root", "label").alias("label"))


def least_labels(edges: DataFrame) -> DataFrame:
    """(image, id, label) of a graph with edges(image, id, to) in both directions: label is the least id of the node's component.

    In a round every node takes the least label among its neighbours, then that label's own, so the number of rounds follows the logarithm of
    a component's diameter where labels run along it. Rounds are checkpointed.
    """
    state = edges.select("image", "id").distinct().withColumn("label", F.col("id"))
    moving = not edges.isEmpty()
    while moving:
        near = edges.join(state.select("image", F.col("id").alias("to"), "label"), ["image", "to"]).groupBy("image", "id").agg(F.min("label").alias("near"))
        new = state.join(near, ["image", "id"]).select("image", "id", F.col("label").alias("old"), F.least("label", "near").alias("label"))
        up = new.select("image", F.col("id").alias("label"), F.col("label").alias("above"))
        new = new.join(up, ["image", "label"]).select("image", "id", "old", F.col("above").alias("label")).checkpoint()
        state, moving = new.select("image", "id", "label"), not new.where("old <> label").isEmpty()
    return state


def component_features(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy("image", "label").agg(F.count("*").alias("area"), F.round(F.avg("y"), 6).alias("yc"), F.round(F.avg("x"), 6).alias("xc"), (F.max("y") - F.min("y") + 1).alias("height"), (F.max("x") - F.min("x") + 1).alias("width"))


def hysteresis(px: DataFrame, low: float, high: float) -> DataFrame:
    """Pixels of components of v >= low that hold a pixel of v >= high."""
    weak = px.where(F.col("v") >= low)
    labelled = components(weak).join(weak, ["image", "y", "x"])
    strong = labelled.where(F.col("v") >= high).select("image", "label").distinct()
    return labelled.join(strong, ["image", "label"], "left_semi")
