"""Filters of planes on tiles with a halo: a pixel goes to every tile that needs it, a tile is filtered by itself, and only its inner part is kept.

Planes are relations (image, y, x, v) of their pixels other than 0, all of one size. A tile with its halo is all that a task holds of a plane, and
results don't depend on how large tiles are. Beyond the plane's edge pixels are reflected, the outermost first. Tiles of one shape go through a kernel as a
stack, so kernels work along the last two axes. Where a tile would hold the whole plane in its halo, the plane is one tile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenfold.operators import morphology as mo
from lumenfold.operators import stacks
from lumenfold.operators.grid import OFFSETS4, OFFSETS8, labelled

Plane = np.ndarray
#: Standard deviations at which kernels end.
REACH, SMOOTH_REACH = 8.0, 4.0


def _tile(shape: tuple[int, int], halo: int, tile: int) -> int:
    return max(shape) if tile + 2 * halo >= max(shape) else tile


def dealt(px: DataFrame, shape: tuple[int, int], halo: int, tile: int) -> DataFrame:
    """px with the tile (ty, tx) of every tile that has it in its inner part or its halo."""
    tiles = lambda c, n: F.sequence(F.greatest(F.lit(0), F.floor((F.col(c) - halo) / tile)), F.least(F.lit((n - 1) // tile), F.floor((F.col(c) + halo) / tile)))
    inside = px.where(F.col("y").between(0, shape[0] - 1) & F.col("x").between(0, shape[1] - 1))
    return inside.withColumn("ty", F.explode(tiles("y", shape[0]))).withColumn("tx", F.explode(tiles("x", shape[1])))


@dataclass
class Tiles:
    """Tiles of one shape and one place against the plane's edges: their pixels within the plane, where they begin (`at`, `inner`: arrays of rows and columns), how
    much is missing on either side, how far off `at` the inner part is, and how large."""

    number: np.ndarray
    plane: Plane
    at: np.ndarray
    inner: np.ndarray
    missing: list[tuple[int, int]]
    off: list[int]
    size: list[int]


def _tiles(f: pd.DataFrame, starts: np.ndarray, shape: tuple[int, int], halo: int, tile: int) -> Iterator[Tiles]:
    inner = f[["ty", "tx"]].to_numpy()[starts] * tile
    low, high = np.maximum(0, inner - halo), np.minimum(shape, inner + tile + halo)
    kinds, of = np.unique(np.concatenate([low - inner, high - inner, np.minimum(tile, shape - inner)], axis=1), axis=0, return_inverse=True)
    g, y, x, v = stacks.numbers(starts, len(f)), f["y"].to_numpy(), f["x"].to_numpy(), f["v"].to_numpy()
    for k, kind in enumerate(kinds):
        (a, b), (c, d), size = kind[:2], kind[2:4], kind[4:].tolist()
        which = np.flatnonzero(of.ravel() == k)
        many = max(1, stacks.CELLS // ((tile + 2 * halo) ** 2))
        missing = [(int(n + halo), int(t + halo - e)) for n, e, t in zip((a, b), (c, d), size, strict=True)]
        for m in range(0, len(which), many):
            w = which[m : m + many]
            number = np.full(len(starts), -1)
            number[w] = np.arange(len(w))
            rows = np.flatnonzero(number[g] >= 0)
            plane = np.zeros((len(w), int(c - a), int(d - b)))
            plane[number[g[rows]], y[rows] - low[g[rows], 0], x[rows] - low[g[rows], 1]] = v[rows]
            yield Tiles(starts[w], plane, low[w], inner[w], missing, [int(-a), int(-b)], size)


def _padded(t: Tiles, **mode) -> Plane:
    return np.pad(t.plane, [(0, 0), *t.missing], **mode)


def _inner(a: Plane, t: Tiles, halo: int) -> Plane:
    return a[:, halo : halo + t.size[0], halo : halo + t.size[1]]


def _places(f: pd.DataFrame, t: Tiles, keep: Plane) -> tuple[tuple[np.ndarray, ...], dict]:
    """Where inner parts hold something: in the stack, and as columns."""
    at = np.nonzero(keep)
    return at, {"image": f["image"].to_numpy()[t.number[at[0]]], "y": at[1] + t.inner[at[0], 0], "x": at[2] + t.inner[at[0], 1]}


def filtered(px: DataFrame, kernel: Callable[[Plane], Plane | tuple[Plane, ...]], names: list[str], shape: tuple[int, int], halo: int, tile: int = 256) -> DataFrame:
    """(image, y, x, names double): what kernel makes of the plane, where one of the values isn't 0. The kernel looks at most `halo` pixels away, and
    makes 0 of nothing but 0."""
    tile = _tile(shape, halo, tile)

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for t in _tiles(f, starts, shape, halo, tile):
            found = kernel(_padded(t, mode="symmetric"))
            parts = [_inner(v, t, halo) for v in (found if isinstance(found, tuple) else (found,))]
            at, columns = _places(f, t, np.any([p != 0 for p in parts], axis=0))
            out.append(pd.DataFrame(columns | {n: p[at] for n, p in zip(names, parts, strict=True)}))
        return pd.concat(out, ignore_index=True)

    schema = f"image {px.schema['image'].dataType.simpleString()}, y long, x long, " + ", ".join(f"{n} double" for n in names)
    return stacks.whole_groups(dealt(px.select("image", "y", "x", "v"), shape, halo, tile), ["image", "ty", "tx"], run, schema)


def _wider(a: Plane, r: int, axis: int) -> Plane:
    """The outermost pixels go on for r at both ends of an axis of planes, 0 or 1."""
    return np.pad(a, [(r, r) if i == a.ndim - 2 + axis else (0, 0) for i in range(a.ndim)], mode="edge")


def _part(a: Plane, k: int, n: int, axis: int) -> Plane:
    return a[..., k : k + n, :] if axis == 0 else a[..., k : k + n]


def along(a: Plane, weights: np.ndarray, axis: int) -> Plane:
    """Correlation with an odd number of weights along an axis; the outermost pixel goes on."""
    r, n = len(weights) // 2, a.shape[axis - 2]
    wide = _wider(a, r, axis)
    return sum(w * _part(wide, k, n, axis) for k, w in enumerate(weights))


def gaussian(sigma: float, reach: float = SMOOTH_REACH) -> np.ndarray:
    r = int(reach * sigma + 0.5)
    w = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    return w / w.sum()


def smoothed(a: Plane, sigma: float, reach: float = SMOOTH_REACH) -> Plane:
    return along(along(a, gaussian(sigma, reach), 0), gaussian(sigma, reach), 1)


def hessian(a: Plane, sigma: float) -> tuple[Plane, Plane]:
    """The greater and the smaller eigenvalue of the second derivatives at this scale: first derivatives of a Gaussian of sigma / sqrt 2, taken twice."""
    s = sigma / math.sqrt(2)
    g = gaussian(s, REACH)
    slope = g * (np.arange(len(g)) - len(g) // 2) / s**2
    dy, dx = along(along(a, slope, 0), g, 1), along(along(a, g, 0), slope, 1)
    yy, xx, yx = along(along(dy, slope, 0), g, 1), along(along(dx, g, 0), slope, 1), along(along(dy, g, 0), slope, 1)
    mean, root = (yy + xx) / 2, np.sqrt(((yy - xx) / 2) ** 2 + yx**2)
    return mean + root, mean - root


def hessian_halo(sigma: float) -> int:
    return 2 * int(REACH * sigma / math.sqrt(2) + 0.5)


def ridges(px: DataFrame, sigma: float, shape: tuple[int, int], tile: int = 256) -> DataFrame:
    """(image, y, x, ridge): how much of a bright line of this width a pixel is on: sigma squared times the steepest curvature down, where there is one."""
    kernel = lambda a: np.round(np.maximum(-hessian(a, sigma)[1], 0) * sigma**2, 9)
    return filtered(px, kernel, ["ridge"], shape, hessian_halo(sigma), tile)


def blobs_and_tubes(px: DataFrame, sigma: float, shape: tuple[int, int], tile: int = 256) -> DataFrame:
    """(image, y, x, blob, tube): where the surface curves down on both axes the ratio of the flatter to the steeper curvature (1: round), and 1 less that."""

    def kernel(a: Plane) -> tuple[Plane, Plane]:
        big, small = hessian(a, sigma)
        down = big <= -1e-6
        blob = np.where(down, big / np.where(down, small, 1), 0)
        return np.round(blob, 9), np.round(np.where(down, 1 - blob, 0), 9)

    return filtered(px, kernel, ["blob", "tube"], shape, hessian_halo(sigma), tile)


def _sliding(a: Plane, r: int, axis: int, pick: Callable) -> Plane:
    """The least, or greatest, of the 2 r + 1 pixels around each along an axis, by windows that double."""
    if not r:
        return a
    n = a.shape[axis - 2]
    wide = _wider(a, r, axis)
    at = lambda x, k, m: _part(x, k, m, axis)
    width = 1
    while 2 * width <= 2 * r + 1:
        m = wide.shape[axis - 2] - width
        wide, width = pick(at(wide, 0, m), at(wide, width, m)), 2 * width
    return pick(at(wide, 0, n), at(wide, 2 * r + 1 - width, n))


def _over_disk(a: Plane, r: int, pick: Callable) -> Plane:
    out = None
    for dy in range(-r, r + 1):
        row = _sliding(a, math.isqrt(r * r - dy * dy), 1, pick)
        wide = _part(_wider(row, r, 0), r + dy, a.shape[-2], 0)
        out = wide if out is None else pick(out, wide)
    return out


def opened(a: Plane, r: int, round_: bool) -> Plane:
    """Grey opening: the greatest of the least over a disk, or a square."""
    if round_:
        return _over_disk(_over_disk(a, r, np.minimum), r, np.maximum)
    least = _sliding(_sliding(a, r, 0, np.minimum), r, 1, np.minimum)
    return _sliding(_sliding(least, r, 0, np.maximum), r, 1, np.maximum)


def top_hat(px: DataFrame, r: int, shape: tuple[int, int], tile: int = 256) -> DataFrame:
    """(image, y, x, v): what is above the opening over squares of side 2 r + 1."""
    return filtered(px, lambda a: a - opened(a, r, False), ["v"], shape, 2 * r, tile)


def without_background(px: DataFrame, r: int, step: int, shape: tuple[int, int], tile: int = 256) -> DataFrame:
    """(image, y, x, v): planes without their background, a rolling ball on every `step`th pixel.

    Those pixels are averaged over 3 x 3, opened over a disk of r of them, smoothed by a Gaussian of r / 2 and brought back to the whole plane linearly, ends
    onto ends; what is above is kept.
    """
    coarse = [-(-n // step) for n in shape]
    near = 1 + 2 * r + int(SMOOTH_REACH * r / 2 + 0.5) + 2
    halo = step * near

    tile = _tile(shape, halo, tile)

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for t in _tiles(f, starts, shape, halo, tile):
            # tiles whose first coarse pixel is as far off are brought back alike
            kinds, of = np.unique(np.concatenate([t.at, t.inner], axis=1), axis=0, return_inverse=True)
            for k, kind in enumerate(kinds):
                at, inner, which = kind[:2].tolist(), kind[2:].tolist(), np.flatnonzero(of.ravel() == k)
                flat = flattened(t.plane[which], at, inner, t)
                found, columns = _places(f, Tiles(t.number[which], flat, t.at[which], t.inner[which], t.missing, t.off, t.size), flat)
                out.append(pd.DataFrame(columns | {"v": flat[found]}))
        return pd.concat(out, ignore_index=True)

    def flattened(plane: Plane, at: list[int], inner: list[int], t: Tiles) -> Plane:
        first = [-(-a // step) for a in at]
        small = plane[:, first[0] * step - at[0] :: step, first[1] * step - at[1] :: step]
        # reflected only where the coarse plane itself ends
        pad = [(near if o == 0 else 0, near if o + n == c else 0) for o, n, c in zip(first, small.shape[1:], coarse, strict=True)]
        a = np.pad(small, [(0, 0), *pad], mode="symmetric")
        for axis in (0, 1):
            a = along(a, np.full(3, 1 / 3), axis)
        a = smoothed(opened(a, r, True), r / 2)[:, pad[0][0] : a.shape[1] - pad[0][1], pad[1][0] : a.shape[2] - pad[1][1]]
        for axis in (0, 1):
            place = (inner[axis] + np.arange(t.size[axis])) * ((coarse[axis] - 1) / max(shape[axis] - 1, 1)) - first[axis]
            low = np.minimum(np.floor(place).astype(int), a.shape[axis + 1] - 1)
            part = np.expand_dims(place - low, 1 - axis)
            a = np.take(a, low, axis + 1) * (1 - part) + np.take(a, np.minimum(low + 1, a.shape[axis + 1] - 1), axis + 1) * part
        own = plane[:, t.off[0] :, t.off[1] :][:, : t.size[0], : t.size[1]]
        return np.round(np.maximum(own - a, 0), 9)

    schema = f"image {px.schema['image'].dataType.simpleString()}, y long, x long, v double"
    return stacks.whole_groups(dealt(px.select("image", "y", "x", "v"), shape, halo, tile), ["image", "ty", "tx"], run, schema)


def thin_once(a: Plane) -> Plane:
    """An iteration of Zhang and Suen's thinning of boolean planes."""
    a = np.pad(a, [(0, 0)] * (a.ndim - 2) + [(1, 1), (1, 1)])
    for second in (False, True):
        p = [np.roll(a, s, (-2, -1)) for s in ((1, 0), (1, -1), (0, -1), (-1, -1), (-1, 0), (-1, 1), (0, 1), (1, 1))]  # north, then clockwise
        n = sum(q.astype(np.int8) for q in p)
        turns = sum((~p[i] & p[(i + 1) % 8]).astype(np.int8) for i in range(8))
        north, east, south, west = p[0], p[2], p[4], p[6]
        sides = ~(north & east & west) & ~(north & south & west) if second else ~(north & east & south) & ~(east & south & west)
        a = a & ~((n >= 2) & (n <= 6) & (turns == 1) & sides)
    return a[..., 1:-1, 1:-1]


def skeleton(mask: DataFrame, shape: tuple[int, int], tile: int = 256, steps: int = 8) -> DataFrame:
    """(image, y, x): masks thinned to lines one pixel wide.

    An iteration looks two pixels away, so a tile with a halo of 2 * steps takes that many by itself. Rounds go on until no pixel goes; their number
    follows the width of what is thinned, not the size of the plane. A plane that is one tile is thinned to the end at once.
    """
    halo = 2 * steps
    tile = _tile(shape, halo, tile)
    whole = tile >= max(shape)

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = []
        for t in _tiles(f.assign(v=1), starts, shape, halo, tile):
            a = t.plane > 0 if whole else _padded(t) > 0
            open_, left = np.arange(len(a)), steps
            while len(open_) and (whole or left):
                new, left = thin_once(a[open_]), left - 1
                moved = (new != a[open_]).any(axis=(1, 2))
                a[open_] = new
                open_ = open_[moved]
            out.append(pd.DataFrame(_places(f, t, a if whole else _inner(a, t, halo))[1]))
        return pd.concat(out, ignore_index=True)

    schema = f"image {mask.schema['image'].dataType.simpleString()}, y long, x long"
    once = lambda px: stacks.whole_groups(dealt(px, shape, halo, tile), ["image", "ty", "tx"], run, schema)
    now = mask.select("image", "y", "x")
    if whole:
        return once(now).checkpoint()
    now = now.distinct()
    before, left = None, now.count()
    while left != before:
        now = once(now).checkpoint()
        before, left = left, now.count()
    return now


def thinned(a: Plane) -> Plane:
    """The skeletons of a stack of whole boolean planes."""
    a, open_ = a.copy(), np.arange(len(a))
    while len(open_):
        new = thin_once(a[open_])
        moved = (new != a[open_]).any(axis=(1, 2))
        a[open_] = new
        open_ = open_[moved]
    return a


def on_lines(f: pd.DataFrame, starts: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Which rows of f the skeletons of its groups have, each a plane of this shape; pixels beside it belong to none."""
    y, x, g, ends, line = f["y"].to_numpy(), f["x"].to_numpy(), stacks.numbers(starts, len(f)), np.append(starts, len(f)), np.zeros(len(f), bool)
    inside, many = (y >= 0) & (y < shape[0]) & (x >= 0) & (x < shape[1]), max(1, stacks.CELLS // (shape[0] * shape[1]))
    for k in range(0, len(starts), many):
        m = min(k + many, len(starts))
        rows = ends[k] + np.flatnonzero(inside[ends[k] : ends[m]])
        at, a = (g[rows] - k, y[rows], x[rows]), np.zeros((m - k, *shape), bool)
        a[at] = True
        line[rows] = thinned(a)[at]
    return line


def measured(px: DataFrame, reach: int, side: int, more: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """What more makes of frames of many whole planes of px(image, y, x, v) that fit a task, with r, the distance to the nearest pixel of the plane that isn't in px (reach + 1
    for those farther off than reach), and whether the skeleton of all pixels has each (`line`). Planes are dealt once; those without a place are left out."""

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        d2 = mo.outside(f, starts, side, reach)
        return more(f.assign(r=np.sqrt(np.where(d2 > 0, d2, (reach + 1) ** 2)), line=on_lines(f, starts, (side, side))))

    return stacks.whole_groups(px.select("image", "y", "x", "v").dropna(subset=["image", "y", "x"]), ["image"], run, schema)


def _closed(a: Plane, at: np.ndarray, most: int) -> pd.DataFrame:
    """(g, y, x, hole): 4-connected parts of at most `most` pixels, none at the edge, of what is 0 in a stack of planes that begin `at` rows and columns."""
    g, y, x = np.nonzero(a == 0)
    parts = pd.DataFrame({"g": g, "y": y + at[g, 0], "x": x + at[g, 1]})
    if not len(g):
        return parts.assign(hole=0)
    parts["edge"] = (y == 0) | (y == a.shape[1] - 1) | (x == 0) | (x == a.shape[2] - 1)
    parts = labelled(parts, np.flatnonzero(np.diff(g, prepend=-1)), OFFSETS4, 1 << 20)
    by = parts.groupby(["g", "label"])["edge"]
    keep = (by.transform("size") <= most) & ~by.transform("any")
    return parts[keep.to_numpy()].rename(columns={"label": "hole"})


def without_loops(a: Plane, v: Plane, most: int) -> Plane:
    """A stack of whole planes of lines without loops around holes of at most `most` pixels, round by round until none is left that can be opened: of what touches a hole
    at a side or corner the dimmest pixel (v; the first by row and column on ties) with two neighbours is cut. What a round doesn't open in a plane none after it does."""
    a, open_ = a.copy(), np.arange(len(a))
    while len(open_):
        now = np.pad(a[open_], [(0, 0), (1, 1), (1, 1)])
        may = now[:, 1:-1, 1:-1] & (sum(np.roll(now, o, (1, 2)).astype(np.int8) for o in OFFSETS8)[:, 1:-1, 1:-1] == 2)
        holes = _closed(a[open_], np.zeros((len(open_), 2), int), most)
        # holes don't reach the edge, so what is beside them is on the plane
        ring = pd.concat([holes.assign(y=holes["y"] + dy, x=holes["x"] + dx) for dy, dx in OFFSETS8])
        ring = ring[may[ring["g"], ring["y"], ring["x"]]]
        ring = ring.assign(v=v[open_[ring["g"]], ring["y"], ring["x"]])
        cut = ring.sort_values(["g", "hole", "v", "y", "x"]).drop_duplicates(["g", "hole"])
        a[open_[cut["g"]], cut["y"], cut["x"]] = False
        open_ = open_[np.unique(cut["g"])]
    return a


def small_holes(mask: DataFrame, most: int, shape: tuple[int, int], tile: int = 256) -> DataFrame:
    """(image, y, x, hole): pixels of the holes of a mask of at most `most` pixels: 4-connected parts of the background that don't reach the edge of the plane.

    No such hole reaches further than `most` pixels, so a tile's halo holds all of those that begin in it. `hole` is the least y * 2**20 + x of its pixels.
    """
    halo = most + 1
    tile = _tile(shape, halo, tile)

    def run(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        out = [pd.DataFrame({"image": f["image"].iloc[:0], "y": [], "x": [], "hole": []}).astype({"y": "int64", "x": "int64", "hole": "int64"})]
        for t in _tiles(f.assign(v=1), starts, shape, halo, tile):
            parts = _closed(t.plane, t.at, most)
            own = t.inner[parts["g"]]
            hy, hx = parts["hole"] // (1 << 20) - own[:, 0], parts["hole"] % (1 << 20) - own[:, 1]
            parts = parts[((hy >= 0) & (hy < tile) & (hx >= 0) & (hx < tile)).to_numpy()]
            out.append(parts.assign(image=f["image"].to_numpy()[t.number[parts["g"]]])[["image", "y", "x", "hole"]])
        return pd.concat(out, ignore_index=True)

    schema = f"image {mask.schema['image'].dataType.simpleString()}, y long, x long, hole long"
    return stacks.whole_groups(dealt(mask.select("image", "y", "x"), shape, halo, tile), ["image", "ty", "tx"], run, schema)


def ranked(a: Plane, size: int) -> Plane:
    """The median of the size x size square around each pixel, size being odd; the outermost pixels go on."""
    r = size // 2
    around = np.lib.stride_tricks.sliding_window_view(np.pad(a, [(0, 0)] * (a.ndim - 2) + [(r, r), (r, r)], mode="edge"), (size, size), axis=(-2, -1))
    return np.median(around, axis=(-2, -1))


def local_scores(px: DataFrame, size: int, step: int, floor: float, shape: tuple[int, int], tile: int = 256) -> DataFrame:
    """(image, y, x, z) of px(image, y, x, v): each value less the local median, over 1.4826 times the local median deviation or the floor if that is more.

    Both are taken over size x size squares (size: odd) of every step-th pixel, the deviation from each pixel's own median, and interpolated in between:
    corners of both grids fall together. The thin grid is filtered on halo tiles; every pixel then pulls its four neighbours there.
    """
    if size % 2 == 0:
        raise ValueError(f"squares of {size} pixels have no middle")
    small = tuple(-(-n // step) for n in shape)
    thin = px.where(f"y % {step} = 0 AND x % {step} = 0").select("image", F.floor(F.col("y") / step).alias("y"), F.floor(F.col("x") / step).alias("x"), "v")

    def kernel(a: Plane) -> tuple[Plane, Plane]:
        med = ranked(a, size)
        return med, ranked(np.abs(a - med), size)

    local = filtered(thin, kernel, ["med", "mad"], small, 2 * (size // 2), tile)
    at = px.select("image", "y", "x", "v").withColumns({f"s{c}": F.col(c) * ((m - 1) / (n - 1) if n > 1 else 0.0) for c, m, n in zip("yx", small, shape, strict=True)})
    for c in "yx":
        low, part = F.floor(f"s{c}"), F.col(f"s{c}") - F.floor(f"s{c}")
        ends = F.array(F.struct(low.alias("at"), (1 - part).alias("w")), F.struct((low + 1).alias("at"), part.alias("w")))
        at = at.withColumn("e", F.explode(ends)).withColumns({f"t{c}": F.col("e.at"), f"w{c}": F.col("e.w")}).drop("e")
    pulled = at.join(local.select("image", F.col("y").alias("ty"), F.col("x").alias("tx"), "med", "mad"), ["image", "ty", "tx"], "left").fillna(0.0, ["med", "mad"])
    both = pulled.groupBy("image", "y", "x", "v").agg(*[F.sum(F.col("wy") * F.col("wx") * F.col(n)).alias(n) for n in ("med", "mad")])
    return both.select("image", "y", "x", F.round((F.col("v") - F.col("med")) / F.greatest(1.4826 * F.col("mad"), F.lit(floor)), 6).alias("z"))
