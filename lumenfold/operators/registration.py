"""Registration of frames: whole-pixel shifts as relations, sub-pixel shifts and resampling as kernels on one plane a row."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.functions.numeric import half_away


def chunked(frames: DataFrame, size: int) -> DataFrame:
    """frames(t, z, ...) with their place i in the plane, and the chunk: about size frames each, what is over at the end left out.

    A plane of n frames has round(n / size) chunks, at least one, of floor(n / chunks) frames.
    """
    times = frames.select("z", "t").distinct()
    w = Window.partitionBy("z")
    placed = times.select("z", "t", (F.row_number().over(w.orderBy("t")) - 1).alias("i"), F.count("*").over(w).alias("n"))
    chunks = F.greatest(F.lit(1), F.floor(F.col("n") / size + 0.5))
    each = F.floor(F.col("n") / chunks)
    kept = placed.select("z", "t", "i", F.floor(F.col("i") / each).alias("chunk"), chunks.alias("chunks")).where("chunk < chunks").drop("chunks")
    return frames.join(kept, ["z", "t"])


def references(chunks: DataFrame) -> DataFrame:
    """(z, chunk, y, x, mean, median) of each chunk's frames."""
    return chunks.groupBy("z", "chunk", "y", "x").agg(F.round(F.avg("v"), 6).alias("mean"), F.median("v").alias("median"))


def whole_shifts(moving: DataFrame, fixed: DataFrame, keys: list[str], side: int) -> DataFrame:
    """(keys, dy, dx, peak): the shift that brings moving(keys, y, x, v) onto fixed(keys, y, x, v), where their circular cross-correlation is furthest from 0.

    `peak` is the correlation there, with its sign. Ties go to the first in the order of columns, then rows. Shifts beyond half the side count from the other end.
    """
    pairs = moving.join(fixed.select(*keys, F.col("y").alias("fy"), F.col("x").alias("fx"), F.col("v").alias("w")), keys)
    at = [F.pmod(F.col("fy") - F.col("y"), F.lit(side)).alias("sy"), F.pmod(F.col("fx") - F.col("x"), F.lit(side)).alias("sx")]
    c = pairs.groupBy(*keys, *at).agg(F.sum(F.col("v") * F.col("w")).alias("c"))
    best = c.groupBy(*keys).agg(F.min(F.struct((-F.abs("c")).alias("far"), "sx", "sy", "c")).alias("b"))
    signed = lambda s: F.when(F.col(s) >= (side + 1) // 2, F.col(s) - side).otherwise(F.col(s)).cast("long")
    return best.select(*keys, signed("b.sy").alias("dy"), signed("b.sx").alias("dx"), F.col("b.c").alias("peak"))


def trusted(shifts: DataFrame, cap: float, least: float = 0.0) -> DataFrame:
    """shifts with a shift of 0 where it is over the cap or its agreement ncc is under least (0: not looked at)."""
    fine: Column = F.greatest(F.abs("dy"), F.abs("dx")) <= cap
    if least > 0:
        fine = fine & (F.col("ncc") >= least)
    return shifts.withColumns({c: F.when(fine, F.col(c)).otherwise(F.lit(0)) for c in ("dy", "dx")})


def moved(frames: DataFrame, shifts: DataFrame, keys: list[str], side: int) -> DataFrame:
    """Frames by their whole-pixel shift, those without one as they are; what leaves the plane is lost, what enters it is 0."""
    known = frames.join(shifts.select(*keys, "dy", "dx"), keys, "left").fillna(0, ["dy", "dx"])
    shifted = known.select(*keys, (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), "v")
    place = frames.select(*keys, "y", "x")
    return place.join(shifted.where(F.col("y").between(0, side - 1) & F.col("x").between(0, side - 1)), [*keys, "y", "x"], "left").fillna(0, ["v"])


def depth_shifted(stack: DataFrame, z: float) -> DataFrame:
    """stack(z, y, x, v) moved along z by a fraction of a plane: (1 - f) of the plane zi before and f of the one before that; none is 0."""
    zi = int(np.floor(z))
    f = z - zi
    a = stack.select((F.col("z") + zi).alias("z"), "y", "x", ((1 - f) * F.col("v")).alias("v"))
    b = stack.select((F.col("z") + zi + 1).alias("z"), "y", "x", (f * F.col("v")).alias("v"))
    both = a.union(b).groupBy("z", "y", "x").agg(F.sum("v").alias("v"))
    return stack.select("z", "y", "x").join(both, ["z", "y", "x"], "left").select("z", "y", "x", F.round(F.coalesce("v", F.lit(0.0)), 9).alias("v"))


def translated(frames: DataFrame, shifts: DataFrame, keys: list[str], rows: int, columns: int, whole: bool = False) -> DataFrame:
    """frames(keys, y, x, v) moved by shifts(keys, dy, dx), to fractions of a pixel, as (keys, y, x, v double) of pixels that something reaches.

    output(y, x) = input(y - dy, x - dx), linear on both axes, 0 beyond the plane: every pixel goes to the four it is part of, and one sum by pixel
    adds them up. With `whole` values are rounded, halves away from 0, to 0..65535.
    """
    placed = frames.join(shifts.select(*keys, "dy", "dx"), keys)
    for c, d, n in (("y", "dy", rows), ("x", "dx", columns)):
        low, part = F.floor(d), F.col(d) - F.floor(d)
        ends = F.array(F.struct((F.col(c) + low).alias("at"), (1 - part).alias("w")), F.struct((F.col(c) + low + 1).alias("at"), part.alias("w")))
        placed = placed.withColumn("e", F.explode(ends)).where(f"e.w > 0 AND e.at >= 0 AND e.at < {n}").withColumn(c, F.col("e.at")).withColumn("v", F.col("v") * F.col("e.w")).drop("e")
    v = F.sum("v")
    v = F.least(F.lit(65535.0), F.greatest(F.lit(0.0), half_away(v))) if whole else F.round(v, 9)
    return placed.groupBy(*keys, "y", "x").agg(v.alias("v"))


def volume_shift(moving: np.ndarray, fixed: np.ndarray, factor: float = 2) -> tuple[float, float, float]:
    """(dy, dx, dz) that brings moving onto fixed, both [y, x, z], to 1 / factor of a voxel: where the correlation on a grid so much finer is furthest from 0.

    The finer grid comes from the spectrum put into one of the finer grid's size. Ties go to the first in the order of planes, columns, rows.
    A single row or column has no shift along it; a single plane, or a factor that makes no whole grid, is refused.
    """
    n = moving.shape
    out = tuple(factor * k for k in n)
    if len(n) != 3 or n[2] == 1 or factor <= 0 or any(k != int(k) for k in out) or out[2] == 1:
        raise ValueError(f"volumes of shape {n} can't be registered on a grid {factor} times as fine")
    out = tuple(int(k) for k in out)
    c = np.fft.fftshift(np.fft.fftn(fixed) * np.conj(np.fft.fftn(moving)))
    wide = np.zeros(out, complex)
    inner = [slice(max(0, m // 2 - k // 2), max(0, m // 2 - k // 2) + min(k, m)) for k, m in zip(n, out, strict=True)]
    source = [slice(max(0, k // 2 - m // 2), max(0, k // 2 - m // 2) + min(k, m)) for k, m in zip(n, out, strict=True)]
    wide[tuple(inner)] = c[tuple(source)]
    far = np.round(np.abs(np.fft.ifftn(np.fft.ifftshift(wide))), 9)
    at = np.unravel_index(np.argmax(far.transpose(2, 1, 0)), out[::-1])[::-1]
    return tuple(0.0 if k == 1 and i < 2 else float(a - m if a >= (m + 1) // 2 else a) / factor for i, (a, k, m) in enumerate(zip(at, n, out, strict=True)))


def registered_volumes(pairs: DataFrame, shape: tuple[int, int, int], factor: float = 2) -> DataFrame:
    """pairs(t, moving, fixed: arrays of a volume by plane, row, column) as (t, dy, dx, dz). shape: planes, rows, columns. A volume is a row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            cube = lambda a: np.asarray(a, float).reshape(shape).transpose(1, 2, 0)
            found = [volume_shift(cube(a), cube(b), factor) for a, b in zip(f["moving"], f["fixed"], strict=True)]
            yield pd.DataFrame({"t": f["t"], **{c: [r[i] for r in found] for i, c in enumerate(("dy", "dx", "dz"))}})

    return pairs.select("t", "moving", "fixed").mapInPandas(run, "t long, dy double, dx double, dz double")


def upsampled(c: np.ndarray, size: int, factor: int, at: tuple[float, float]) -> np.ndarray:
    """A size x size piece, from `at` on, of the inverse transform of c on a grid `factor` times as fine, by two matrix products."""
    n, m = c.shape
    rows = np.exp(2j * np.pi / (n * factor) * np.outer(np.arange(size) + at[0], np.fft.fftfreq(n) * n))
    columns = np.exp(2j * np.pi / (m * factor) * np.outer(np.fft.fftfreq(m) * m, np.arange(size) + at[1]))
    return rows @ c @ columns


def subpixel_shift(moving: np.ndarray, fixed: np.ndarray, factor: int = 100) -> tuple[float, float]:
    """The shift, to 1 / factor of a pixel, that brings moving onto fixed: where their cross-correlation is furthest from 0, then a fine grid
    around it. A single row or column has no shift along it."""
    if not (np.isfinite(moving).all() and np.isfinite(fixed).all()):
        raise ValueError("frames with values that aren't finite can't be registered")
    c = np.fft.fft2(fixed) * np.conj(np.fft.fft2(moving))
    n, m = c.shape
    x, y = np.unravel_index(np.argmax(np.round(np.abs(np.fft.ifft2(c).T), 9)), (m, n))  # the first in the order of columns
    coarse = np.array([y - n if y >= (n + 1) // 2 else y, x - m if x >= (m + 1) // 2 else x], float)
    single = np.array([n == 1, m == 1])
    if factor == 1:
        return tuple(np.where(single, 0.0, coarse).tolist())
    size = int(np.ceil(1.5 * factor)) | 1
    start = np.round(coarse * factor) - size // 2
    fine = np.abs(upsampled(c, size, factor, (start[0], start[1])))
    i, j = np.unravel_index(np.argmax(fine), fine.shape)
    return tuple(np.where(single, 0.0, (start + [i, j]) / factor).tolist())


def fourier_shifted(a: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """a moved by any shift through the phase of its transform; the band that wraps around is 0."""
    n, m = a.shape
    ramp = np.exp(-2j * np.pi * (np.fft.fftfreq(n)[:, None] * dy + np.fft.fftfreq(m)[None, :] * dx))
    out = np.roll(a, (int(dy), int(dx)), (0, 1)).astype(float) if dy == int(dy) and dx == int(dx) else np.fft.ifft2(np.fft.fft2(a) * ramp).real
    for axis, d in ((0, dy), (1, dx)):
        k = int(np.ceil(abs(d)))
        if k:
            cut = [slice(None), slice(None)]
            cut[axis] = slice(0, k) if d > 0 else slice(-k, None)
            out[tuple(cut)] = 0
    return out


def blurred(a: np.ndarray, sigma: float) -> np.ndarray:
    """Gaussian blur with a radius of ceil(2 sigma) and the edge repeated beyond it."""
    r = int(np.ceil(2 * sigma))
    k = np.exp(-np.arange(-r, r + 1) ** 2 / (2 * sigma * sigma))
    k /= k.sum()
    for axis in (0, 1):
        wide = np.pad(a, [(r, r) if i == axis else (0, 0) for i in (0, 1)], mode="edge")
        a = sum(w * np.take(wide, np.arange(i, i + a.shape[axis]), axis) for i, w in enumerate(k))
    return a


def resize_weights(n: int, to: int) -> np.ndarray:
    """[to, n]: cubic interpolation (a = -0.5), widened when shrinking, mirrored at the edge, rows adding up to 1."""
    scale = to / n
    wide = max(1.0, 1 / scale)
    u = (np.arange(to) + 0.5) / scale - 0.5
    at = np.floor(u - 2 * wide).astype(int)[:, None] + np.arange(int(np.ceil(4 * wide)) + 2)
    d = np.abs(u[:, None] - at) / wide
    w = np.where(d <= 1, 1.5 * d**3 - 2.5 * d**2 + 1, np.where(d < 2, -0.5 * d**3 + 2.5 * d**2 - 4 * d + 2, 0))
    mirrored = np.where(at % (2 * n) < n, at % (2 * n), 2 * n - 1 - at % (2 * n))
    out = np.zeros((to, n))
    np.add.at(out, (np.repeat(np.arange(to), at.shape[1]), mirrored.ravel()), (w / w.sum(1, keepdims=True)).ravel())
    return out


def resized(a: np.ndarray, rows: int, columns: int) -> np.ndarray:
    return resize_weights(a.shape[0], rows) @ a @ resize_weights(a.shape[1], columns).T


def as_rows(frames: DataFrame, keys: list[str], name: str) -> DataFrame:
    """frames(keys, y, x, v) as a row a plane: its values in the order of rows."""
    cells = F.array_sort(F.collect_list(F.struct("y", "x", F.col("v").cast("double").alias("v"))))
    return frames.groupBy(*keys).agg(F.transform(cells, lambda c: c["v"]).alias(name))


def registered(pairs: DataFrame, side: int, factor: int, sigma: float = 0.0) -> DataFrame:
    """pairs(z, t, moving, fixed: arrays of a plane) as (z, t, dy, dx, ncc): each row by itself, whatever partition it is in."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            found = []
            for a, b in zip(f["moving"], f["fixed"], strict=True):
                a, b = (np.asarray(p, float).reshape(side, side) for p in (a, b))
                if sigma:
                    a, b = blurred(a, sigma), blurred(b, sigma)
                dy, dx = subpixel_shift(a - a.mean(), b - b.mean(), factor)
                m = np.fft.ifft2(np.fft.fft2(a) * np.exp(-2j * np.pi * (np.fft.fftfreq(side)[:, None] * dy + np.fft.fftfreq(side)[None, :] * dx))).real
                sd = m.std() * b.std()
                found.append((dy, dx, float(((m - m.mean()) * (b - b.mean())).mean() / sd) if sd else float("nan")))
            yield pd.DataFrame({"z": f["z"], "t": f["t"], **{c: [r[i] for r in found] for i, c in enumerate(("dy", "dx", "ncc"))}})

    return pairs.select("z", "t", "moving", "fixed").mapInPandas(run, "z long, t long, dy double, dx double, ncc double")


def chained(chunks: DataFrame, side: int, factor: int) -> DataFrame:
    """rows(z, chunk, t, moving) as (z, t, dy, dx): from the middle frame of each chunk outwards, each registered to its already moved neighbour.

    The fold has an order, so a chunk, whose size is bounded, is one group.
    """

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("t", ignore_index=True)
        planes = [np.asarray(a, float).reshape(side, side) for a in f["moving"]]
        shifts, mid = np.zeros((len(planes), 2)), len(planes) // 2
        for order in (range(mid + 1, len(planes)), range(mid - 1, -1, -1)):
            last = planes[mid]
            for i in order:
                shifts[i] = subpixel_shift(planes[i] - planes[i].mean(), last - last.mean(), factor)
                last = fourier_shifted(planes[i], *shifts[i])
        return pd.DataFrame({"z": f["z"], "t": f["t"], "dy": shifts[:, 0], "dx": shifts[:, 1]})

    return chunks.select("z", "chunk", "t", "moving").groupBy("z", "chunk").applyInPandas(run, "z long, t long, dy double, dx double")
