"""Motion of frames put together from many small registrations: numbered frames, running totals, chains held to their mean, chunks to the first, time to its middle.

A plane is a row; what depends on order is a sum of shifts, three numbers a frame, added up block by block. No task holds more than one plane and its target.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumenfold.operators import registration as reg

#: Frames of a block within which places are counted and shifts are added up.
BLOCK = 10_000
#: Levels of a rescaled value, so that a pixel's values over time are counted and not gathered.
LEVELS = 1000


def numbered(times: DataFrame, block: int = BLOCK) -> DataFrame:
    """times(z, t, ...) with the place i, from 0, of t among those of z: counted within blocks of t, then on from the blocks before."""
    cut = times.withColumn("_b", F.floor(F.col("t") / block))
    before = cut.groupBy("z", "_b").agg(F.count("*").alias("_n"))
    before = before.withColumn("_n", F.sum("_n").over(Window.partitionBy("z").orderBy("_b")) - F.col("_n"))
    here = cut.withColumn("_i", F.row_number().over(Window.partitionBy("z", "_b").orderBy("t")) - 1)
    return here.join(before, ["z", "_b"]).withColumn("i", (F.col("_i") + F.col("_n")).cast("long")).drop("_b", "_n", "_i")


def composed(steps: DataFrame, block: int = BLOCK) -> DataFrame:
    """(z, i, dy, dx) of steps(z, i, dy, dx), the shift of each frame onto the one before: its shift onto the middle frame, floor(n / 2) of n.

    Shifts of translations add up, outwards from the middle: the running total at a frame less that at the middle.
    """
    s = steps.select("z", "i", "dy", "dx", F.floor(F.col("i") / block).alias("b"))
    run = lambda by, order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    whole = s.groupBy("z", "b").agg(*[F.sum(c).alias(f"b{c}") for c in ("dy", "dx")])
    whole = whole.select("z", "b", *[(F.sum(f"b{c}").over(run(["z"], "b")) - F.col(f"b{c}")).alias(f"b{c}") for c in ("dy", "dx")])
    total = s.select("z", "b", "i", *[F.sum(c).over(run(["z", "b"], "i")).alias(c) for c in ("dy", "dx")]).join(whole, ["z", "b"])
    total = total.select("z", "i", *[(F.col(c) + F.col(f"b{c}")).alias(c) for c in ("dy", "dx")])
    middle = s.groupBy("z").agg(F.floor((F.max("i") + 1) / 2).alias("i"))
    middle = total.join(middle, ["z", "i"]).select("z", F.col("dy").alias("my"), F.col("dx").alias("mx"))
    return total.join(middle, "z").select("z", "i", (F.col("dy") - F.col("my")).alias("dy"), (F.col("dx") - F.col("mx")).alias("dx"))


def added(shifts: list[DataFrame], keys: list[str]) -> DataFrame:
    """(keys, dy, dx): the sum of shifts, where one is missing without it."""
    return reduce(DataFrame.unionByName, [s.select(*keys, "dy", "dx") for s in shifts]).groupBy(*keys).agg(F.sum("dy").alias("dy"), F.sum("dx").alias("dx"))


def _mapped(rows: DataFrame, keys: list[str], columns: list[str], kernel: Callable, names: list[str], kind: str = "double") -> DataFrame:
    """(keys, names): kernel of a row's columns, each row by itself."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in parts:
            found = [kernel(*r) for r in zip(*[f[c] for c in columns], strict=True)]
            yield pd.DataFrame({k: f[k] for k in keys} | {n: [r[i] for r in found] for i, n in enumerate(names)})

    schema = ", ".join([f"{k} {rows.schema[k].dataType.simpleString()}" for k in keys] + [f"{n} {kind}" for n in names])
    return rows.select(*keys, *columns).mapInPandas(run, schema)


def moved_plane(a: np.ndarray, dy: float, dx: float) -> np.ndarray:
    """a moved by any shift, linear on both axes, 0 where nothing comes from."""
    for axis, d in ((0, dy), (1, dx)):
        low, n, out = int(np.floor(d)), a.shape[axis], 0.0
        for k, w in ((low, 1 - (d - low)), (low + 1, d - low)):
            if w and abs(k) < n:
                part = np.take(a, range(max(0, -k), n - max(0, k)), axis)
                out = out + w * np.pad(part, [(max(0, k), max(0, -k)) if i == axis else (0, 0) for i in (0, 1)])
        a = out + np.zeros_like(a, float)
    return a


def moved_rows(rows: DataFrame, shifts: DataFrame, keys: list[str], side: int) -> DataFrame:
    """rows(keys, moving) moved by shifts(keys, dy, dx), those without one as they are."""
    known = rows.join(shifts.select(*keys, "dy", "dx"), keys, "left").fillna(0.0, ["dy", "dx"])
    kernel = lambda a, dy, dx: (moved_plane(np.asarray(a, float).reshape(side, side), dy, dx).ravel(),)
    return _mapped(known, keys, ["moving", "dy", "dx"], kernel, ["moving"], "array<double>")


def target(rows: DataFrame, by: list[str], agg: Callable[[Column], Column]) -> DataFrame:
    """(by, fixed): agg of each pixel over the rows(by, moving) of a group."""
    cells = rows.select(*by, F.posexplode("moving").alias("p", "v")).groupBy(*by, "p").agg(agg(F.col("v")).alias("v"))
    return cells.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda c: c["v"]).alias("fixed"))


def agreement(a: np.ndarray, b: np.ndarray) -> float:
    """The correlation of two planes about their means; 0 where one of them is flat."""
    a, b = a - a.mean(), b - b.mean()
    size = np.sqrt((a * a).sum() * (b * b).sum())
    return float((a * b).sum() / size) if size > 0 else 0.0


def inner(side: int, keep: float) -> slice:
    """The middle part of an axis that `keep` (below 1) of it lie in, rounded outwards."""
    low, high = int(np.ceil(side * (1 - keep) / 2)), int(np.ceil(side * (1 - (1 - keep) / 2)))
    if low < 1:
        raise ValueError(f"{keep} of {side} pixels leave no edge to cut off")
    return slice(low - 1, high)


def refined(rows: DataFrame, chain: DataFrame, side: int, cap: float, least: float, factor: int = 4, sigma: float = 1.0, keep: float = 0.95) -> DataFrame:
    """(z, t, dy, dx, accepted, ncc, ry, rx): chain(z, t, dy, dx) held to the mean of each chunk of rows(z, chunk, t, moving).

    Frames moved by the chain make up the chunk's mean; each is registered to it, on the inner part and blurred. That correction (ry, rx) is added
    where it is within the cap and the frame agrees with the mean by at least `least` (0: not looked at); elsewhere the chain stays as it is.
    """
    place, at = ["z", "t"], inner(side, keep)
    by_chain = moved_rows(rows, chain, place, side).join(rows.select("z", "t", "chunk"), place).checkpoint()
    mean = target(by_chain, ["z", "chunk"], F.avg)

    def measure(a, b):
        a, b = (reg.blurred(np.asarray(p, float).reshape(side, side)[at, at], sigma) for p in (a, b))
        return (*reg.subpixel_shift(a, b, factor), agreement(a, b))

    seen = _mapped(by_chain.join(mean, ["z", "chunk"]), place, ["moving", "fixed"], measure, ["ry", "rx", "ncc"])
    fine = F.greatest(F.abs("ry"), F.abs("rx")) <= cap
    fine = fine & (F.col("ncc") >= least) if least > 0 else fine
    total = lambda c, r: (F.col(c) + F.when(F.col("accepted"), F.col(r)).otherwise(0.0)).alias(c)
    return seen.withColumn("accepted", fine).join(chain.select(*place, "dy", "dx"), place).select(*place, total("dy", "ry"), total("dx", "rx"), "accepted", "ncc", "ry", "rx")


def anchored(rows: DataFrame, shifts: DataFrame, side: int, factor: int = 2) -> DataFrame:
    """(z, t, dy, dx): shifts(z, t, dy, dx) within chunks of rows(z, chunk, t, moving), with each chunk's own shift onto the first of its plane.

    A chunk is known by the mean of its moved frames; the first has a shift of 0.
    """
    place = ["z", "t"]
    means = target(moved_rows(rows, shifts, place, side).join(rows.select("z", "t", "chunk"), place), ["z", "chunk"], F.avg).checkpoint()
    first = means.groupBy("z").agg(F.min("chunk").alias("chunk")).join(means, ["z", "chunk"]).select("z", "fixed")
    kernel = lambda a, b: reg.subpixel_shift(*(np.asarray(p, float).reshape(side, side) for p in (a, b)), factor)
    own = _mapped(means.withColumnRenamed("fixed", "moving").join(first, "z"), ["z", "chunk"], ["moving", "fixed"], kernel, ["dy", "dx"])
    return added([shifts, rows.select("z", "chunk", "t").join(own, ["z", "chunk"])], place)


def rescaled(rows: DataFrame, top: float = 99.0) -> DataFrame:
    """rows(z, t, moving) from each plane's median (0) to its percentile with knots at 100 (i - 0.5) / n (1), held there, in LEVELS steps; flat planes are 0."""

    def run(a):
        a = np.sort(np.asarray(a, float)), np.asarray(a, float)
        lo, hi = np.median(a[0]), np.interp(top / 100 * len(a[0]) + 0.5, np.arange(1, len(a[0]) + 1), a[0])
        return (np.round(LEVELS * (np.clip(a[1], lo, hi) - lo) / (hi - lo)) / LEVELS if hi > lo else np.zeros(len(a[1])),)

    return _mapped(rows, ["z", "t"], ["moving"], run, ["moving"], "array<double>")


def _onto(rows: DataFrame, keys: list[str], side: int, factor: int) -> DataFrame:
    kernel = lambda a, b: reg.subpixel_shift(*(np.asarray(p, float).reshape(side, side) for p in (a, b)), factor)
    return _mapped(rows, keys, ["moving", "fixed"], kernel, ["dy", "dx"])


def steps(rows: DataFrame, side: int, factor: int) -> DataFrame:
    """(z, i, dy, dx) of rows(z, i, moving): each frame onto the one before, the first with 0."""
    before = rows.select("z", (F.col("i") + 1).alias("i"), F.col("moving").alias("fixed"))
    kernel = lambda a, b: (0.0, 0.0) if b is None else reg.subpixel_shift(*(np.asarray(p, float).reshape(side, side) for p in (a, b)), factor)
    return _mapped(rows.join(before, ["z", "i"], "left"), ["z", "i"], ["moving", "fixed"], kernel, ["dy", "dx"])


def steadied(rows: DataFrame, side: int, factor: int, first: int = 50, block: int = BLOCK) -> DataFrame:
    """(z, t, dy, dx) of rows(z, t, moving) over all times, in three passes on rescaled planes: onto the mean of the first frames, onto the neighbour towards
    the middle frame, onto the median over time.

    In a pass planes are moved once from what they were, by the sum of the passes before. The second pass registers neighbours all at once and adds up.
    A pixel's median counts levels, so its buffer is bounded however many frames there are.
    """
    place = ["z", "t"]
    sound = numbered(rescaled(rows), block).checkpoint()
    one = _onto(sound.join(target(sound.where(F.col("i") < first), ["z"], F.avg), "z"), place, side, factor).checkpoint()
    order = sound.select("z", "t", "i")
    moved = moved_rows(sound, one, place, side).join(order, place)
    two = composed(steps(moved, side, factor), block).join(order, ["z", "i"]).select("z", "t", "dy", "dx")
    both = added([one, two], place).checkpoint()
    moved = moved_rows(sound, both, place, side).checkpoint()
    levels = moved.select("z", F.posexplode("moving").alias("p", "v")).groupBy("z", "p", F.round(F.col("v") * LEVELS).alias("v")).agg(F.count("*").alias("n"))
    middle = levels.groupBy("z", "p").agg((F.percentile("v", 0.5, F.col("n")) / LEVELS).alias("v"))
    middle = middle.groupBy("z").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "v"))), lambda c: c["v"]).alias("fixed"))
    return added([both, _onto(moved.join(middle, "z"), place, side, factor)], place)


def residual(rows: DataFrame, side: int, factor: int = 100) -> DataFrame:
    """(z, t, dy, dx) of rows(z, t, moving): what motion is left, each frame against the mean of all of its plane, both centred and under a Hann window."""
    window = np.outer(np.hanning(side), np.hanning(side)).ravel()
    soft = _mapped(rows, ["z", "t"], ["moving"], lambda a: ((np.asarray(a, float) - np.mean(a)) * window,), ["moving"], "array<double>").checkpoint()
    return _onto(soft.join(target(soft, ["z"], F.avg), "z"), ["z", "t"], side, factor)


def phase_score(moving: np.ndarray, fixed: np.ndarray) -> tuple[float, float, float, float]:
    """(sharp, r, dy, dx): the peak of the whitened correlation over its deviation, and of moving, rolled there, the correlation with fixed.

    Ties go to the first in the order of rows. A flat plane, or one whose roll is flat, has an r of 0.
    """
    a, b = ((p - p.mean()) / (p.std() + 1e-9) for p in (fixed, moving))
    c = np.fft.fft2(a) * np.conj(np.fft.fft2(b))
    c = np.fft.ifft2(c / (np.abs(c) + 1e-12)).real
    at = np.unravel_index(np.argmax(np.round(c, 9)), c.shape)
    dy, dx = (int(k) if k <= n // 2 else int(k) - n for k, n in zip(at, c.shape, strict=True))
    return float(c[at] / (c.std() + 1e-12)), agreement(np.roll(b, (dy, dx), (0, 1)), a), float(dy), float(dx)


def phase_scores(pairs: DataFrame, side: int) -> DataFrame:
    """(z, t, sharp, r, dy, dx) of pairs(z, t, moving, fixed)."""
    kernel = lambda a, b: phase_score(*(np.asarray(p, float).reshape(side, side) for p in (a, b)))
    return _mapped(pairs, ["z", "t"], ["moving", "fixed"], kernel, ["sharp", "r", "dy", "dx"])
