"""Tiles streamed through tasks, many at a time: small planes are worked on as one stack of arrays, and a task holds a bounded number of pixels.

A task gets its rows sorted by tile and passes on whole tiles, some ten thousand pixels of them together, so neither the number of tiles nor that of images
matters to its memory; a single tile larger than that goes by itself. Tiles of this module need no size of a plane: they begin a quarter of a tile before 0,
so that planes smaller than half a tile, and pixels beside them, are in one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that are worked on together, cells of a stack.
ROWS, CELLS = 1 << 16, 1 << 21
TILE = 256


def whole_groups(df: DataFrame, keys: list[str], run: Callable[[pd.DataFrame, np.ndarray], pd.DataFrame], schema: str) -> DataFrame:
    """What run makes of frames of many whole groups by keys; it also gets where each group begins."""

    def stream(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n, enough = [], 0, ROWS
        for f in frames:
            held.append(f)
            n += len(f)
            if n >= enough:
                f = pd.concat(held, ignore_index=True)
                starts = _starts(f, keys)
                if len(starts) > 1:
                    yield run(f.iloc[: starts[-1]], starts[:-1])
                rest = f.iloc[starts[-1] :].reset_index(drop=True)  # may go on in the next frame
                held, n, enough = [rest], len(rest), max(ROWS, 2 * len(rest))
        if n:
            f = pd.concat(held, ignore_index=True)
            yield run(f, _starts(f, keys))

    # dealt by a digest: a union of joins by the keys counts as dealt by them, which it isn't where such a join turns into a broadcast
    return df.repartition(F.xxhash64(*keys)).sortWithinPartitions(*keys).mapInPandas(stream, schema)


def _starts(f: pd.DataFrame, keys: list[str]) -> np.ndarray:
    new = np.zeros(len(f), bool)
    new[:1] = True
    for k in keys:
        v = f[k].to_numpy()
        none = pd.isna(f[k]).to_numpy() if v.dtype.kind in "fO" else np.zeros(len(f), bool)
        new[1:] |= (v[1:] != v[:-1]) & ~(none[1:] & none[:-1])
    return np.flatnonzero(new)


def numbers(starts: np.ndarray, n: int) -> np.ndarray:
    """The group of each of n rows."""
    return np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))


def spread(px: DataFrame, halo: int, tile: int = TILE) -> DataFrame:
    """px with the tile (ty, tx) of each tile that has it in its inner part or its halo."""

    def span(c: str) -> Column:
        at = F.col(c).cast("long") + tile // 4
        return F.sequence(F.floor((at - halo) / tile), F.floor((at + halo) / tile))

    return px.withColumn("ty", F.explode(span("y"))).withColumn("tx", F.explode(span("x")))


def own(f: pd.DataFrame, tile: int = TILE) -> np.ndarray:
    """Which rows are in the inner part of their tile."""
    return ((f["y"].to_numpy() + tile // 4) // tile == f["ty"].to_numpy()) & ((f["x"].to_numpy() + tile // 4) // tile == f["tx"].to_numpy())


def planes(f: pd.DataFrame, starts: np.ndarray, pad: int) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray, tuple[int, int, int], np.ndarray, np.ndarray]]:
    """Stacks of the groups of f: the rows they are, each row's plane, row and column in the stack, the stack's shape, and what y and x each plane begins at.

    A plane is as large as its group's pixels need, with `pad` around.
    """
    y, x, g = f["y"].to_numpy(), f["x"].to_numpy(), numbers(starts, len(f))
    y0, x0 = np.minimum.reduceat(y, starts) - pad, np.minimum.reduceat(x, starts) - pad
    h, w = int((np.maximum.reduceat(y, starts) - y0).max()) + pad + 1, int((np.maximum.reduceat(x, starts) - x0).max()) + pad + 1
    ends, many = np.append(starts, len(f)), max(1, CELLS // (h * w))
    for k in range(0, len(starts), many):
        m = min(k + many, len(starts))
        rows = slice(ends[k], ends[m])
        yield rows, g[rows] - k, y[rows] - y0[g[rows]], x[rows] - x0[g[rows]], (m - k, h, w), y0[k:m], x0[k:m]


def around(f: pd.DataFrame, starts: np.ndarray, offsets: list[tuple[int, int]]) -> tuple[np.ndarray, list[np.ndarray]]:
    """(order, found): rows of f without repeated pixels, by group, row and column, and for each offset the place in that order of the pixel that far away, -1 where
    there is none."""
    y, x, g = f["y"].to_numpy().astype(np.int64), f["x"].to_numpy().astype(np.int64), numbers(starts, len(f))
    far = max((max(abs(dy), abs(dx)) for dy, dx in offsets), default=0)
    ly, lx = y - np.minimum.reduceat(y, starts)[g] + far, x - np.minimum.reduceat(x, starts)[g] + far
    w, h = int(lx.max()) + far + 1, int(ly.max()) + far + 1
    code = (g * h + ly) * w + lx
    code, order = np.unique(code, return_index=True)
    found = []
    for dy, dx in offsets:
        want = code + dy * w + dx
        at = np.minimum(np.searchsorted(code, want), len(code) - 1)
        found.append(np.where(code[at] == want, at, -1))
    return order, found
