"""Ways along skeletons from many places at once: breadth-first, in the order of a queue.

Where ways are equally long the order of a queue decides: pixels wait in the order they were reached, and each looks at its neighbours by row, then
column.

Images of a bounded number of pixels (and of steps, where each start searches by itself) are searched in tasks, many of them together as arrays whose
order is the queue's. Larger ones take rounds on the frontier alone: neighbours of a frontier are in the frontier before, in it, or new, so a round joins it
with the skeleton and looks back no further than one round. All sources of all images go in the same rounds, whose number is the length of the longest way.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from lumenfold.operators import grid, stacks

#: Rounds whose frontiers are kept as tables of their own before they become one.
GATHERED = 32
#: Pixels of an image that is searched in a task, and steps that its starts may take there.
PIXELS, STEPS = 1 << 18, 1 << 26


def _dealt(sk: DataFrame, starts: DataFrame, others: list[DataFrame], reach: int, whole: Callable[..., DataFrame], rounds: Callable[..., DataFrame], tables: bool = False) -> DataFrame:
    """whole(sk, starts, others) for images that fit a task, rounds(sk, starts, others) for the rest. reach: pixels that a start can get to at most, 0 where all starts share them.
    tables: sk and starts are read from tables as they are, so they aren't written once more."""
    sk, starts = sk.dropna(subset=["image", "y", "x"]), starts.dropna(subset=["image"])
    if not tables:
        sk, starts = sk.checkpoint(), starts.checkpoint()
    size = sk.groupBy("image").agg(F.count("*").alias("n")).join(starts.groupBy("image").agg(F.count("*").alias("k")), "image")
    large = size.where((F.col("n") > PIXELS) | (F.least("n", F.lit(reach)) * F.col("k") > STEPS)).select("image").checkpoint()
    if large.isEmpty():
        return whole(sk, starts, *others)
    kept = lambda how: [df.join(large, "image", how) for df in (sk, starts, *others)]
    return whole(*kept("left_anti")).union(rounds(*kept("left_semi")))


def _by_image(sk: DataFrame, others: list[DataFrame], run: Callable[..., pd.DataFrame], schema: str) -> DataFrame:
    """run(f, g, kind, graph) over frames of whole images: rows of sk have kind 0, those of others 1 and on; g is the number of a row's image. Columns that a table lacks
    are null, whole numbers 0."""
    tables = [df.withColumn("kind", F.lit(i)) for i, df in enumerate((sk, *others))]
    fields = {f.name: f.dataType for df in tables for f in df.schema.fields}
    none = lambda t: F.lit(0 if isinstance(t, IntegralType) else None).cast(t)
    column = lambda df, n: F.col(n).cast("long") if n in ("y", "x") else F.col(n) if n in df.columns else none(fields[n]).alias(n)
    rows = reduce(DataFrame.union, [df.select(*[column(df, n).alias(n) for n in fields]) for df in tables])

    def images(f: pd.DataFrame, starts: np.ndarray) -> pd.DataFrame:
        return run(f, stacks.numbers(starts, len(f)), f["kind"].to_numpy())

    return stacks.whole_groups(rows, ["image"], images, schema)


def _graph(f: pd.DataFrame, g: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray, Callable[..., np.ndarray]]:
    """The rows of f that are different pixels, the number of each neighbour of each of them (-1: none) by row, then column, and a function that finds pixels of images."""
    is_px, at, wide = kind == 0, [], []
    low = {}
    for c in "yx":
        v = f[c].to_numpy()[is_px]
        low[c] = np.full(int(g.max()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(low[c], g[is_px], v)
        low[c][low[c] == np.iinfo(np.int64).max] = 0
        at.append(v - low[c][g[is_px]] + 1)
        wide.append(int(at[-1].max(initial=0)) + 2)
    (y, x), (h, w) = at, wide
    code, first = np.unique((g[is_px] * h + y) * w + x, return_index=True)

    def known(want: np.ndarray) -> np.ndarray:
        if not len(code):
            return np.full(len(want), -1)
        i = np.minimum(np.searchsorted(code, want), len(code) - 1)
        return np.where(code[i] == want, i, -1)

    def find(g: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        y, x = y - low["y"][g] + 1, x - low["x"][g] + 1
        return np.where((y > 0) & (y < h) & (x > 0) & (x < w), known((g * h + y) * w + x), -1)

    return np.flatnonzero(is_px)[first], np.stack([known(code + dy * w + dx) for dy, dx in grid.OFFSETS8], axis=1), find


def _on(beside: np.ndarray, search: np.ndarray, pixel: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The frontier after this one, (search, pixel, row of this one it comes from), each search in the order of its queue; before: codes of the one before."""
    to = beside[pixel].ravel()
    row = np.flatnonzero(to >= 0)
    to, row = to[row], row // 8
    code, first = np.unique(search[row] * len(beside) + to, return_index=True)
    new = np.sort(first[~np.isin(code, np.concatenate([before, search * len(beside) + pixel]))])
    return search[row[new]], to[new], row[new]


def _blocks(n: np.ndarray) -> list[slice]:
    """Consecutive starts, each of which can get to n pixels, in blocks of a bounded number of those."""
    cuts = [*np.flatnonzero(np.diff(np.cumsum(n) // stacks.CELLS, prepend=-1)), len(n)]
    return [slice(a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def _looked_at(frontier: DataFrame, sk: DataFrame, keys: list[str], before: DataFrame | None) -> DataFrame:
    """The frontier's neighbours on the skeleton that are new, each with the first that looks at it: (keys, y, x, first: struct of place, k, what it carries)."""
    steps = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for k, (dy, dx) in enumerate(grid.OFFSETS8)])
    seen = frontier.withColumn("o", F.explode(steps)).select(*keys, (F.col("y") + F.col("o.dy")).alias("y"), (F.col("x") + F.col("o.dx")).alias("x"), F.struct("place", "o.k", "from").alias("first"))
    new = seen.groupBy(*keys, "y", "x").agg(F.min("first").alias("first")).join(sk, ["image", "y", "x"])
    for old in (frontier, before):
        if old is not None:
            new = new.join(old.select(*keys, "y", "x"), [*keys, "y", "x"], "left_anti")
    return new


def _placed(new: DataFrame, keys: list[str]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*keys).orderBy("first.place", "first.k"))
    return new.select(*keys, "y", "x", place.alias("place"), F.col("first.from").alias("from")).checkpoint()


def _together(tables: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.union, tables)


def attributed(sk: DataFrame, sources: DataFrame, keep: list[str] = [], tables: bool = False) -> DataFrame:  # noqa: B006
    """(image, y, x, id, hops, keep): each pixel of sk(image, y, x, keep) that a way leads to, with the one of sources(image, id, y, x, place) that reaches it first.

    Sources wait in the order of `place`; of those on one pixel the last has it. Sources beside the skeleton reach nothing. tables: both are read from tables.
    """

    def run(f: pd.DataFrame, g: np.ndarray, kind: np.ndarray) -> pd.DataFrame:
        px, beside, find = _graph(f, g, kind)
        s = f.assign(at=find(g, f["y"].to_numpy(), f["x"].to_numpy()))[kind == 1].query("at >= 0")
        s = s.sort_values(["place", "id"], kind="stable").drop_duplicates("at", keep="last")
        pixel, owner, hops = s["at"].to_numpy(), np.full(len(px), -1), np.zeros(len(px), np.int32)
        owner[pixel], n = np.arange(len(s)), 0
        while len(pixel):
            to, by = beside[pixel].ravel(), np.repeat(owner[pixel], 8)
            new = np.flatnonzero((to >= 0) & (owner[to] < 0))
            new = new[np.sort(np.unique(to[new], return_index=True)[1])]
            pixel, n = to[new], n + 1
            owner[pixel], hops[pixel] = by[new], n
        got = owner >= 0
        return f[["image", "y", "x", *keep]].iloc[px[got]].assign(id=s["id"].to_numpy()[owner[got]], hops=hops[got])[["image", "y", "x", "id", "hops", *keep]]

    def whole(sk: DataFrame, sources: DataFrame) -> DataFrame:
        kind, name = sk.schema["image"].dataType.simpleString(), sources.schema["id"].dataType.simpleString()
        return _by_image(sk, [sources], run, f"image {kind}, y long, x long, id {name}, hops int{grid.kept(sk, keep)}")

    def rounds(sk: DataFrame, sources: DataFrame) -> DataFrame:
        found = _attributed_in_rounds(sk, sources)
        return found.join(sk, ["image", "y", "x"]) if keep else found

    return _dealt(sk.select("image", "y", "x", *keep), sources.select("image", "id", "y", "x", "place").dropna(subset=["y", "x"]), [], 0, whole, rounds, tables)


def _attributed_in_rounds(sk: DataFrame, sources: DataFrame) -> DataFrame:
    """The same for images of any size. A frontier is ordered within each connected part."""
    parts = grid.components(sk.select("image", "y", "x")).checkpoint()
    keys, graph = ["image", "label"], parts.select("image", "y", "x")
    start = sources.select("image", "id", "y", "x", "place").join(parts, ["image", "y", "x"]).groupBy("image", "label", "y", "x").agg(F.max(F.struct("place", "id")).alias("s"))
    frontier, before = start.select("image", "label", "y", "x", F.col("s.place").alias("place"), F.col("s.id").alias("from")).checkpoint(), None
    done, hops = [], 0
    while not frontier.isEmpty():
        done.append(frontier.select("image", "y", "x", F.col("from").alias("id"), F.lit(hops).alias("hops")))
        if len(done) == GATHERED:
            done = [_together(done).checkpoint()]
        frontier, before, hops = _placed(_looked_at(frontier, graph, keys, before), keys), frontier, hops + 1
    return _together(done) if done else frontier.select("image", "y", "x", F.col("from").alias("id"), F.lit(0).alias("hops"))


def first_reached(sk: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    """(image, id, label, hops): for each of starts(image, id, y, x) the label of the first of goals(image, y, x, label) on its way along sk; those that reach none are left out.

    A start on a goal is there. Each start has a frontier of its own, which ends where it has found a goal.
    """

    def run(f: pd.DataFrame, g: np.ndarray, kind: np.ndarray) -> pd.DataFrame:
        px, beside, find = _graph(f, g, kind)
        f = f.assign(g=g, at=find(g, f["y"].to_numpy(), f["x"].to_numpy()))
        ends = f[(kind == 2) & (f["at"] >= 0)].sort_values("label", kind="stable").drop_duplicates("at")
        goal = np.full(len(px), -1)
        goal[ends["at"].to_numpy()] = np.arange(len(ends))
        s = f[(kind == 1) & (f["at"] >= 0)].drop_duplicates(["g", "id"])
        at, starts, ended, hops = s["at"].to_numpy(), [np.arange(0)], [np.arange(0)], [np.arange(0)]
        for block in _blocks(np.bincount(g[px], minlength=int(g.max()) + 1)[s["g"].to_numpy()]):
            pixel, before, n = at[block], np.arange(0), 0
            search = np.arange(len(pixel))
            done = np.zeros(len(pixel), bool)
            while len(pixel):
                hit = np.flatnonzero(goal[pixel] >= 0)
                who, first = np.unique(search[hit], return_index=True)
                done[who] = True
                starts.append(who + block.start)
                ended.append(goal[pixel[hit[first]]])
                hops.append(np.full(len(who), n))
                go = ~done[search]
                search, pixel, n = search[go], pixel[go], n + 1
                now = search * len(beside) + pixel
                search, pixel, _ = _on(beside, search, pixel, before)
                before = now
        i, j = np.concatenate(starts), np.concatenate(ended)
        return s[["image", "id"]].iloc[i].assign(label=ends["label"].to_numpy()[j], hops=np.concatenate(hops).astype(np.int32))

    def whole(sk: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
        kinds = [df.schema[n].dataType.simpleString() for df, n in ((sk, "image"), (starts, "id"), (goals, "label"))]
        return _by_image(sk, [starts, goals], run, "image {}, id {}, label {}, hops int".format(*kinds))

    some = lambda df, more: df.select("image", more, "y", "x").dropna(subset=["image", "y", "x"])
    return _dealt(sk.select("image", "y", "x"), some(starts, "id"), [some(goals, "label")], 1 << 62, whole, _first_reached_in_rounds)


def _first_reached_in_rounds(sk: DataFrame, starts: DataFrame, goals: DataFrame) -> DataFrame:
    keys, graph = ["image", "id"], sk.select("image", "y", "x").distinct()
    ends = goals.groupBy("image", "y", "x").agg(F.min("label").alias("label"))
    at = starts.select("image", "id", "y", "x").join(ends, ["image", "y", "x"], "left").select("image", "id", "y", "x", F.lit(1).alias("place"), F.lit(0).alias("from"), "label").checkpoint()
    done = [at.where(F.col("label").isNotNull()).select("image", "id", "label", F.lit(0).alias("hops"))]
    frontier, before, hops = at.where(F.col("label").isNull()).drop("label"), None, 0
    while not frontier.isEmpty():
        hops += 1
        new = _looked_at(frontier, graph, keys, before).join(ends, ["image", "y", "x"], "left").checkpoint()
        found = new.where(F.col("label").isNotNull()).groupBy(*keys).agg(F.min(F.struct("first.place", "first.k", "label")).alias("f"))
        found = found.select("image", "id", F.col("f.label").alias("label"), F.lit(hops).alias("hops")).checkpoint()
        done.append(found)
        if len(done) == GATHERED:
            done = [_together(done).checkpoint()]
        frontier, before = _placed(new.join(found, keys, "left_anti"), keys), frontier
    return _together(done)


def ways_between(sk: DataFrame, pairs: DataFrame, limit: int, keep: list[str] = [], tables: bool = False) -> DataFrame:  # noqa: B006
    """(image, a, b, keep, radii): for each of pairs(image, a, b, ay, ax, by, bx, keep) the values r of sk(image, y, x, r) along the shortest way from a's pixel to b's.

    Both ends count, and a way has at most `limit` pixels; pairs without one are left out. Each a searches once for all its b, until all are found or
    ways get too long. tables: both are read from tables.
    """

    def run(f: pd.DataFrame, g: np.ndarray, kind: np.ndarray) -> pd.DataFrame:
        px, beside, find = _graph(f, g, kind)
        r, n_px = f["r"].to_numpy()[px], len(px)
        p = f.assign(g=g, at=find(g, f["y"].to_numpy(), f["x"].to_numpy()))[kind == 1]
        p["to"] = find(p["g"].to_numpy(), p["by"].to_numpy(), p["bx"].to_numpy())
        p = p[(p["at"] >= 0) & (p["to"] >= 0)].drop_duplicates(["g", "a", "b", "to"])
        p = p.assign(search=p.groupby(["g", "a"], sort=False).ngroup()).sort_values("search", kind="stable", ignore_index=True)
        s = p.drop_duplicates("search")
        at, first = s["at"].to_numpy(), np.append(s.index.to_numpy(), len(p))
        rows, radii = [np.arange(0)], []
        near = np.minimum(np.bincount(g[px], minlength=int(g.max()) + 1), (2 * limit + 1) ** 2)
        for block in _blocks(near[s["g"].to_numpy()]):
            want = np.arange(first[block.start], first[block.stop])  # pairs that are looked for
            of = p["search"].to_numpy()[want] - block.start
            code = of * n_px + p["to"].to_numpy()[want]
            pixel, before, way = at[block], np.arange(0), []
            search, parent = np.arange(len(pixel)), np.arange(len(pixel))
            while len(pixel) and len(want):
                way.append((pixel, parent))
                now = search * n_px + pixel
                order = np.argsort(now)
                i = order[np.minimum(np.searchsorted(now, code, sorter=order), len(now) - 1)]
                found = now[i] == code
                if found.any():
                    i, values = i[found], []
                    for pixels, parents in reversed(way):
                        values.append(r[pixels[i]])
                        i = parents[i]
                    rows.append(want[found])
                    radii.extend(np.stack(values[::-1], axis=1))
                    want, of, code = want[~found], of[~found], code[~found]
                if len(way) == limit:
                    break
                # who has found all its goals searches no more
                here = np.flatnonzero(np.isin(search, of))
                search, pixel, parent = _on(beside, search[here], pixel[here], before)
                parent, before = here[parent], now
        return p[["image", "a", "b", *keep]].iloc[np.concatenate(rows)].assign(radii=pd.Series(radii, dtype=object).to_numpy())

    def whole(sk: DataFrame, pairs: DataFrame) -> DataFrame:
        kinds = [df.schema[n].dataType.simpleString() for df, n in ((sk, "image"), (pairs, "a"), (pairs, "b"))]
        return _by_image(sk, [pairs], run, "image {}, a {}, b {}{}, radii array<double>".format(*kinds, grid.kept(pairs, keep)))

    def rounds(sk: DataFrame, pairs: DataFrame) -> DataFrame:
        found = _ways_in_rounds(sk, pairs.withColumnsRenamed({"y": "ay", "x": "ax"}), limit)
        return found.join(pairs.select("image", "a", "b", *keep).distinct(), ["image", "a", "b"]).select("image", "a", "b", *keep, "radii") if keep else found

    graph = sk.select("image", "y", "x", F.col("r").cast("double").alias("r"))
    ends = pairs.select("image", "a", "b", *keep, F.col("ay").alias("y"), F.col("ax").alias("x"), *[F.col(c).cast("long").alias(c) for c in ("by", "bx")]).dropna(subset=["y", "x", "by", "bx"])
    return _dealt(graph, ends, [], (2 * limit + 1) ** 2, whole, rounds, tables)


def _ways_in_rounds(sk: DataFrame, pairs: DataFrame, limit: int) -> DataFrame:
    """The same for images of any size: a frontier pixel carries the values on its way, no more than `limit`, so no way is traced back."""
    keys, pair = ["image", "a"], ["image", "a", "b"]
    graph = sk.select("image", "y", "x", F.col("r").cast("double").alias("r"))
    goals = pairs.select(*pair, F.col("by").alias("y"), F.col("bx").alias("x")).distinct().checkpoint()
    at = pairs.select(*keys, F.col("ay").alias("y"), F.col("ax").alias("x")).distinct().join(graph, ["image", "y", "x"])
    frontier, before = at.select(*keys, "y", "x", F.lit(1).alias("place"), F.array("r").alias("from")).checkpoint(), None
    done, n = [], 0
    while not frontier.isEmpty():
        found, n = goals.join(frontier, [*keys, "y", "x"]).select(*pair, F.col("from").alias("radii")).checkpoint(), n + 1
        done.append(found)
        if len(done) == GATHERED:
            done = [_together(done).checkpoint()]
        if n == limit:
            break
        if not found.isEmpty():  # who has found all its goals searches no more
            goals = goals.join(found, pair, "left_anti").checkpoint()
            frontier = frontier.join(goals.select(*keys).distinct(), keys, "left_semi")
        new = _looked_at(frontier, graph, keys, before)
        carried = F.struct("first.place", "first.k", F.array_append("first.from", F.col("r")).alias("from")).alias("first")
        frontier, before = _placed(new.select(*keys, "y", "x", carried), keys), frontier
    return _together(done) if done else goals.select(*pair, F.array().cast("array<double>").alias("radii"))
