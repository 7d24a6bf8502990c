"""Cleaned skeletons against a plain evaluation: loops until none is left that can be opened, radii however large."""

import random

import numpy as np
from pyspark.sql import functions as F

from lumenfold.jobs import plane_queries
from lumenfold.operators import grid, halo, skeletons
from lumenfold.operators import morphology as mo
from test_planes import flood, near8, plain_segments

SIDE = plane_queries.SIDE


def drawn(seed, density, side=SIDE):
    rng = random.Random(seed)
    return {(y, x): rng.randint(1, 50) for y in range(side) for x in range(side) if rng.random() < density}


def bar(thick, tall):
    """A thick bar with a bump."""
    return {(y, x): 1 + (y * 5 + x) % 9 for y in range(8 - tall, 8 + thick) for x in range(2, 29) if y >= 8 or x == 15}


def thinned(mask, side=SIDE):
    a = np.zeros((side, side), bool)
    a[tuple(zip(*mask, strict=True))] = True
    while ((b := halo.thin_once(a)) != a).any():
        a = b
    return set(map(tuple, np.argwhere(a).tolist()))


def opened(line, value, most, side=SIDE):
    """The pixels that are left, and in how many rounds."""
    now, rounds = set(line), 0
    while True:
        holes = [h for h in flood([(y, x) for y in range(side) for x in range(side) if (y, x) not in now], grid.OFFSETS4) if len(h) <= most and not any(y in (0, side - 1) or x in (0, side - 1) for y, x in h)]
        rings = [[p for p in {(y + a, x + b) for y, x in h for a, b in grid.OFFSETS8} & now if len(near8(now, p)) == 2] for h in holes]
        cut = {min(ring, key=lambda p: (value[p], p)) for ring in rings if ring}
        if not cut:
            return now, rounds
        now, rounds = now - cut, rounds + 1


def radii(mask):
    ground = np.array([(y, x) for y in range(SIDE) for x in range(SIDE) if (y, x) not in mask]).reshape(-1, 2)
    return {p: ((ground - p) ** 2).sum(1).min() ** 0.5 if len(ground) else np.inf for p in mask}


def pruned(line, r):
    kept = set(line)
    segments, clusters = plain_segments(line)
    for part, length, tips, touched in segments:
        if tips and touched:
            wide = max(r[q] for p in part for q in near8(line, p) if any(q in clusters[j] for j in touched))
            if round(length, 6) < max(1.5 * max(wide, 1), 3):
                kept -= part
    return kept


def test_nothing_is_left_out_of_clean_lines(spark, tmp_path):
    planes = {k: drawn(k, 0.44) for k in range(1, 7)} | {7: drawn(7, 0.97), 8: drawn(8, 0.99), 9: bar(11, 3), 10: bar(13, 4), 11: drawn(11, 1.1), 12: {(9, 9): 3}}
    alone = drawn(99, 0.44)  # order lines without a supplier
    rows = [(k, y, x, float(v)) for k, plane in [*planes.items(), (None, alone)] for (y, x), v in plane.items()] + [(1, -5, 3, 9.0), (1, None, 3, 9.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_orderkey long, l_quantity double").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {}
    for r in plane_queries.clean_lines(spark, str(tmp_path)).collect():
        got.setdefault(r.image, []).append((r.y, r.x))
    assert all(len(set(v)) == len(v) for v in got.values())
    most, capped = [], []
    for k, plane in planes.items():
        line, rounds = opened(thinned(plane), plane, 20)
        r = radii(plane)
        want = pruned(line, r)
        assert set(got.get(k, ())) == want
        most.append(rounds)
        capped.append(want != pruned(line, {p: v if v <= 4 else 1.0 for p, v in r.items()}))
    assert max(most) > 3 and any(capped)  # three rounds, or radii up to 4, make something else
    assert set(got[None]) == thinned(alone)


def test_planes_are_opened_in_tasks_as_by_rounds_over_tiles(spark):
    side, rows = 20, []
    for k in "abcdef":
        rows += [(k, y, x, v if v % 7 else None) for (y, x), v in drawn(ord(k), 0.45, side).items()]
    rows += [(None, y, x, 1) for y, x in ((3, 4), (4, 3), (4, 5), (5, 4))]  # a loop without an image stays
    px = spark.createDataFrame(rows, "image string, y long, x long, v long")
    found = skeletons.opened_planes(px, 12, side)
    got = sorted(map(str, found.select("image", "y", "x").collect()))
    lines = halo.skeleton(px, (side, side))
    by_tiles = skeletons.opened_loops(lines, px, 12, (side, side), 5, plain=True)
    assert got == sorted(map(str, by_tiles.collect())) and len(got) < lines.count()
    exact = found.join(mo.exact_distances(px, side, side).withColumnRenamed("d2", "want"), ["image", "y", "x"])
    assert exact.where(F.abs(F.col("r") * F.col("r") - F.col("want")) > 1e-9).isEmpty() and exact.count() == len(got) - 4


def test_distances_of_stacks_reach_any_background():
    rng = np.random.default_rng(4)
    a = rng.random((6, 9, 23)) < np.array([0.5, 0.9, 0.98, 0.99, 1.1, -1])[:, None, None]
    a[3] = True
    a[3, 8, 0] = False
    ground = [np.argwhere(~p) for p in a]
    want = [[[((g - (y, x)) ** 2).sum(1).min() if len(g) else np.inf for x in range(23)] for y in range(9)] for g in ground]
    assert (mo.far_outside(a) == np.array(want)).all()
