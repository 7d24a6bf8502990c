"""Filters on halo tiles and skeleton relations against plain versions on whole planes."""

import itertools
import math
import random

import numpy as np
import pytest

from lumenfold.functions.numeric import natural_key
from lumenfold.operators import frames, grid, halo, skeletons, spatial, stats


def relation(spark, planes, kind="double"):
    rows = [(k, int(y), int(x), float(a[y, x]) if kind == "double" else int(a[y, x])) for k, a in planes.items() for y, x in zip(*np.nonzero(a))]
    return spark.createDataFrame(rows, f"image string, y long, x long, v {kind}").repartition(3)


def plane(rows, shape, image, value="v"):
    a = np.zeros(shape)
    for r in rows:
        if r.image == image:
            a[r.y, r.x] = r[value]
    return a


def reflected(i, n):
    i %= 2 * n
    return i if i < n else 2 * n - 1 - i


def at(a, y, x):
    return a[reflected(y, a.shape[0]), reflected(x, a.shape[1])]


def some_planes(shape, seed=1):
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 60, shape) * (rng.random(shape) < 0.6)
    b = np.zeros(shape)
    b[shape[0] // 2, 1:-1] = 50
    return {"a": a, "b": b, "c": np.where(rng.random(shape) < 0.02, 9, 0)}


def test_ridges_and_curvature_equal_plain_sums_for_any_tile(spark):
    shape, sigma = (23, 17), 1.2
    planes = some_planes(shape)
    px = relation(spark, planes)
    s = sigma / math.sqrt(2)
    r = int(8 * s + 0.5)
    g = [math.exp(-0.5 * (k / s) ** 2) for k in range(-r, r + 1)]
    g = [v / sum(g) for v in g]
    d = [v * k / s**2 for v, k in zip(g, range(-r, r + 1))]

    def twice(a, y, x, first, second):
        """The mixed or repeated derivative at a pixel: kernels of both passes, one after the other, on rows and columns."""
        (ry, rx), (sy, sx) = first, second
        wy, wx = np.convolve(ry, sy), np.convolve(rx, sx)
        return sum(wy[i] * wx[j] * at(a, y + i - 2 * r, x + j - 2 * r) for i in range(len(wy)) for j in range(len(wx)))

    want = {}
    for k, a in planes.items():
        for y, x in [(0, 0), (5, 16), (11, 8), (22, 3), (12, 1), (7, 7)]:
            yy, xx, yx = (twice(a, y, x, p, q) for p, q in (((d, g), (d, g)), ((g, d), (g, d)), ((d, g), (g, d))))
            root = math.sqrt(((yy - xx) / 2) ** 2 + yx**2)
            want[k, y, x] = ((yy + xx) / 2 + root, (yy + xx) / 2 - root)
    found = [halo.ridges(px, sigma, shape, tile).collect() for tile in (5, 8, 64)]
    curved = [halo.blobs_and_tubes(px, sigma, shape, tile).collect() for tile in (7, 64)]
    for k in planes:
        for other in found[1:]:
            assert np.allclose(plane(found[0], shape, k, "ridge"), plane(other, shape, k, "ridge"), atol=1e-8)
        assert np.allclose(plane(curved[0], shape, k, "blob"), plane(curved[1], shape, k, "blob"), atol=1e-6)
        ridge, blob, tube = plane(found[0], shape, k, "ridge"), plane(curved[1], shape, k, "blob"), plane(curved[1], shape, k, "tube")
        for (i, y, x), (big, small) in want.items():
            if i == k:
                assert abs(ridge[y, x] - sigma**2 * max(-small, 0)) < 1e-7
                if big <= -1e-5:
                    assert abs(blob[y, x] - big / small) < 1e-6 and abs(blob[y, x] + tube[y, x] - 1) < 1e-6
                elif big > -1e-7:
                    assert blob[y, x] == tube[y, x] == 0
    line = plane(found[0], shape, "b", "ridge")
    assert line.argmax() // shape[1] == shape[0] // 2 and line[0, 8] == 0


@pytest.mark.parametrize("tile", [4, 9, 64])
def test_openings_equal_plain_ones(spark, tile):
    shape = (19, 14)
    planes = some_planes(shape, 2)
    got = halo.top_hat(relation(spark, planes), 2, shape, tile).collect()
    box = list(itertools.product(range(-2, 3), repeat=2))
    disk = [(y, x) for y, x in itertools.product(range(-3, 4), repeat=2) if y * y + x * x <= 9]
    for k, a in planes.items():
        def pick(b, f, offsets):
            return np.array([[f(at(b, y + dy, x + dx) for dy, dx in offsets) for x in range(b.shape[1])] for y in range(b.shape[0])])

        assert (plane(got, shape, k) == a - pick(pick(a, min, box), max, box)).all()
        wide = np.pad(a, 12, mode="symmetric")
        assert (halo.opened(wide, 3, True)[12:-12, 12:-12] == pick(pick(a, min, disk), max, disk)).all()


def plain_background(a, r, step):
    small = a[::step, ::step].astype(float)
    n, m = small.shape
    every = [(y, x) for y in range(n) for x in range(m)]
    mean = np.zeros_like(small)
    for y, x in every:
        mean[y, x] = sum(at(small, y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)) / 9
    disk = [(y, x) for y, x in itertools.product(range(-r, r + 1), repeat=2) if y * y + x * x <= r * r]
    for f in (min, max):
        new = np.zeros_like(small)
        for y, x in every:
            new[y, x] = f(at(mean, y + i, x + j) for i, j in disk)
        mean = new
    k = int(4 * (r / 2) + 0.5)
    g = [math.exp(-0.5 * (i / (r / 2)) ** 2) for i in range(-k, k + 1)]
    soft = np.zeros_like(small)
    for y, x in every:
        soft[y, x] = sum(g[i + k] * g[j + k] * at(mean, y + i, x + j) for i in range(-k, k + 1) for j in range(-k, k + 1)) / sum(g) ** 2
    out = np.zeros(a.shape)
    for y, x in np.ndindex(*a.shape):
        py, px = y * (n - 1) / (a.shape[0] - 1), x * (m - 1) / (a.shape[1] - 1)
        iy, ix = min(int(py), n - 1), min(int(px), m - 1)
        fy, fx = py - iy, px - ix
        jy, jx = min(iy + 1, n - 1), min(ix + 1, m - 1)
        out[y, x] = (1 - fy) * ((1 - fx) * soft[iy, ix] + fx * soft[iy, jx]) + fy * ((1 - fx) * soft[jy, ix] + fx * soft[jy, jx])
    return out


@pytest.mark.parametrize("tile", [6, 16, 100])
def test_background_equals_a_plain_one_for_any_tile(spark, tile):
    shape = (41, 30)
    planes = some_planes(shape, 3)
    planes["a"] = planes["a"] + np.add.outer(np.arange(shape[0]), np.arange(shape[1]))
    for r, step in ((2, 2), (3, 3)):
        got = halo.without_background(relation(spark, planes), r, step, shape, tile).collect()
        for k, a in planes.items():
            assert np.allclose(plane(got, shape, k), np.maximum(a - plain_background(a, r, step), 0), atol=1e-7), (k, r, step)


def test_skeletons_of_tiles_equal_those_of_planes(spark):
    shape = (40, 33)
    rng = np.random.default_rng(4)
    blob = np.zeros(shape, int)
    blob[3:36, 4:29] = 1
    blob[10:14, 9:20] = 0
    planes = {"a": blob, "b": (rng.random(shape) < 0.7).astype(int), "c": np.eye(40, 33, dtype=int)}
    mask = relation(spark, planes, "long")
    for tile, steps in ((7, 2), (16, 3), (64, 1)):
        got = halo.skeleton(mask, shape, tile, steps).collect()
        for k, a in planes.items():
            b = a.astype(bool)
            while (c := halo.thin_once(b)).sum() < b.sum():
                b = c
            assert {(r.y, r.x) for r in got if r.image == k} == set(zip(*map(lambda v: v.tolist(), np.nonzero(b))))


def flood(pixels, steps):
    left, out = set(pixels), []
    while left:
        stack, part = [min(left)], set()
        while stack:
            p = stack.pop()
            if p in left:
                left.discard(p)
                part.add(p)
                stack += [(p[0] + a, p[1] + b) for a, b in steps]
        out.append(part)
    return out


def near8(pixels, p):
    return [q for a, b in grid.OFFSETS8 if (q := (p[0] + a, p[1] + b)) in pixels]


def plain_segments(pixels):
    degree = {p: len(near8(pixels, p)) for p in pixels}
    joints = flood([p for p in pixels if degree[p] >= 3], grid.OFFSETS8)
    of = {p: i for i, j in enumerate(joints) for p in j}
    out = []
    for part in flood([p for p in pixels if degree[p] < 3], grid.OFFSETS8):
        length = sum(math.dist(p, q) for p in part for q in near8(part, p)) / 2
        touched = {}
        for p in part:
            for q in near8(pixels, p):
                if q in of:
                    touched[p, of[q]] = min(touched.get((p, of[q]), 9), math.dist(p, q))
        out.append((part, length + sum(touched.values()), sum(degree[p] <= 1 for p in part), {j for _, j in touched}))
    return out, joints


def drawn(spark, seed):
    """Random walks on a plane."""
    rng = random.Random(seed)
    pixels = set()
    for _ in range(7):
        y, x, d = rng.randrange(30), rng.randrange(30), rng.choice(grid.OFFSETS8)
        for _ in range(rng.randint(2, 14)):
            pixels.add((y, x))
            if rng.random() < 0.2:
                d = rng.choice(grid.OFFSETS8)
            y, x = min(29, max(0, y + d[0])), min(29, max(0, x + d[1]))
    return pixels, spark.createDataFrame([("a", y, x) for y, x in pixels], "image string, y long, x long")


@pytest.mark.parametrize("seed", [1])
def test_segments_and_spurs_equal_plain_walks(spark, seed):
    pixels, sk = drawn(spark, seed)
    segments, joints = skeletons.parts(sk)
    got = {r.segment: (r.px, round(r.length, 5), r.tips, r.joints) for r in skeletons.measured(segments, joints).collect()}
    want, clusters = plain_segments(pixels)
    assert got == {min(y * (1 << 20) + x for y, x in p): (len(p), round(n, 5), t, len(j)) for p, n, t, j in want}
    # merged junctions
    root = list(range(len(clusters)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for part, *_ in want:
        if len(part) < 3:
            beside = sorted({i for i, c in enumerate(clusters) if any((y + a, x + b) in c for y, x in part for a, b in grid.OFFSETS4)})
            for i in beside[1:]:
                root[find(i)] = find(beside[0])
    by = {}
    for i, c in enumerate(clusters):
        by.setdefault(find(i), []).append(np.mean(list(c), axis=0))
    merged = sorted((round(r.y, 5), round(r.x, 5), r.merged) for r in skeletons.merged_junctions(segments, joints, 3).collect())
    assert merged == sorted((round(float(np.mean([c[0] for c in m])), 5), round(float(np.mean([c[1] for c in m])), 5), len(m)) for m in by.values())
    # spurs, until there are none
    now = set(pixels)
    while gone := set().union(*[p for p, _, t, j in plain_segments(now)[0] if t and j and len(p) <= 3]):
        now -= gone
    assert {(r.y, r.x) for r in skeletons.pruned(sk, 3).collect()} == now
    radius = spark.createDataFrame([("a", y, x, 1.0 + (y * 7 + x) % 4) for y, x in pixels], "image string, y long, x long, r double")
    kept = set(pixels)
    for part, length, tips, touched in want:
        if tips and touched:
            beside = [q for p in part for q in near8(pixels, p) if any(q in clusters[j] for j in touched)]
            if length < max(2 * max(1.0 + (y * 7 + x) % 4 for y, x in beside), 2.5):
                kept -= part
    assert {(r.y, r.x) for r in skeletons.pruned_by_width(sk, radius, 2, 2.5).collect()} == kept


@pytest.mark.parametrize("plain", [False, True])
def test_loops_are_cut_where_they_are_dimmest(spark, plain):
    rng = random.Random(5)
    pixels, _ = drawn(spark, 5)
    for y, x, h, w in ((2, 2, 4, 5), (2, 6, 4, 4), (12, 12, 9, 9), (20, 1, 3, 3), (25, 25, 4, 4)):  # rings, two that share a side
        pixels |= {(y + i, x + j) for i in range(h) for j in range(w) if i in (0, h - 1) or j in (0, w - 1)}
    value = {p: rng.randint(1, 9) for p in pixels}
    px = spark.createDataFrame([("a", *p, v) for p, v in value.items()], "image string, y long, x long, v long")
    now, most = set(pixels), 12
    for _ in range(8):
        ground = [(y, x) for y in range(30) for x in range(30) if (y, x) not in now]
        holes = [h for h in flood(ground, grid.OFFSETS4) if len(h) <= most and not any(y in (0, 29) or x in (0, 29) for y, x in h)]
        cut = set()
        for h in holes:
            steps = grid.OFFSETS8 if plain else grid.OFFSETS4
            ring = {(y + a, x + b) for y, x in h for a, b in steps} & now
            ring = [p for p in ring if not plain or len(near8(now, p)) == 2]
            if len(ring) >= (1 if plain else 3):
                cut.add(min(ring, key=lambda p: (value[p], p)))
        if not cut:
            break
        now -= cut
    for tile in (8, 64):
        got = skeletons.opened_loops(px, px, most, (30, 30), tile, plain)
        assert {(r.y, r.x) for r in got.collect()} == now
    assert now != pixels


def test_suppression_equals_the_sequential_order(spark):
    rng = random.Random(6)
    points = [(im, i, rng.uniform(-20, 20), rng.uniform(-20, 20), rng.randint(0, 9)) for im in ("a", "b") for i in range(150)] + [("c", i, i * 0.9, 0.0, 100 - i) for i in range(60)]
    df = spark.createDataFrame(points, "image string, id long, y double, x double, score long")
    kept = []
    for p in sorted(points, key=lambda p: (-p[4], p[1])):
        if not any(q[0] == p[0] and (q[2] - p[2]) ** 2 + (q[3] - p[3]) ** 2 < 9 for q in kept):
            kept.append(p)
    assert {(r.image, r.id) for r in spatial.suppressed(df, 3.0).collect()} == {p[:2] for p in kept}


def test_empty_planes(spark):
    none = spark.createDataFrame([], "image string, y long, x long, v double")
    shape = (9, 9)
    for df in (halo.ridges(none, 1.0, shape), halo.top_hat(none, 1, shape), halo.without_background(none, 2, 2, shape), halo.skeleton(none, shape), skeletons.measured(*skeletons.parts(none)), skeletons.merged_junctions(*skeletons.parts(none), 3), skeletons.pruned(none, 3), skeletons.opened_loops(none, none, 5, shape)):
        assert df.count() == 0


def test_nyquist_ratio_and_few_rows(spark):
    rng = np.random.default_rng(8)
    a = rng.normal(size=(16, 5))
    rows = [(z, y, x, float(v)) for z, b in ((1, a), (2, a[:5])) for (y, x), v in np.ndenumerate(b)]
    got = {r.z: r.ratio for r in frames.nyquist_ratio(spark.createDataFrame(rows, "z int, y long, x long, v double")).collect()}
    p = (np.abs(np.fft.rfft(a, axis=0)) ** 2).mean(1)
    assert abs(got[1] - p[-1] / np.median(p[4:8])) < 1e-5 and got[2] is None


def test_natural_order_counts_every_number(spark):
    names = ["a10b2", "a10b10", "a2b9", "a02b1", "b1", "a9" + "9" * 30, "a1" + "0" * 31, "", "7"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in df.orderBy(natural_key("n"), "n").collect()]
    assert got == ["", "7", "a02b1", "a2b9", "a10b2", "a10b10", "a9" + "9" * 30, "a1" + "0" * 31, "b1"]


def test_permutation_needs_two_units_a_side(spark):
    rows = [(i, "A" if i < k else "B", m, float(i * i % 7)) for m, k in (("x", 4), ("y", 1)) for i in range(9)] + [(99, "A", "y", None)]
    got = {r.metric: r.p for r in stats.permutation_p(spark.createDataFrame(rows, "u int, g string, metric string, value double"), "u", "g", "A", 19, 1).collect()}
    assert got["y"] is None and 0.05 <= got["x"] <= 1
