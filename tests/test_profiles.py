"""Skeletons as wholes and local scores against loops over dense planes."""

import numpy as np
import pytest

from lumenfold.operators import grid, halo, profiles, skeletons
from test_geodesics import walks


def walked(pixels):
    """Lengths of walks from tips, one after the other, as far as the first junction."""
    near = lambda p: [(p[0] + a, p[1] + b) for a, b in grid.OFFSETS8 if (p[0] + a, p[1] + b) in pixels]
    seen, out = set(), []
    for tip in sorted(p for p in pixels if len(near(p)) == 1):
        if tip in seen:
            continue
        seen.add(tip)
        before, now, n = None, tip, 1
        while len(near(now)) < 3:
            go = [p for p in near(now) if p != before]
            if len(go) != 1 or go[0] in seen:
                break
            before, now, n = now, go[0], n + 1
            seen.add(now)
        out.append(n)
    return sorted(out)


def frame(spark, planes):
    return spark.createDataFrame([(str(i), *p) for i, pixels in planes.items() for p in sorted(pixels)], "image string, y long, x long")


def test_profile_of_walks(spark):
    planes = {i: walks(i + 40, 10)[1] for i in range(5)}
    planes[5] = {(3, 3)} | {(8, x) for x in range(4)} | {(20, 4), (19, 5), (21, 5), (20, 6), (20, 5), (20, 7)}  # a pixel, a line, a cross
    wide = {i: {(y + a, x + b) for y, x in pixels for a in (0, 1, 2) for b in (0, 3)} for i, pixels in planes.items()} | {9: {(1, 1)}}
    sk = frame(spark, planes)
    got = {}
    for r in profiles.branches(*skeletons.parts(sk)).collect():
        got.setdefault(int(r.image), []).append(r.length)
    want = {i: walked(p) for i, p in planes.items()}
    assert {i: sorted(v) for i, v in got.items()} == {i: v for i, v in want.items() if v}
    rows = {int(r.image): r for r in profiles.skeleton_profile(sk, frame(spark, wide), 1000, [1, 3]).collect()}
    assert set(rows) == set(wide) and rows[9].n_skel == rows[9].n_branches == 0 and rows[9].within_3 == 0
    for i, p in planes.items():
        share = lambda k: sum(min((y - a) ** 2 + (x - b) ** 2 for a, b in p) <= k * k for y, x in wide[i]) / len(wide[i])  # noqa: E731, B023
        assert rows[i].n_skel == len(p) and rows[i].n_branches == len(want[i])
        assert (rows[i].within_1, rows[i].within_3) == pytest.approx((share(1), share(3)), abs=1e-6)
        assert rows[i].mean_branch_len == pytest.approx(np.mean(want[i]) if want[i] else 0, abs=1e-6)
        assert rows[i].short_spur_frac == pytest.approx(np.mean([n < 5 for n in want[i]]) if want[i] else 0, abs=1e-6)


def test_edge_band_of_a_square(spark):
    square = {(y, x) for y in range(2, 16) for x in range(2, 16)} - {(8, 8)}  # the hole is filled
    line = {(8, x) for x in range(4, 9)} | {(5, 8), (6, 8), (7, 8)}
    got = profiles.edge_band(frame(spark, {0: square, 1: {(0, 0)}}), frame(spark, {0: line}), 1, 4.0, 20)
    degree = {p: sum((p[0] + a, p[1] + b) in line for a, b in grid.OFFSETS8) for p in line}
    depth = {p: min(p[0] - 1, p[1] - 1, 16 - p[0], 16 - p[1]) for p in line}
    tips, joints = (sum(ok(degree[p]) and depth[p] < 4 for p in line) for ok in (lambda d: d == 1, lambda d: d >= 3))
    assert {(r.image, r.tips, r.joints) for r in got.collect()} == {("0", tips, joints), ("1", 0, 0)} and tips == 1


@pytest.mark.parametrize("shape, size, step", [((23, 17), 3, 4), ((16, 16), 5, 2), ((9, 30), 3, 8)])
def test_local_scores_over_any_tiles(spark, shape, size, step):
    a = np.random.default_rng(step).integers(0, 9, shape) * np.random.default_rng(1).integers(0, 2, shape)
    thin = a[::step, ::step].astype(float)
    r = size // 2

    def median(p):
        wide = np.pad(p, r, mode="symmetric")
        return np.array([[np.median(wide[y : y + size, x : x + size]) for x in range(p.shape[1])] for y in range(p.shape[0])])

    def grown(p):
        at = [np.arange(n) * ((m - 1) / (n - 1)) for m, n in zip(p.shape, shape, strict=True)]
        rows = np.array([np.interp(at[0], np.arange(p.shape[0]), p[:, x]) for x in range(p.shape[1])]).T
        return np.array([np.interp(at[1], np.arange(p.shape[1]), row) for row in rows])

    med = median(thin)
    want = (a - grown(med)) / np.maximum(1.4826 * grown(median(np.abs(thin - med))), 0.5)
    px = spark.createDataFrame([("i", y, x, int(a[y, x])) for y, x in zip(*(c.tolist() for c in np.nonzero(a)), strict=True)], "image string, y long, x long, v long")
    for tile in (2, 3, 256):
        got = halo.local_scores(px, size, step, 0.5, shape, tile).collect()
        assert len(got) == np.count_nonzero(a) and all(abs(g.z - want[g.y, g.x]) < 2e-6 for g in got)
    with pytest.raises(ValueError):
        halo.local_scores(px, 4, step, 0.5, shape)
