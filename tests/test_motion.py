"""Motion put together, on frames moved by known amounts and against sums and loops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import motion, registration as reg
from test_registration import blob

SIDE = 24


def rows_of(spark, path, chunk=lambda t: 0):
    found = [(0, chunk(t), t, blob(SIDE, 11 - dy, 12 - dx).ravel().tolist()) for t, (dy, dx) in path.items()]
    return spark.createDataFrame(found, "z long, chunk long, t long, moving array<double>")


def shifts_of(df):
    return {r.t: (r.dy, r.dx) for r in df.collect()}


def test_places_and_totals_over_many_blocks(spark):
    rng = random.Random(1)
    times = {z: sorted(rng.sample(range(90), n)) for z, n in ((0, 40), (1, 7), (2, 1))}
    step = {(z, i): (rng.randint(-9, 9) / 4, rng.randint(-9, 9) / 4) for z, ts in times.items() for i in range(len(ts))}
    df = spark.createDataFrame([(z, t) for z, ts in times.items() for t in ts], "z long, t long")
    got = {(r.z, r.t): r.i for r in motion.numbered(df, 8).collect()}
    assert got == {(z, t): i for z, ts in times.items() for i, t in enumerate(ts)}
    total = lambda z, i, k: sum(step[z, j][k] for j in range(i + 1))
    want = {(z, i): tuple(total(z, i, k) - total(z, len(times[z]) // 2, k) for k in (0, 1)) for z, i in step}
    got = motion.composed(spark.createDataFrame([(z, i, *d) for (z, i), d in step.items()], "z long, i long, dy double, dx double"), 8).collect()
    assert {(r.z, r.i): (r.dy, r.dx) for r in got} == want


@pytest.mark.parametrize("dy, dx", [(0, 0), (2, -3), (0.25, -1.5), (30, 0)])
def test_moved_plane_is_the_relation_moved(spark, dy, dx):
    a = np.arange(1.0, 17.0).reshape(4, 4)
    px = spark.createDataFrame([(0, y, x, a[y, x].item()) for y in range(4) for x in range(4)], "t long, y long, x long, v double")
    want = np.zeros((4, 4))
    for r in reg.translated(px, spark.createDataFrame([(0, float(dy), float(dx))], "t long, dy double, dx double"), ["t"], 4, 4).collect():
        want[r.y, r.x] = r.v
    assert np.allclose(motion.moved_plane(a, dy, dx), want)


def test_chain_is_held_to_its_mean_where_it_can_be_trusted(spark):
    true = {t: (t / 4 - 1, 0.5 - t / 4) for t in range(9)}
    off = {t: (0.5 if t == 2 else 0.0, -0.75 if t == 5 else 0.0) for t in true}  # two links of the chain are wrong
    rows = rows_of(spark, true)
    rows = rows.union(spark.createDataFrame([(0, 0, 9, np.random.default_rng(0).normal(size=SIDE * SIDE).tolist())], rows.schema))  # nothing in common
    chain = spark.createDataFrame([(0, t, true[t][0] + off[t][0], true[t][1] + off[t][1]) for t in true] + [(0, 9, 0.25, 0.25)], "z long, t long, dy double, dx double")
    got = {r.t: r for r in motion.refined(rows, chain, SIDE, 2, 0.3).collect()}
    assert not got[9].accepted and (got[9].dy, got[9].dx) == (0.25, 0.25)
    middle = [got[t].dy - true[t][0] for t in true], [got[t].dx - true[t][1] for t in true]
    assert all(got[t].accepted for t in true) and max(map(np.ptp, middle)) <= 0.25 and np.ptp([o[1] for o in off.values()]) == 0.75
    none = motion.refined(rows, chain, SIDE, 0.0, 0.99).where("not accepted").collect()
    assert all(r.dy == pytest.approx(chain.where(f"t = {r.t}").first().dy) for r in none[:2]) and none
    with pytest.raises(ValueError):
        motion.inner(SIDE, 1.0)


def test_chunks_are_put_onto_the_first(spark):
    jump = {0: (0, 0), 1: (2, -1), 2: (-1.5, 0.5)}
    path = {t: jump[t // 4] for t in range(12)}
    rows = rows_of(spark, path, lambda t: t // 4)
    still = rows.select("z", "t", F.lit(0.0).alias("dy"), F.lit(0.0).alias("dx"))
    assert shifts_of(motion.anchored(rows, still, SIDE)) == {t: tuple(map(float, d)) for t, d in path.items()}


def test_time_is_steadied_and_nothing_is_left(spark):
    rng = random.Random(3)
    path, at = {}, [0.0, 0.0]
    for t in range(0, 60, 2):
        path[t] = tuple(at)
        at = [min(3.0, max(-3.0, a + rng.choice([-0.5, 0, 0.5]))) for a in at]
    path[40] = (path[40][0] + 2, path[40][1])  # a lurch of one frame is motion
    rows = rows_of(spark, path)
    got = shifts_of(motion.steadied(rows.drop("chunk"), SIDE, 4, first=10, block=16))
    off = np.array([[g - p for g, p in zip(got[t], path[t], strict=True)] for t in path])
    assert len(got) == len(path) and np.ptp(off, axis=0).max() <= 0.5
    before = np.array(list(shifts_of(motion.residual(rows.drop("chunk"), SIDE, 20)).values()))
    moved = motion.moved_rows(rows.drop("chunk"), spark.createDataFrame([(0, t, *d) for t, d in got.items()], "z long, t long, dy double, dx double"), ["z", "t"], SIDE)
    after = np.array(list(shifts_of(motion.residual(moved, SIDE, 20)).values()))
    assert np.hypot(*after.T).mean() < 0.3 * np.hypot(*before.T).mean()


def test_phase_scores_find_whole_rolls(spark):
    a = np.random.default_rng(2).normal(size=(16, 16))
    b = np.roll(a, (3, -5), (0, 1))
    sharp, r, dy, dx = motion.phase_score(b, a)
    assert (dy, dx) == (-3, 5) and r == pytest.approx(1) and sharp > 10
    assert motion.phase_score(np.ones((4, 4)), np.ones((4, 4)))[1:] == (0, 0, 0)
    df = spark.createDataFrame([(0, 1, b.ravel().tolist(), a.ravel().tolist())], "z long, t long, moving array<double>, fixed array<double>")
    assert motion.phase_scores(df, 16).first()[2:] == pytest.approx((sharp, r, dy, dx))


def test_planes_are_rescaled_between_their_median_and_a_knot(spark):
    a = [float(v) for v in range(100)]
    df = spark.createDataFrame([(0, 0, a), (0, 1, [5.0] * 4)], "z long, t long, moving array<double>")
    got = {r.t: r.moving for r in motion.rescaled(df).collect()}
    lo, hi = 49.5, 98.5
    assert got[0] == pytest.approx([round(1000 * (min(hi, max(lo, v)) - lo) / (hi - lo)) / 1000 for v in a]) and got[1] == [0.0] * 4
