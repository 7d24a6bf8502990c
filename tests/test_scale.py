"""What grows with the tables: plans without pairs of points, written out squares and disks, or broadcast products of an explode."""

import hashlib
import random
from statistics import mean

import pytest

from lumenfold.jobs import cell_queries, mask_queries, more_queries, plane_queries
from lumenfold.operators import detector, grid, roi_block, rois, spatial, stacks, stats
from lumenfold.operators import morphology as mo


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def crowd():
    rng = random.Random(5)
    spots = [(rng.randrange(40), rng.randrange(40)) for _ in range(25)]
    return [(i, *spots[i % 25]) for i in range(400)] + [(3, *spots[3])]  # many at one place, one label twice


def test_points_of_one_place_are_counted_not_paired(spark):
    rows = crowd()
    df = spark.createDataFrame(rows, "label long, yc long, xc long")
    near = lambda a, b: (a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2 <= 49
    n = {}
    for a in rows:
        n[a[0]] = n.get(a[0], 0) + sum(near(a, b) and a[0] != b[0] for b in rows)
    found = spatial.crowded(df, 7, 20)
    assert {r.label: r.n for r in found.collect()} == {k: v for k, v in n.items() if v >= 20}
    assert "Join [cy" not in plan_of(found)
    left, right = df.where("label % 3 <> 0"), df.where("label % 3 = 0 AND label < 30")
    first = {a[0]: min(((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2, b[0]) for b in rows if b[0] % 3 == 0 and b[0] < 30) for a in rows if a[0] % 3}
    got = spatial.nearest(left, right, 7)
    assert {r.label: (r.d2, r.match) for r in got.collect()} == {k: v if v[0] <= 49 else (None, None) for k, v in first.items()}
    assert "Join [cy" not in plan_of(got) and got.schema["d2"].dataType.simpleString() == "bigint"


@pytest.mark.parametrize("query", [mask_queries.radius_prominence, mask_queries.local_counts, mask_queries.nearest_mask_pixel, mask_queries.seeds_outside_boxes])
def test_squares_around_points_are_not_broadcast(spark, sf, query):
    plan = plan_of(query(spark, sf))
    assert "BroadcastHashJoin [image" not in plan and "explode(sequence(-" not in plan


def test_ring_pixels_are_not_broadcast(spark, sf):
    plan = plan_of(spatial.ring_pixels(mask_queries._seeds(spark, sf), mask_queries._mask(spark, sf), 3, 9))
    assert "BroadcastHashJoin" not in plan and "explode(sequence(-" not in plan


def test_local_scores_take_one_pass(spark, sf):
    plan = plan_of(more_queries.local_scores(spark, sf))
    assert "Join" not in plan and "explode(sequence(-" not in plan


@pytest.mark.parametrize("query", [mask_queries.mask_dilation, mask_queries.mask_erosion, mask_queries.mask_closing, mask_queries.mask_distances])
def test_disks_are_not_written_out(spark, sf, query):
    plan = plan_of(query(spark, sf))
    assert "explode([[" not in plan and "explode(array" not in plan and "Join" not in plan


@pytest.mark.parametrize("query", [plane_queries.ridges, plane_queries.seed_curvature, plane_queries.top_hat, plane_queries.without_background, plane_queries.skeleton])
def test_tiles_are_filtered_in_stacks(spark, sf, query):
    plan = plan_of(query(spark, sf))
    assert "FlatMapGroupsInPandas" not in plan and "MapInPandas" in plan


def test_neighbours_are_counted_without_a_join(spark):
    px = spark.createDataFrame([("a", y, x) for y in range(-3, 3) for x in range(254, 260)] + [("a", 200, 200), (None, 0, 0), (None, 0, 1)], "image string, y long, x long")
    found = grid.degree(px)
    assert "Join" not in plan_of(found)
    there = {(r.image, r.y, r.x) for r in px.collect()}
    assert {(r.image, r.y, r.x): r.degree for r in found.collect()} == {(i, y, x): sum((i, y + dy, x + dx) in there for dy, dx in grid.OFFSETS8) for i, y, x in there}


def test_boxes_are_laid_on_planes(spark):
    rng = random.Random(8)
    rows = [(s, i, x, x + rng.randrange(1, 7), y, y + rng.randrange(1, 7)) for s in range(4) for i in rng.sample(range(20), 9) for x, y in [(rng.randrange(12), rng.randrange(12))]]
    boxes = spark.createDataFrame([(*r, (r[3] - r[2]) * (r[5] - r[4])) for r in rows], "sample long, id long, x0 long, x1 long, y0 long, y1 long, area long")
    found = rois.covered(boxes)
    assert "explode" not in plan_of(found)
    cells = lambda r: {(y, x) for y in range(r[4], r[5]) for x in range(r[2], r[3])}
    before = lambda r: {c for o in rows if o[0] == r[0] and o[1] < r[1] for c in cells(o)}
    assert {(r.sample, r.id): r.overlap for r in found.collect()} == {r[:2]: len(cells(r) & before(r)) for r in rows}


def test_cells_of_regions_are_not_broadcast(spark):
    boxes = roi_block.keyed(spark.createDataFrame([(1, 1, 0, 9, 0, 9, 81)], "sample long, id long, x0 long, x1 long, y0 long, y1 long, area long"))
    kept, share = roi_block.kept_cells(boxes, spark.createDataFrame([(1, 0, 0)], "sample long, ty long, tx long"), 4)
    layer = spark.createDataFrame([(1, 2, 2)], "sample long, y long, x long")
    for df in (kept, share, roi_block.view(boxes, layer)):
        assert "BroadcastHashJoin" not in plan_of(df)


def test_pixels_beside_others_are_found_in_tiles(spark):
    a = spark.createDataFrame([("i", 0, 0, 1), ("i", 5, 5, 2), ("i", 191, 3, 3)], "image string, y long, x long, a long")
    b = spark.createDataFrame([("i", 1, 1, 7), ("i", 0, 1, 8), ("i", 192, 4, 9), ("j", 5, 6, 9)], "image string, y long, x long, b long")
    met = grid.beside(a, "a", b, "b", grid.OFFSETS8)
    assert "Join" not in plan_of(met)
    assert {(r.image, r.y0, r.x0, r.y, r.x, r.a, r.b) for r in met.collect()} == {("i", 0, 0, 1, 1, 1, 7), ("i", 0, 0, 0, 1, 1, 8), ("i", 191, 3, 192, 4, 3, 9)}


def test_parts_are_known_without_a_join(spark):
    sk = spark.createDataFrame([("a", 0, 0, 1.0, 0.5), ("a", 1, 1, 2.0, 0.1), ("b", 300, 255, 3.0, 0.2), ("b", 300, 256, 1.5, 0.4)], "image string, y long, x long, r double, v double")
    assert "Join" not in plan_of(detector.known(sk.where("image = 'a'")))  # in one tile
    found = detector.known(sk)
    got = {(r.image, r.y, r.x, r.r, r.v, r.degree, r.label) for r in found.collect()}
    far = 300 * (1 << 20) + 255
    assert got == {("a", 0, 0, 1.0, 0.5, 1, 0), ("a", 1, 1, 2.0, 0.1, 1, 0), ("b", 300, 255, 3.0, 0.2, 1, far), ("b", 300, 256, 1.5, 0.4, 1, far)}


def test_gates_take_no_join_of_pixels(spark, sf):
    assert "Join" not in plan_of(cell_queries.part_gates(spark, sf))


def test_edges_are_near_without_windows(spark, sf):
    plan = plan_of(cell_queries.edge_band(spark, sf))
    assert "Window" not in plan and "explode" not in plan.replace("explode(sequence(cast(FLOOR", "").replace("explode(sequence(FLOOR", "")


def test_small_planes_are_filled_in_tasks(spark, monkeypatch):
    rng = random.Random(2)
    px = {(i, y, x) for i in "abc" for y in range(14) for x in range(14) if rng.random() < (0.6 if i == "a" else 0.75)} | {("d", 3, 3), ("a", -1, 5), ("a", 20, 7)}
    mask = spark.createDataFrame(sorted(px), "image string, y long, x long")
    found = mo.filled(mask, 14)
    assert "Join" not in plan_of(found) and "explode" not in plan_of(found)
    whole = sorted(map(tuple, found.collect()))
    monkeypatch.setattr(stacks, "TILE", 0)  # as planes larger than a tile are
    assert whole == sorted(map(tuple, mo.filled(mask, 14).collect())) and len(whole) > len(px)


def test_permutations_order_one_bucket_of_a_draw(spark):
    rng = random.Random(4)
    rows = [(u, "a" if u % 3 == 0 else "b", m, float(rng.randrange(9)) if rng.random() < 0.9 else None) for u in range(60) for m in ("m", "n")]
    rows += [(u, "a" if u == 0 else "b", "few", 1.0) for u in range(5)]
    want = {}
    for m in ("m", "n", "few"):
        of = [(u, g, v) for u, g, k, v in rows if k == m and v is not None]
        na = sum(g == "a" for _, g, _ in of)
        if na < 2:
            want[m] = None
            continue
        apart = lambda a, b: mean(v for *_, v in a) - mean(v for *_, v in b)
        d, hits = apart([r for r in of if r[1] == "a"], [r for r in of if r[1] != "a"]), 0
        for k in range(1, 31):
            order = sorted(of, key=lambda r: hashlib.md5(f"7:{k}:{r[0]}".encode()).hexdigest())  # noqa: B023
            hits += abs(apart(order[:na], order[na:])) >= abs(d) - 1e-12
        want[m] = (hits + 1) / 31
    found = stats.permutation_p(spark.createDataFrame(rows, "unit long, side string, metric string, value double"), "unit", "side", "a", 30, 7)
    assert "bucket" in plan_of(found)
    got = {r.metric: r.p for r in found.collect()}
    assert got["few"] is None and {k: pytest.approx(v) for k, v in want.items() if v} == {k: v for k, v in got.items() if v}
