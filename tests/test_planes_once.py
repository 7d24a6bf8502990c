"""Steps that deal planes once and carry what they know of a pixel along, against the same steps one by one."""

import random

from pyspark.sql import functions as F

from lumenfold.operators import detector, geodesics, grid, halo, seeds
from lumenfold.operators import morphology as mo
from test_geodesics import walks
from test_scale import plan_of

SIDE = 16


def scenes(spark):
    """Random planes, one with pixels beside it, one with nothing else, a square, a pixel without a value, and rows without a place."""
    rng = random.Random(3)
    rows = [(i, y, x, rng.randrange(100)) for i in "abc" for y in range(SIDE) for x in range(SIDE) if rng.random() < 0.7]
    rows += [("a", -1, x, 90) for x in range(-2, 9)] + [("a", SIDE, 3, 95), ("d", 4, 4, 80), ("d", 4, 5, 80), ("d", 5, 4, 80), ("d", 5, 5, 80), ("e", 2, 2, None), ("e", 2, 3, 70), ("e", 2, 4, 70)]
    rows += [("f", -3, -3, 80), ("a", None, 3, 99), ("b", 3, None, 99), (None, 3, 3, 99)]
    return spark.createDataFrame(rows, "image string, y long, x long, v long")


def one_by_one(px):
    radius = mo.distances(px, SIDE, 4).select("image", "y", "x", F.sqrt(F.coalesce("d2", F.lit(25))).alias("r"))
    return halo.skeleton(px, (SIDE, SIDE), SIDE).join(radius, ["image", "y", "x"])


def test_seeds_are_placed_where_planes_are_dealt_once(spark):
    px, lim = scenes(spark).checkpoint(), seeds.Limits(snap=2)
    found = seeds.placed_on_planes(px, 4, 60, lim, SIDE)
    assert "Join" not in plan_of(found) and plan_of(found).count("Exchange") == 1
    whole, lines = px.dropna(subset=["image", "y", "x"]), one_by_one(px)
    at = whole.where("v >= 60").select("image", (F.col("y") * SIDE + F.col("x")).alias("id"), "y", "x", F.col("v").cast("double").alias("score"), F.lit("weak").alias("type"))
    want = seeds.placed(at, lines, whole, lim).select("image", "y", "x", "part", "sy", "sx")
    got = found.where("sy IS NOT NULL").select("image", "y", "x", "part", "sy", "sx")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("y < 0").count() > 2
    assert sorted(map(tuple, found.where("line").select("image", "y", "x", "r").collect())) == sorted(map(tuple, lines.select("image", "y", "x", "r").collect()))
    assert {r.v for r in found.where("image = 'e'").collect()} == {None, 70}


def test_seeds_meet_in_wide_cells(spark):
    rng = random.Random(6)
    rows = [(i, k, rng.randrange(-30, 30), rng.randrange(-30, 30), rng.randrange(4) / 4, rng.choice(["strong", "weak"]), rng.randrange(2)) for i in "ab" for k in range(120)]
    at = spark.createDataFrame(rows, "image string, id long, y long, x long, score double, type string, part long").withColumns({"sy": F.col("y"), "sx": F.col("x")})
    near = seeds.pairs(at, 3)
    assert "explode([[" not in plan_of(near) and "explode(array" not in plan_of(near)  # no seed is copied to the nine cells around it
    first = lambda a, b: a[5] == "weak" or (-a[4], a[1]) < (-b[4], b[1])
    want = {(a[0], a[1], b[1]) for a in rows for b in rows if a[0] == b[0] and a[6] == b[6] and b[5] == "strong" and first(a, b) and (a[2] - b[2]) ** 2 + (a[3] - b[3]) ** 2 <= 9}
    got = [(r.image, r.a, r.b) for r in near.collect()]
    assert set(got) == want and len(got) == len(want) > 30


def test_ways_keep_what_pairs_carry(spark, monkeypatch):
    rng, pixels = walks(4, 9)
    spots = rng.sample(sorted(pixels), 8)
    sk = spark.createDataFrame([("i", *p, 1.0) for p in pixels], "image string, y long, x long, r double").checkpoint()
    pairs = spark.createDataFrame([("i", a, b, *spots[a], *spots[b], a + b / 8, None if a == 2 else a) for a in range(8) for b in range(a)], "image string, a long, b long, ay long, ax long, by long, bx long, far double, k int").checkpoint()
    plain = {(r.image, r.a, r.b): r.radii for r in geodesics.ways_between(sk, pairs, 40).collect()}
    for most in (geodesics.PIXELS, 0):
        monkeypatch.setattr(geodesics, "PIXELS", most)
        found = geodesics.ways_between(sk, pairs, 40, ["far"], tables=True).collect()
        assert {(r.image, r.a, r.b): r.radii for r in found} == plain and all(r.far == r.a + r.b / 8 for r in found) and len(found) > 5


def test_parts_are_known_where_planes_are_dealt_once(spark):
    px = scenes(spark).checkpoint()
    found = detector.known_on_planes(px, 4, SIDE, 100)
    assert "Join" not in plan_of(found) and plan_of(found).count("Exchange") == 1
    lines = one_by_one(px).join(px.select("image", "y", "x", (F.col("v") / 100).alias("v")), ["image", "y", "x"])
    columns = ["image", "y", "x", "r", "v", "degree", "label"]
    assert sorted(map(str, found.select(columns).collect())) == sorted(map(str, detector.known(lines).select(columns).collect()))
    assert detector.known_on_planes(px.where("image = 'f'"), 4, SIDE, 100).count() == 0


def test_first_arrival_keeps_what_pixels_carry(spark, monkeypatch):
    rng, pixels = walks(7, 9)
    sk = grid.degree(spark.createDataFrame([("i", *p) for p in pixels], "image string, y long, x long")).checkpoint()
    at = spark.createDataFrame([("i", k, *p, k) for k, p in enumerate(rng.sample(sorted(pixels), 4))], "image string, id long, y long, x long, place int").checkpoint()
    want = sorted(map(tuple, geodesics.attributed(sk, at).join(sk, ["image", "y", "x"]).select("y", "x", "id", "hops", "degree").collect()))
    for most in (geodesics.PIXELS, 0):
        monkeypatch.setattr(geodesics, "PIXELS", most)
        assert want == sorted(map(tuple, geodesics.attributed(sk, at, ["degree"], tables=True).select("y", "x", "id", "hops", "degree").collect()))


def test_rings_for_trunks_are_not_written_out(spark):
    at = spark.createDataFrame([("i", 1, 0, 0, 1.0), ("i", 2, 40, -40, 9.0)], "image string, id long, y long, x long, r double")
    sk = spark.createDataFrame([("i", 0, x) for x in range(-30, 31)] + [("i", y, -40) for y in range(20, 80)], "image string, y long, x long")
    found = detector.trunks(at, sk, detector.Gates())
    assert "explode(sequence(-" not in plan_of(found) and "BroadcastHashJoin [image#" not in plan_of(found).split("MapInPandas")[1]
    assert sorted(tuple(r) for r in found.select("id", "r_in", "r_out", "n_trunks").collect()) == [(1, 3, 9, 2), (2, 11, 17, 2)]
