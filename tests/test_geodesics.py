"""Ways along skeletons against queues, one after the other."""

import random
from collections import deque

import pytest

from lumenfold.operators import geodesics, grid, stacks


def walks(seed, n=9):
    rng = random.Random(seed)
    pixels = set()
    for _ in range(n):
        y, x, d = rng.randrange(26), rng.randrange(26), rng.choice(grid.OFFSETS8)
        for _ in range(rng.randint(3, 16)):
            pixels.add((y, x))
            if rng.random() < 0.25:
                d = rng.choice(grid.OFFSETS8)
            y, x = min(25, max(0, y + d[0])), min(25, max(0, x + d[1]))
    return rng, pixels


@pytest.mark.parametrize("seed", [1])
def test_first_arrival_has_the_order_of_a_queue(spark, seed):
    rng, pixels = walks(seed)
    sources = [(i, *rng.choice(sorted(pixels)), i) for i in range(5)] + [(9, 25, 0, 9)]
    sources.append((7, *sources[0][1:3], 7))  # on the pixel of another
    owner, hops, queue = {}, {}, deque()
    for i, y, x, _ in sorted(sources, key=lambda s: s[3]):
        if (y, x) in pixels:
            owner[y, x], hops[y, x] = i, 0
            queue.append((y, x))
    while queue:
        y, x = queue.popleft()
        for a, b in grid.OFFSETS8:
            p = (y + a, x + b)
            if p in pixels and p not in owner:
                owner[p], hops[p] = owner[y, x], hops[y, x] + 1
                queue.append(p)
    sk = spark.createDataFrame([("a", y, x) for y, x in pixels], "image string, y long, x long")
    df = spark.createDataFrame([("a", *s) for s in sources], "image string, id long, y long, x long, place long")
    got = {(r.y, r.x): (r.id, r.hops) for r in geodesics.attributed(sk, df).collect()}
    assert got == {p: (owner[p], hops[p]) for p in owner}


@pytest.mark.parametrize("seed", [1])
def test_starts_find_their_first_goal(spark, seed):
    rng, pixels = walks(seed + 5)
    goals = {p: rng.randint(1, 4) for p in rng.sample(sorted(pixels), 9)}
    starts = list(enumerate(rng.sample(sorted(pixels), 14)))
    want = {}
    for i, start in starts:
        if start in goals:
            want[i] = (goals[start], 0)
            continue
        seen, queue = {start}, deque([(start, 0)])
        while queue and i not in want:
            (y, x), h = queue.popleft()
            for a, b in grid.OFFSETS8:
                p = (y + a, x + b)
                if p in pixels and p not in seen:
                    if p in goals:
                        want[i] = (goals[p], h + 1)
                        break
                    seen.add(p)
                    queue.append((p, h + 1))
    frame = lambda rows, more: spark.createDataFrame(rows, f"image string, {more}")
    got = geodesics.first_reached(frame([("a", *p) for p in pixels], "y long, x long"), frame([("a", i, *p) for i, p in starts], "id long, y long, x long"), frame([("a", *p, g) for p, g in goals.items()], "y long, x long, label long"))
    assert {r.id: (r.label, r.hops) for r in got.collect()} == want


def test_no_sources_and_no_starts(spark):
    sk = spark.createDataFrame([("a", 1, 1)], "image string, y long, x long")
    none = spark.createDataFrame([], "image string, id long, y long, x long, place long, label long")
    assert geodesics.attributed(sk, none).count() == 0 and geodesics.first_reached(sk, none, none.select("image", "y", "x", "label")).count() == 0


def test_ways_take_few_jobs_however_long_and_large_images_take_rounds(spark, monkeypatch):
    """A line and some short walks: searched in tasks, in small blocks, and the walks in rounds with the line in tasks. Jobs don't follow the length of ways."""
    line = [("line", 5, x) for x in range(12)]
    rng, pixels = walks(3, 2)
    spots = rng.sample(sorted(pixels), 6)
    sk = spark.createDataFrame([(*p, float(p[2] % 7)) for p in line + [("walks", *p) for p in pixels]], "image string, y long, x long, r double")
    sources = spark.createDataFrame([("line", 1, 5, 0, 1), ("line", 2, 5, 11, 0)] + [("walks", i, *p, -i) for i, p in enumerate(spots[:3])], "image string, id long, y long, x long, place long")
    starts = spark.createDataFrame([("line", 1, 5, 2)] + [("walks", i, *p) for i, p in enumerate(spots[3:])], "image string, id long, y long, x long")
    goals = spark.createDataFrame([("line", 5, 11, 8)] + [("walks", *p, i) for i, p in enumerate(spots[:3])], "image string, y long, x long, label long")
    pairs = spark.createDataFrame([("line", 1, 2, 5, 0, 5, 11)] + [("walks", i, j, *p, *q) for i, p in enumerate(spots) for j, q in enumerate(spots) if i < j], "image string, a long, b long, ay long, ax long, by long, bx long")

    def found():
        tables = geodesics.attributed(sk, sources), geodesics.first_reached(sk, starts, goals), geodesics.ways_between(sk, pairs, 60)
        return [sorted(map(tuple, df.collect())) for df in tables]

    spark.sparkContext.setJobGroup("ways", "ways")
    whole = found()
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("ways")) < 40
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert ("line", 1, 8, 9) in whole[1] and ("line", 5, 5, 1, 5) in whole[0] and len(whole[2][0][3]) == 12
    monkeypatch.setattr(stacks, "CELLS", 100)  # blocks of few starts
    assert found() == whole
    monkeypatch.setattr(geodesics, "PIXELS", 12)
    assert len(pixels) > 12 and found() == whole
