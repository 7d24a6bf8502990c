"""Ways between seeds and what they decide, against a plain search one pair after the other."""

import random
from collections import deque

from lumenfold.operators import geodesics, grid, seeds, spatial
from test_geodesics import walks


def way(pixels, start, goal):
    before, queue = {start: None}, deque([start])
    while queue and goal not in before:
        y, x = queue.popleft()
        for a, b in grid.OFFSETS8:
            p = (y + a, x + b)
            if p in pixels and p not in before:
                before[p] = (y, x)
                queue.append(p)
    out, p = [], goal if goal in before else None
    while p is not None:
        out.append(p)
        p = before[p]
    return out[::-1]


def plain_neck(radii, lim):
    end, n = min(radii[0], radii[-1]), len(radii)
    middle = radii[lim.trim : n - lim.trim] if n > 2 * lim.trim else [radii[n // 2]]
    most = now = 0
    for r in middle:
        now = now + 1 if r < min(end / 2, lim.thin) else 0
        most = max(most, now)
    return min(middle) / (end + 1e-6), most


def test_values_along_ways_are_those_of_a_queue(spark):
    want, pixels_of, pairs_of = {}, [], []
    for seed in (1, 2, 3):
        rng, pixels = walks(seed, 12)
        r = {p: float(rng.randint(1, 9)) for p in pixels}
        spots = dict(enumerate(rng.sample(sorted(pixels), 10)))
        spots[10] = spots[0]  # two on one pixel
        pairs = [(a, b) for a in spots for b in spots if a < b]
        want |= {(str(seed), a, b): w for a, b in pairs if 0 < len(w := [r[p] for p in way(pixels, spots[a], spots[b])]) <= 11}
        pixels_of += [(str(seed), *p, v) for p, v in r.items()]
        pairs_of += [(str(seed), a, b, *spots[a], *spots[b]) for a, b in pairs]
    sk = spark.createDataFrame(pixels_of, "image string, y long, x long, r double")
    df = spark.createDataFrame(pairs_of, "image string, a long, b long, ay long, ax long, by long, bx long")
    assert {(g.image, g.a, g.b): g.radii for g in geodesics.ways_between(sk, df, 11).collect()} == want
    assert ("1", 0, 10) in want and geodesics.ways_between(sk, df.limit(0), 11).count() == 0


def test_necks_by_a_loop(spark):
    rng, lim = random.Random(5), seeds.Limits(trim=3)
    rows = [(i, [rng.choice([0.5, 1.0, 2.0, 6.0]) for _ in range(2 + i % 11)]) for i in range(99)]
    got = {g.i: g for g in seeds.necks(spark.createDataFrame([*rows, (99, [1.0])], "i long, radii array<double>"), lim).collect()}
    assert set(got) == set(range(99))
    for i, radii in rows:
        neck, run = plain_neck(radii, lim)
        assert abs(got[i].neck - neck) < 1e-12 and got[i].run == run and got[i].n == len(radii)


def plainly(found, pixels, r, mask_parts, lim):
    """The decision one seed and one pair after the other."""
    def snap(y, x):
        for reach in range(lim.snap + 1):
            box = [p for p in pixels if abs(p[0] - y) <= reach and abs(p[1] - x) <= reach]
            if box:
                return min(box, key=lambda p: ((p[0] - y) ** 2 + (p[1] - x) ** 2, p))

    kind, into, parted, unsure = {s[0]: s[4] for s in found}, {}, {s[0]: set() for s in found}, {s[0]: set() for s in found}
    at = {s[0]: (s, snap(*s[1:3]), mask_parts.get(s[1:3])) for s in found if s[4] != "process_peak"}
    at = {i: v for i, v in at.items() if v[1] and v[2] is not None}

    def between(a, b):
        (s, p, m), (t, q, k) = at[a], at[b]
        d2 = (s[1] - t[1]) ** 2 + (s[2] - t[2]) ** 2
        path = way(pixels, p, q) if m == k and d2 <= lim.way**2 else []
        return (d2, len(path), *plain_neck([r[c] for c in path], lim)) if 2 <= len(path) <= lim.way else None

    strong = sorted((i for i in at if kind[i] == "strong"), key=lambda i: (-at[i][0][3], i))
    for w in [i for i in at if kind[i] == "weak"]:
        best = min(((m[1], k, s, m) for k, s in enumerate(strong) if (m := between(w, s))), default=None)
        kind[w] = "low_confidence_soma"
        if best and (best[3][0] <= lim.same**2 or (best[3][2] < lim.demote and best[3][3] >= lim.run)):
            kind[w], into[w] = "process_peak", best[2]
    kept, again = list(strong), True
    while again:
        again = False
        parted, unsure = {i: set() for i in parted}, {i: set() for i in unsure}
        for i, a in enumerate(kept):
            for b in kept[i + 1 :]:
                m = between(a, b)
                if m is None:
                    continue
                necked = m[2] < lim.split and m[3] >= lim.run
                if m[0] <= lim.same**2 and not necked:
                    kind[b], into[b], again = "merged_into_strong", a, True
                    kept.remove(b)
                    break
                for s, t in ((a, b), (b, a)):
                    (parted if necked else unsure)[s].add(t)
            if again:
                break
    return {i: (kind[i], into.get(i), sorted(parted[i]), sorted(unsure[i])) for i in kind}


def parts_of(mask):
    parts = {}
    for p in sorted(mask):
        if p not in parts:
            parts[p], queue = p, deque([p])
            while queue:
                y, x = queue.popleft()
                for a, b in grid.OFFSETS8:
                    q = (y + a, x + b)
                    if q in mask and q not in parts:
                        parts[q] = p
                        queue.append(q)
    return parts


def test_seeds_as_one_after_the_other(spark):
    lim, want, lines, masks, all_ = seeds.Limits(way=11, trim=2, snap=2, same=5, run=2), {}, [], [], []
    for seed in (1, 2, 3, 4):
        rng, pixels = walks(seed + 20, 14)
        r = {p: rng.choice([0.5, 1.0, 4.0, 5.0]) for p in pixels}
        mask = {(y + a, x + b) for y, x in pixels for a in (-1, 0, 1) for b in (-1, 0, 1)}
        found = [(i, *rng.choice(sorted(mask)), rng.randint(1, 6) / 4, rng.choice(["strong", "strong", "weak", "process_peak"])) for i in range(34)]
        found += [(50, 60, 60, 1.0, "strong"), (51, 60, 60, 1.0, "weak")]  # off the mask
        want |= {(str(seed), i): v for i, v in plainly(found, pixels, r, parts_of(mask), lim).items()}
        lines, masks, all_ = lines + [(str(seed), *p, v) for p, v in r.items()], masks + [(str(seed), *p) for p in mask], all_ + [(str(seed), *s) for s in found]
    sk = spark.createDataFrame(lines, "image string, y long, x long, r double")
    df = spark.createDataFrame(all_, "image string, id long, y long, x long, score double, type string")
    got = seeds.resolved(df, sk, spark.createDataFrame(masks, "image string, y long, x long"), lim)
    assert {(g.image, g.id): (g.type, g.into, g.parted, g.unsure) for g in got.collect()} == want
    assert {"merged_into_strong", "process_peak", "low_confidence_soma", "weak"} <= {v[0] for v in want.values()} and any(v[2] for v in want.values()) and any(v[3] for v in want.values())


def test_chains_of_waiting_are_kept_in_order(spark):
    waits = spark.createDataFrame([("i", k, k - 1) for k in range(1, 8)], "image string, id long, for long").checkpoint()
    assert {g.id for g in spatial.lost_in_order(waits).collect()} == {1, 3, 5, 7}
