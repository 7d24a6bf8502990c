"""The detector on walks with random radii, against a plain one that goes part by part and pixel by pixel."""

from collections import deque

import numpy as np

from lumenfold.operators import detector, grid
from test_geodesics import walks
from test_seeds import parts_of


def plainly(r, v, g):
    pixels = set(r)
    near = lambda p, among: [q for a, b in grid.OFFSETS8 if (q := (p[0] + a, p[1] + b)) in among]
    reasons, found = {}, {}
    labels = parts_of(pixels)
    for label in set(labels.values()):
        part = sorted(p for p in pixels if labels[p] == label)
        degree = {p: len(near(p, pixels)) for p in part}
        peaks = []
        for p in sorted(part, key=lambda p: (-r[p], p)):
            if r[p] >= g.radius and v[p] >= g.bright and all((p[0] - a) ** 2 + (p[1] - b) ** 2 >= g.apart**2 for a, b in peaks):
                peaks.append(p)
        usual = np.median([r[p] for p in part])
        why = "too_small" if len(part) < g.pixels else "no_morphology" if not any(d == 1 or d >= 3 for d in degree.values()) else "no_fat_point" if not peaks else None
        if why is None and len(part) >= g.prominent_from and r[peaks[0]] < g.prominence * usual:
            why = "low_prominence"
        reasons[label] = why
        if why:
            continue
        owner, queue = {p: p for p in peaks}, deque(peaks)
        while queue:
            p = queue.popleft()
            for q in near(p, part):
                if q not in owner:
                    owner[q] = owner[p]
                    queue.append(q)
        for p in peaks:
            mine = [degree[q] for q in part if owner.get(q) == p]
            tips = sum(d == 1 for d in mine)
            if tips >= g.tips:
                low = max(g.ring_from, round(r[p]) + g.pad)
                ring = {q for q in pixels if low**2 <= (q[0] - p[0]) ** 2 + (q[1] - p[1]) ** 2 <= (low + g.ring) ** 2}
                found[p] = (tips, sum(d >= 3 for d in mine), len(mine), len(set(parts_of(ring).values())), low, len(part), len(peaks))
    return reasons, found


def test_cells_as_part_by_part(spark):
    g, rows, want_why, want = detector.Gates(pixels=5, radius=3.0, bright=0.3, apart=5, prominence=1.3, prominent_from=12, ring=4), [], {}, {}
    for seed in (1, 2, 3):
        rng, pixels = walks(seed + 70, 8)
        r, v = {p: rng.choice([1.0, 2.0, 2.5, 3.0, 3.5, 5.5]) for p in pixels}, {p: rng.choice([0.1, 0.4, 0.9]) for p in pixels}
        r |= {(40 + y, 40 + x): 5.0 for y in range(2) for x in range(2)} | {(50, x): 3.0 for x in range(14)} | {(60, x): 1.0 for x in range(6)}
        v |= {p: 0.5 for p in r if p not in v}
        rows += [(str(seed), *p, r[p], v[p]) for p in r]
        why, found = plainly(r, v, g)
        want_why |= {(str(seed), y * (1 << 20) + x): w for (y, x), w in why.items()}
        want |= {(str(seed), *p): f for p, f in found.items()}
    sk = spark.createDataFrame(rows, "image string, y long, x long, r double, v double")
    got_why = {(p.image, p.label): p.reason for p in detector.gated(detector.known(sk), g).collect()}
    assert got_why == want_why and {"too_small", "no_fat_point", "low_prominence", None} <= set(want_why.values())
    got = {(c.image, c.y, c.x): (c.n_endpoints, c.n_branches, c.skel_length, c.n_trunks, c.r_in, c.comp_skel_px, c.somas_in_comp) for c in detector.cells(sk, g).collect()}
    assert got == want and len(want) > 5
