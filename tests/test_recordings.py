"""Recordings as files, translation, distances and volumes against plain versions."""

import math
import os
import random

import numpy as np
import pytest

from lumenfold.operators import morphology
from lumenfold.operators import registration as reg
from lumenfold.sources import record_files as rf


def volumes(spark, a):
    """a[t, z, c, y, x] as rows."""
    rows = [(t, z, [a[t, z, c].ravel().tolist() for c in range(a.shape[2])]) for t in range(a.shape[0]) for z in range(a.shape[1])]
    return spark.createDataFrame(rows, rf.SCHEMA).repartition(4)


def test_recording_round_trip_and_pruning(spark, tmp_path, monkeypatch):
    a = np.random.default_rng(1).integers(0, 65536, (23, 3, 2, 5, 4))
    a[0, 0, 0, 0, 0], a[0, 0, 0, 0, 1] = 70000, -5
    layout, path = rf.Layout(5, 4, 2, 3), str(tmp_path / "rec")
    rf.write_recording(volumes(spark, a), path, layout)
    want = np.clip(a, 0, 65535)
    names = sorted(n for n in os.listdir(path) if n.endswith(".rec"))
    raw = np.concatenate([np.fromfile(os.path.join(path, n), "<u2") for n in names])
    assert (65535 - raw.astype(int) == want.transpose(0, 1, 3, 4, 2).ravel()).all()  # channels next to each other
    got = rf.read_recording(spark, path, layout)
    assert {(r.t, r.z): r.planes for r in got.collect()} == {(t, z): [want[t, z, c].ravel().tolist() for c in range(2)] for t in range(23) for z in range(3)}
    px = {(r.t, r.z, r.c, r.y, r.x): r.v for r in rf.pixels(rf.read_recording(spark, path, layout, 4, 6), 4).collect()}
    assert px == {(t, z, c, y, x): want[t, z, c, y, x] for t in (4, 5) for z in range(3) for c in range(2) for y in range(5) for x in range(4)}
    # byte ranges: two times each, and only those asked for
    monkeypatch.setattr(rf, "PART_BYTES", 2 * layout.volume)
    reader = lambda **more: rf._Reader({"path": path, **rf._options(layout), **more})
    assert sum(p.times for p in reader().partitions()) == 23 and max(p.times for p in reader().partitions()) == 2
    assert [(p.first, p.times) for p in reader(first="21").partitions()] == [(21, 2)] or sum(p.times for p in reader(first="21").partitions()) == 2
    pushed = reader()
    kept = list(pushed.pushFilters([rf.GreaterThan(("t",), 9), rf.LessThanOrEqual(("t",), 12), rf.EqualTo(("z",), 1)]))
    assert len(kept) == 3 and sorted(t for p in pushed.partitions() for t in range(p.first, p.first + p.times)) == [10, 11, 12]
    one = str(tmp_path / "one.rec")
    raw.tofile(one)
    assert rf.read_recording(spark, one, layout, 20).count() == 9


def test_bad_recordings_are_named(spark, tmp_path):
    a = np.random.default_rng(2).integers(0, 100, (6, 2, 1, 3, 3))
    layout, path = rf.Layout(3, 3, 1, 2), str(tmp_path / "rec")
    df = volumes(spark, a)
    rf.write_recording(df, path, layout)
    with pytest.raises(Exception, match="exists"):
        rf.write_recording(df, path, layout)
    rf.write_recording(df.where("t < 4"), path, layout, overwrite=True)
    assert rf.read_recording(spark, path, layout).count() == 8
    with pytest.raises(Exception, match="was written as"):
        rf.read_recording(spark, path, rf.Layout(3, 3, 2, 1)).count()
    name = next(n for n in sorted(os.listdir(path)) if n.endswith(".rec"))
    with open(os.path.join(path, name), "r+b") as f:
        f.truncate(os.path.getsize(os.path.join(path, name)) - 2)
    with pytest.raises(Exception, match=f"{name} is cut off"):
        rf.read_recording(spark, path, layout).count()
    os.remove(os.path.join(path, name))
    with pytest.raises(Exception, match="is missing"):
        rf.read_recording(spark, path, layout).count()
    for bad, text in ((df.where("t <> 3"), "missing|should be"), (df.where("NOT (t = 2 AND z = 1)"), "should be"), (df.where("NOT (t = 5 AND z = 1)"), "planes of|should be"), (df.union(df.where("t = 0")), "should be|repeated"), (df.selectExpr("t", "z", "transform(planes, p -> slice(p, 1, 4)) AS planes"), "isn't of")):
        with pytest.raises(Exception, match=text):
            rf.write_recording(bad, str(tmp_path / "bad"), layout)
        assert not os.path.exists(tmp_path / "bad")


@pytest.mark.parametrize("dy,dx", [(0.0, 0.0), (1.0, -2.0), (0.25, 0.5), (-1.75, 3.125), (40.0, 0.5)])
def test_translation_equals_interpolation(spark, dy, dx):
    a = np.random.default_rng(3).integers(0, 900, (7, 9)).astype(float)
    frames = spark.createDataFrame([(1, y, x, float(v)) for (y, x), v in np.ndenumerate(a)], "t long, y long, x long, v double")
    shifts = spark.createDataFrame([(1, dy, dx)], "t long, dy double, dx double")

    def value(y, x):
        y0, x0 = math.floor(y), math.floor(x)
        return sum((a[j, i] if 0 <= j < 7 and 0 <= i < 9 else 0) * (1 - abs(y - j)) * (1 - abs(x - i)) for j in (y0, y0 + 1) for i in (x0, x0 + 1) if abs(y - j) < 1 and abs(x - i) < 1)

    want = np.array([[value(y - dy, x - dx) for x in range(9)] for y in range(7)])
    for whole in (False, True):
        out = np.zeros((7, 9))
        for r in reg.translated(frames, shifts, ["t"], 7, 9, whole).collect():
            out[r.y, r.x] = r.v
        assert np.allclose(out, np.floor(want + 0.5) if whole else want, atol=1e-7)


def test_distances_have_no_reach(spark):
    rng = random.Random(4)
    planes = {"a": {(y, x) for y in range(40) for x in range(70) if rng.random() < 0.9}, "b": {(y, x) for y in range(40) for x in range(70) if (y, x) != (39, 0)}, "c": {(y, x) for y in range(40) for x in range(70)}, "d": {(5, 5)}}
    df = spark.createDataFrame([(k, y, x) for k, p in planes.items() for y, x in p], "image string, y long, x long")
    got = {(r.image, r.y, r.x): r.d2 for r in morphology.exact_distances(df, 40, 70).collect()}
    assert len(got) == sum(map(len, planes.values())) and {got["c", y, x] for y, x in planes["c"]} == {None}
    assert got["d", 5, 5] == 1 and all(got["b", y, x] == (39 - y) ** 2 + x * x for y, x in planes["b"])
    out = np.array([(y, x) for y in range(40) for x in range(70) if (y, x) not in planes["a"]])
    for y, x in rng.sample(sorted(planes["a"]), 300):
        assert got["a", y, x] == ((out - [y, x]) ** 2).sum(1).min()


def test_volumes_find_their_shift():
    rng = np.random.default_rng(5)
    f = np.fft.fftn(rng.normal(size=(12, 10, 6)))
    f[3:-2, :, :], f[:, 3:-2, :] = 0, 0
    a = np.fft.ifftn(f).real
    assert reg.volume_shift(np.roll(a, (2, -3, 1), (0, 1, 2)), a) == (-2.0, 3.0, -1.0)
    assert reg.volume_shift(-np.roll(a, (1, 1, 0), (0, 1, 2)), a) == (-1.0, -1.0, 0.0)
    phase = np.exp(-2j * np.pi * np.fft.fftfreq(12) * 1.5)[:, None, None]
    half = np.fft.ifftn(np.fft.fftn(a) * phase).real
    assert reg.volume_shift(half, a)[0] == -1.5
    assert reg.volume_shift(np.ones((4, 4, 2)), np.ones((4, 4, 2)))[0:3] == (0.0, 0.0, 0.0)
    assert reg.volume_shift(a[:1], a[:1])[0] == 0.0
    for bad, factor in ((a[:, :, :1], 2), (a, 0), (a[:11], 1.5)):
        with pytest.raises(ValueError, match="can't be registered"):
            reg.volume_shift(bad, bad, factor)


def test_furthest_correlation_counts_with_either_sign(spark):
    a = np.random.default_rng(6).normal(size=(8, 8))
    a -= a.mean()
    assert reg.subpixel_shift(-np.roll(a, (2, 1), (0, 1)), a, 1) == (-2.0, -1.0)
    assert reg.subpixel_shift(a[:1], np.roll(a[:1], 3, 1), 10)[0] == 0.0
    rows = lambda b: spark.createDataFrame([(1, y, x, round(float(v) * 100)) for (y, x), v in np.ndenumerate(b)], "z long, y long, x long, v long")
    found = reg.whole_shifts(rows(-np.roll(a, (2, 1), (0, 1))), rows(a), ["z"], 8).collect()[0]
    assert (found.dy, found.dx) == (-2, -1) and found.peak < 0
