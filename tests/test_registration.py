"""Registration kernels on frames moved by known amounts, resampling against its definitions, files there and back."""

import numpy as np
import pytest

from lumenfold.operators import halo, registration as reg, rois, stats
from lumenfold.sources import files


def blob(side, y, x):
    a, b = np.mgrid[:side, :side]
    return 100 * np.exp(-((a - y) ** 2 + (b - x) ** 2) / 6) + 40 * np.exp(-((a - y - 4) ** 2 + (b - x + 5) ** 2) / 4)


@pytest.mark.parametrize("dy, dx", [(0, 0), (2, -3), (0.25, 0.5), (-1.37, 2.81)])
def test_subpixel_shift_of_moved_frame(dy, dx):
    a, b = blob(32, 15, 16), blob(32, 15 + dy, 16 + dx)
    got = reg.subpixel_shift(a, b, 100)
    assert abs(got[0] - dy) <= 0.02 and abs(got[1] - dx) <= 0.02
    with pytest.raises(ValueError):
        reg.subpixel_shift(a, np.full((32, 32), np.nan))


def test_ties_go_to_the_first_column():
    assert reg.subpixel_shift(np.ones((4, 6)), np.ones((4, 6)), 1) == (0, 0)
    a = np.zeros((4, 4))
    a[0, 0] = 1
    b = np.zeros((4, 4))
    b[0, 1] = b[1, 0] = 1
    assert reg.subpixel_shift(a, b, 1) == (1, 0)


def test_upsampled_piece_equals_the_inverse_transform():
    c = np.fft.fft2(np.random.default_rng(1).normal(size=(6, 8)))
    assert np.allclose(reg.upsampled(c, 6, 1, (0, 0))[:, :6].real / 48, np.fft.ifft2(c).real[:, :6])


def test_fourier_shift_moves_and_clears_the_wrapped_band():
    a = np.arange(1, 17, dtype=float).reshape(4, 4)
    whole = reg.fourier_shifted(a, 1, -1)
    assert (whole[1:, :3] == a[:3, 1:]).all() and (whole[0] == 0).all() and (whole[:, 3] == 0).all()
    assert np.allclose(reg.fourier_shifted(blob(32, 15, 16), 0.5, 0.25)[2:-2, 2:-2], blob(32, 15.5, 16.25)[2:-2, 2:-2], atol=0.5)


def test_resampling_keeps_constants_and_samples_cubics():
    for n, to in ((8, 4), (8, 16), (5, 7), (9, 9)):
        w = reg.resize_weights(n, to)
        assert np.allclose(w.sum(1), 1)
    assert np.allclose(reg.resize_weights(9, 9), np.eye(9))
    assert np.allclose(reg.resized(np.full((6, 8), 3.0), 3, 5), 3)
    assert np.allclose(reg.blurred(np.full((6, 8), 3.0), 1.3), 3)


def planes(spark, moved):
    rows = [(t, 0, y, x, int(round(v))) for t, (dy, dx) in enumerate(moved) for (y, x), v in np.ndenumerate(100 * blob(16, 7 + dy, 8 + dx))]
    return spark.createDataFrame(rows, "t long, z long, y long, x long, v long")


def test_shifts_of_frames_as_relations_and_kernels(spark):
    moved = [(0, 0), (1, -1), (0, 2), (-1, 0)]
    f = planes(spark, moved)
    fixed = f.where("t = 0").drop("t")
    whole = reg.whole_shifts(f.select("t", "z", "y", "x", "v"), fixed.crossJoin(f.select("t").distinct()), ["z", "t"], 16)
    assert {r.t: (r.dy, r.dx) for r in whole.collect()} == {t: (-dy, -dx) for t, (dy, dx) in enumerate(moved)}
    rows = reg.as_rows(f, ["z", "t"], "moving")
    fine = reg.registered(rows.join(reg.as_rows(fixed, ["z"], "fixed"), "z"), 16, 10)
    assert all(abs(r.dy + moved[r.t][0]) <= 0.1 and abs(r.dx + moved[r.t][1]) <= 0.1 and r.ncc > 0.95 for r in fine.collect())
    chain = {r.t: (r.dy, r.dx) for r in reg.chained(rows.selectExpr("z", "0 as chunk", "t", "moving"), 16, 10).collect()}
    assert chain[2] == (0, 0) and all(abs(chain[t][i] - (moved[2][i] - moved[t][i])) <= 0.2 for t in range(4) for i in (0, 1))
    gate = reg.trusted(spark.createDataFrame([(1.0, 0.0, 0.9), (3.0, 0.0, 0.9), (1.0, 1.0, 0.1)], "dy double, dx double, ncc double"), 2, 0.5)
    assert [(r.dy, r.dx) for r in gate.collect()] == [(1, 0), (0, 0), (0, 0)]


def test_files_there_and_back(spark, tmp_path):
    r = spark.createDataFrame([(1, 1, 0, 0, 5, 5), (1, 2, 3, 3, 5, 5), (2, 1, 0, 0, 9, 9)], files.ROI)
    files.write_rois(r, str(tmp_path / "rois"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(files.read_rois(spark, str(tmp_path / "rois"))) == key(r)
    new = files.upserted(r, spark.createDataFrame([(1, 7, 7, 2, 2, 1), (3, 8, 8, 2, 2, 1)], "sample long, x long, y long, w long, h long, at long"), r.where("sample = 1 and id = 1").select("sample", "id"))
    assert key(new) == [(1, 2, 3, 3, 5, 5), (1, 3, 7, 7, 2, 2), (2, 1, 0, 0, 9, 9), (3, 1, 8, 8, 2, 2)]
    files.write_csv(r, str(tmp_path / "csv"))
    assert key(files.read_csv(spark, str(tmp_path / "csv"), files.ROI)) == key(r)
    f = planes(spark, [(0, 0)] * 5)
    files.write_frames(f, str(tmp_path / "frames"), 2)
    assert key(files.read_frames(spark, str(tmp_path / "frames"), 1, 4, 2)) == key(f.where("t >= 1 and t < 4"))
    assert files.incomplete(f, 256).count() == 0 and files.incomplete(f.where("t > 0 or x > 0"), 256).count() == 1


def test_overlap_counts_shared_area_once(spark):
    r = spark.createDataFrame([(1, 1, 0, 0, 4, 4), (1, 2, 0, 0, 4, 4), (1, 3, 2, 2, 4, 4)], files.ROI)
    assert sorted((x.id, x.overlap) for x in rois.covered(rois.cropped(r, 10)).collect()) == [(1, 0), (2, 16), (3, 4)]


def test_screen_of_known_values(spark):
    rows = [("a", "WT", 1.0), ("a", "HET", 2.0), ("a", "HET", 2.5), ("b", "WT", 1.0), ("b", "HET", 1.1), ("b", "HET", 9.0), ("c", "WT", 1.0), ("c", "HET", 1.0), ("c", "HET", 2.0), ("d", "WT", 0.0), ("d", "HET", 1.0)]
    got = {r.m: (r.verdict, r.pct) for r in stats.replicate_screen(spark.createDataFrame(rows, "m string, c string, v double"), "m", "c", "v", "WT").collect()}
    assert got == {"a": ("CLEAN", 125.0), "b": ("same-side", 405.0), "c": ("disagree", 50.0), "d": ("n/a", None)}


def thinned(a):
    while (b := halo.thin_once(a)).sum() < a.sum():
        a = b
    return a


def test_thin_lines_stay_connected():
    a = np.zeros((12, 20), bool)
    a[4:8, 2:18] = True
    t = thinned(a)
    assert t.sum() < 20 and t.any() and not (t & ~a).any()
    assert (thinned(np.eye(9, dtype=bool)) == np.eye(9, dtype=bool)).all()
