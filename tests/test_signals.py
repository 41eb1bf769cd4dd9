import numpy as np

from traceloom.functions.peaks import find_peaks, schmitt, zero_phase_butterworth
from traceloom.operators import detection, images, masks, signals, stats
from pyspark.sql import functions as F


def trace(spark, values, name="t", start=0):
    return spark.createDataFrame([(name, start + i, float(i), None if v is None else float(v)) for i, v in enumerate(values)], "trace_id string, idx long, t double, v double")


def test_interpolation(spark):
    rows = trace(spark, [0, 10, 100, 30, 400, 50])
    got = signals.interpolated(rows, "v", F.col("idx").isin(0, 3), "idx", "y").orderBy("idx")
    assert [r["y"] for r in got.collect()] == [10, 10, 100, 250, 400, 50]
    none = signals.interpolated(trace(spark, [None, None]), "v", F.lit(False), "idx", "y")
    assert [r["y"] for r in none.collect()] == [0, 0]


def test_block_means(spark):
    assert [r["v"] for r in signals.block_means(trace(spark, range(1, 10)), 4, ["v"]).orderBy("idx").collect()] == [2.5, 6.5]


def test_regions_over_pieces(spark):
    on = [3, 4, 7, 8, 9, 10, 15, 16, 17, 31, 32]
    rows = trace(spark, [1 if i in on else 0 for i in range(40)])
    got = sorted((r["start"], r["end"]) for r in masks.regions_of(rows, F.col("v") > 0, 8).collect())
    assert got == [(3, 5), (7, 11), (15, 18), (31, 33)]
    assert sorted((r["start"], r["end"]) for r in masks.merged(masks.regions_of(rows, F.col("v") > 0), 4).collect()) == [(3, 18), (31, 33)]


def test_spikes_over_pieces(spark, monkeypatch):
    rng = np.random.default_rng(5)
    x = rng.normal(0, 0.1, 3000)
    for at in (200, 205, 999, 1000, 2500):
        x[at] = 9 + at / 100
    whole = {r["spike_index"] for r in detection.threshold_spikes(trace(spark, x), "v").collect()}
    monkeypatch.setattr(detection, "PIECE", 1000)
    monkeypatch.setattr(detection, "HALO", 200)
    cut = {r["spike_index"] for r in detection.threshold_spikes(trace(spark, x), "v").collect()}
    assert whole == cut == {205, 1000, 2500}


def test_waveform_calibration(spark):
    ramp = [0, 2, 4, 6, 8, 10, 8, 6, 4, 2, 0]
    rows = trace(spark, [0] * 5 + ramp + [0] * 5)
    spikes = spark.createDataFrame([("t", 10)], "trace_id string, spike_index long")
    got = detection.waveforms(rows, spikes, "v", 5).first()
    assert got["rise"] == 4.0 and got["fwhm"] == 5.0 and abs(got["back"] - 4.5) < 1e-9


def test_peaks_and_trigger():
    x = np.array([0, 3, 0, 5, 5, 5, 0, 4, 0.0])
    assert find_peaks(x, 1).tolist() == [1, 4, 7] and find_peaks(x, 1, 4).tolist() == [4] and find_peaks(x, 1, 1, 3.5).tolist() == [4, 7]
    on = schmitt(np.array([0, 5, 5, 2, 2, 0, 0, 5.0]), np.full(8, 4.0), np.full(8, 1.0), 2, 2)
    assert on.tolist() == [False, True, True, True, True, False, False, False]


def test_filter_keeps_what_it_should():
    t = np.arange(500) / 1000
    slow, fast = np.sin(2 * np.pi * 8 * t), 0.5 * np.sin(2 * np.pi * 160 * t)
    y = zero_phase_butterworth(slow + fast, 1000, 40, 5, False, 400)
    assert np.abs(y - slow)[50:-50].max() < 0.02


def test_motion(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(0, 1, (16, 16))
    frames = [(0, i, 16, 16, np.roll(base, s, (0, 1)).ravel().tolist()) for i, s in enumerate([(0, 0), (0, 0), (0, 0), (1, -2)])]
    df = spark.createDataFrame(frames, "stack long, frame long, height int, width int, pixels array<double>")
    got = {r["frame"]: (r["dy"], r["dx"]) for r in images.motion_shifts(df, 3).collect()}
    assert got == {0: (0, 0), 1: (0, 0), 2: (0, 0), 3: (-1, 2)}
    again = {r["frame"]: (r["dy"], r["dx"]) for r in images.motion_shifts(df, 3, "mean", 2).collect()}
    assert again == got == {r["frame"]: (r["dy"], r["dx"]) for r in images.motion_shifts(df, 3, "first").collect()}
    boxes = spark.createDataFrame([(0, i + 1, i * 8, 0, i * 8 + 8, 16) for i in range(2)], "stack long, roi long, x0 long, y0 long, x1 long, y1 long")
    tiles = images.tile_shifts(df, boxes, 16, 8, 1).collect()
    assert len(tiles) == 8 and all((r["dy"], r["dx"]) == (0, 0) for r in tiles if r["frame"] < 3)


def test_components(spark):
    px = [(0, 0), (0, 1), (1, 2), (4, 4), (5, 5), (9, 0)]
    got = images.components(spark.createDataFrame([(1, y, x) for y, x in px], "k long, y long, x long"), ["k"])
    assert len({r["component"] for r in got.collect()}) == 3


def test_wide_and_narrow_windows_agree(spark, monkeypatch):
    x = np.random.default_rng(2).normal(size=700).round(2)
    rows = trace(spark, x)
    for edges in ("nearest", "reflect"):
        narrow = {r["idx"]: r["y"] for r in signals.rolling_rank(rows, "v", 6, "y", 30.0, edges).collect()}
        monkeypatch.setattr(signals, "WIDE", 2)
        monkeypatch.setattr(signals, "PIECE", 100)
        wide = {r["idx"]: r["y"] for r in signals.rolling_rank(rows, "v", 6, "y", 30.0, edges).collect()}
        monkeypatch.undo()
        assert narrow == wide and len(wide) == 700


def test_long_plateau(spark):
    rng = np.random.default_rng(34)
    x = 200 + 0.04 * rng.normal(size=700)
    x[320:360] += 20
    got = [(r["start"], r["end"]) for r in detection.long_plateaus(trace(spark, x), "v", half=100).collect()]
    assert len(got) == 1 and abs(got[0][0] - 320) <= 2 and abs(got[0][1] - 360) <= 10


def test_shifts_between_pixels_and_flat_frames(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(12, 16))
    assert images.estimate_shift(x, np.ones((12, 16)), 2) == (0.0, 0.0, 0.0, 0.0, False) == images.estimate_shift(np.ones((12, 16)), x, 2)
    flat = images.move(x, 0.5, -0.25)
    fill = np.median(x)
    for (y, c), v in np.ndenumerate(flat):
        a, b = y - 0.5, c + 0.25
        y0, c0 = int(np.floor(a)), int(np.floor(b))
        inside = y0 >= 0 and y0 + 1 < 12 and c0 >= 0 and c0 + 1 < 16
        want = 0.5 * (0.75 * x[y0, c0] + 0.25 * x[y0, c0 + 1]) + 0.5 * (0.75 * x[y0 + 1, c0] + 0.25 * x[y0 + 1, c0 + 1]) if inside else fill
        assert abs(v - want) < 1e-12
    assert (images.move(x, 1, -2)[1:, :-2] == x[:-1, 2:]).all() and (images.move(x, 1, -2)[0] == fill).all()
    dy, dx, *_ , ok = images.estimate_shift(x, np.roll(x, (-1, 2), (0, 1)), 3, subpixel=True, least_ratio=1.2)
    assert ok and abs(dy - 1) < 0.3 and abs(dx + 2) < 0.3


def test_whole_table_percentiles_by_rank(spark, monkeypatch):
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=6000), np.full(5000, 0.25), [np.nan] * 0])
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    got = stats.whole_percentiles(df, "v", [0.0, 0.25, 0.5, 0.75, 1.0])
    assert np.allclose(got, np.quantile(x, [0, 0.25, 0.5, 0.75, 1]))
    assert stats.whole_percentiles(df.where("v > 100"), "v", [0.5]) == [None]
