import numpy as np

from traceloom.operators import detection, images, plateaus, signals
from pyspark.sql import functions as F

from tests.test_signals import trace


def found(spark, x):
    return [(r["start"], r["end"], r["confidence"]) for r in plateaus.short_plateaus(trace(spark, x).withColumn("fs", F.lit(1000.0)), "v").collect()]


def test_short_plateau_and_offset_baseline(spark):
    x = 0.05 * np.random.default_rng(1).normal(size=400)
    x[120:170] += 8
    got = found(spark, x + 0.1)
    assert len(got) == 1 and abs(got[0][0] - 120) <= 2 and abs(got[0][1] - 170) <= 2 and got[0][2] >= 0.65


def test_no_plateau_in_noise_and_spikes(spark):
    rng = np.random.default_rng(2)
    noisy = 0.05 * rng.normal(size=400)
    noisy[90:210] += 1.4 * rng.normal(size=120)
    noisy[120:170] += 4.5
    assert found(spark, noisy) == []
    spikes = 0.05 * rng.normal(size=500)
    spikes[[100, 180, 260, 340]] += 24
    assert found(spark, spikes) == []


def classified(spark, traces, regions, noise=0.05):
    rows = [(k, i, float(a), None if b is None else float(b), noise) for k, (x, y) in traces.items() for i, (a, b) in enumerate(zip(x, y))]
    df = spark.createDataFrame(rows, "trace_id string, idx long, raw double, den double, noise double").withColumn("fs", F.lit(1000.0))
    cut = spark.createDataFrame(regions, "trace_id string, start long, end long")
    return {r["trace_id"]: r for r in plateaus.signal_types(plateaus.signal_metrics(df, cut, "raw", "den", "noise")).collect()}


def test_signal_types(spark):
    base = np.zeros(260)
    base[80:180] = 6.0
    wave = base.copy()
    wave[80:180] += 0.02 * np.sin(np.linspace(0, 2 * np.pi, 100))
    spiky = base.copy()
    spiky[[95, 120, 145, 170]] += 8.0
    noisy, mixed, kept = base.copy(), base.copy(), base.copy()
    noisy[80:180] += 1.1 * np.random.default_rng(4).standard_normal(100)
    mixed[80:180] += 0.7 * np.random.default_rng(8).standard_normal(100)
    mixed[[96, 124, 152, 172]] += 8.0
    kept[[96, 124, 152, 172]] += 4.0
    traces = {"clean": (base, wave), "spike_like": (spiky, spiky), "noise_like": (noisy, base), "mixed": (mixed, kept), "unknown": (base, [None] * 260)}
    got = classified(spark, traces, [(k, 80, 180) for k in traces])
    assert {k: r["signal_type"] for k, r in got.items()} == {k: k for k in traces}
    assert got["spike_like"]["kept"] >= 0.75 and got["noise_like"]["noise_reduction"] > 0.5 and got["unknown"]["confidence"] is None
    assert got["mixed"]["density_smooth"] > 0 and got["mixed"]["kept"] > 0 and got["mixed"]["residual_fraction"] > 0.25
    assert classified(spark, {"short": (base, base)}, [("short", 80, 82)])["short"]["signal_type"] == "unknown"


def test_signal_types_dont_see_pieces(spark, monkeypatch):
    rng = np.random.default_rng(9)
    x = 5 + rng.normal(size=900)
    y = np.convolve(x, np.ones(5) / 5, "same")
    whole = classified(spark, {"t": (x, y)}, [("t", 50, 850)])["t"]
    for module in (detection, signals):
        monkeypatch.setattr(module, "PIECE", 100)
    assert classified(spark, {"t": (x, y)}, [("t", 50, 850)])["t"] == whole


def test_floors_of_confidence():
    floors = {(kind, least) for kind, _, least in plateaus.KINDS}
    assert ("mixed", 0.45) in floors and ("mixed", 0.35) in floors and ("noise_like", 0.45) in floors


def test_tracking(spark):
    rng = np.random.default_rng(4)
    block = 50 + rng.normal(0, 5, (4, 4))
    frames = []
    for i, (dy, dx) in enumerate([(0, 0), (0, 0), (0, 0), (1, 0), (1, 1), (0, 1), (0, 0), (0, 0)]):
        f = rng.normal(0, 0.5, (16, 16))
        f[6 + dy : 10 + dy, 6 + dx : 10 + dx] += block
        frames.append((0, i, 16, 16, f.ravel().tolist()))
    df = spark.createDataFrame(frames, "stack long, frame long, height int, width int, pixels array<double>")
    weights = spark.createDataFrame([(1, y, x, 1.0) for y in range(5, 11) for x in range(5, 11)], "mask long, y long, x long, w double")
    got = {r["frame"]: (r["dy"], r["dx"], r["state"]) for r in images.tracked_masks(df, weights).collect()}
    assert [got[i][:2] for i in range(8)] == [(0, 0), (0, 0), (0, 0), (1, 0), (1, 1), (0, 1), (0, 0), (0, 0)] and {g[2] for g in got.values()} == {"accepted"}
