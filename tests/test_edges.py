import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_signals import trace
from traceloom.operators import analysis, images, signals
from traceloom.session import cut_lineage


def rates(spark, fs=1000.0):
    return spark.createDataFrame([("t", fs)], "trace_id string, fs double")


def regions(spark, *spans):
    return spark.createDataFrame([("t", a, b) for a, b in spans], "trace_id string, start long, end long")


def edges(df):
    return sorted((r["start"], r["end"]) for r in df.collect())


def plateau(n=600):
    x = 0.1 * np.random.default_rng(5).normal(size=n)
    x[200:210] += np.linspace(1, 10, 10)
    x[210:300] += 10
    x[300:310] += np.linspace(9, 0, 10)
    return x


def by_hand(x, start, end, blocked=None):
    """Edges at 1,000 samples a second, looked for one place after the other."""
    n, free = len(x), np.ones(len(x), bool) if blocked is None else ~blocked
    slope = np.concatenate([[0, 0], x[2:] - x[:-2]])
    spread = lambda v: max(np.median(np.abs(v - np.median(v))), 1e-9)
    steep, low = 3 * spread(slope[free]), np.median(x[free]) + 2 * spread(x[free])
    holds = lambda ok, i, k: i >= 0 and i + k <= n and (ok & free)[i : i + k].all()
    after = next((i + 3 for i in range(start - 3, max(0, start - 50) - 1, -1) if holds(np.abs(slope) <= steep, i, 3)), start)
    onset = next((j for j in range(after, min(n, after + 20)) if holds(slope > steep, j, 2)), start if min(n, after + 20) + 1 > n else after)
    offset = next((i for i in range(end, min(n, end + 50) - 4) if holds(x <= low, i, 5)), end)
    return onset, max(onset + 1, min(offset, n))


def test_edges_follow_the_slope(spark):
    x = plateau()
    want = [by_hand(x, 206, 303)]
    assert abs(want[0][0] - 200) <= 2 and abs(want[0][1] - 310) <= 3
    assert edges(analysis.refined_edges(trace(spark, x), regions(spark, (206, 303)), "v", rates(spark))) == want


def test_edges_at_the_ends_without_rates_and_blocked(spark):
    rng = np.random.default_rng(6)
    x = 0.1 * rng.normal(size=300)
    x[:20] += 5
    x[290:] += 5
    spans = [(0, 18), (291, 300)]
    assert edges(analysis.refined_edges(trace(spark, x), regions(spark, *spans), "v", rates(spark))) == [by_hand(x, *s) for s in spans]
    none = spark.createDataFrame([], "trace_id string, fs double")
    assert edges(analysis.refined_edges(trace(spark, x), regions(spark, *spans), "v", none)) == []
    assert edges(analysis.refined_edges(trace(spark, x), regions(spark, (5, 6)).limit(0), "v", rates(spark))) == []
    y, blocked = plateau(), np.zeros(600, bool)
    blocked[240:250] = True
    a, b = by_hand(y, 206, 303, blocked)
    df = trace(spark, y).withColumn("bad", (F.col("idx") >= 240) & (F.col("idx") < 250))
    assert edges(analysis.refined_edges(df, regions(spark, (206, 303)), "v", rates(spark), "bad")) == [(a, 240), (250, b)]


def test_profiles(spark):
    x = np.full(200, 2.0)
    x[50:90] = 6.0
    df, spans = trace(spark, x), regions(spark, (50, 90), (5, 7), (120, 140))
    got = {r["start"]: r["profile"] for r in analysis.profiles(df, spans, "v", rates(spark), 96).collect()}
    assert set(got) == {50}  # one is too short, the other has no height
    context = (x[30:110] - 2) / 4
    assert np.allclose(got[50], np.interp(np.linspace(0, 1, 96), np.linspace(0, 1, 80), context))


def test_audit_names_the_step(spark):
    x = plateau(1500)
    x[600:602] += 9  # too few samples above the entry level to go on
    x[1000:1012] += 9  # goes on, but for too short a time
    audit = cut_lineage(analysis.plateau_audit(trace(spark, x), "v", rates(spark), half=300, enter=4, leave=4, shortest=30))
    rows = {r["start"] // 100: r for r in audit.collect()}
    assert rows[2]["stage"] == "accepted" and rows[2]["accepted"] and rows[2]["duration_ms"] == rows[2]["samples"]
    assert rows[6]["stage"] == "entry_sustain"
    assert rows[10]["stage"] == "minimum_duration" and not rows[10]["accepted"]
    assert rows[10]["near_miss"] == pytest.approx(rows[10]["peak"] - rows[10]["entry"])
    cut = analysis.rejected(audit, spark.createDataFrame([("t", 700, 1500)], "trace_id string, offset long, n long")).collect()
    assert [r["start"] for r in cut] == [rows[10]["start"] - 700]


def test_steps_in_their_order(spark):
    x = np.random.default_rng(3).normal(size=400).cumsum()
    df = trace(spark, x).withColumn("fs", F.lit(1000.0))
    df = df if "t" in df.columns else df.withColumn("t", F.col("idx").cast("double"))
    assert analysis.transformed(df, "v", []).count() == 400
    halves = analysis.transformed(df, "v", [("downsample", 4)]).orderBy("idx").collect()
    assert np.allclose([r["v"] for r in halves], x.reshape(-1, 4).mean(1)) and {r["fs"] for r in halves} == {250.0}
    a = [r["v"] for r in analysis.transformed(df, "v", [("downsample", 2), ("lowpass", 40.0, 5)]).orderBy("idx").collect()]
    b = [r["v"] for r in analysis.transformed(df, "v", [("lowpass", 40.0, 5), ("downsample", 2)]).orderBy("idx").collect()]
    assert len(a) == len(b) == 200 and not np.allclose(a, b)
    with pytest.raises(ValueError):
        analysis.transformed(df, "v", [("median", 3)])


def test_corrected_units(spark):
    rows = [("a", i, 100.0 + i % 3, float(i % 3), 100.0) for i in range(9)] + [("b", i, float(i % 3), float(i % 3), 100.0) for i in range(9)] + [("c", 0, None, None, None)]
    df = spark.createDataFrame(rows, "trace_id string, idx long, v double, r double, b double")
    got = {(r["trace_id"], r["idx"]): r["o"] for r in signals.corrected_units(df, "v", "r", "b", "o").collect()}
    assert len(got) == 19 and got[("c", 0)] is None
    assert all(got[(k, i)] == i % 3 for k in "ab" for i in range(9))


def test_tiles_settle_after_their_frame(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(16, 16))
    frames = []
    for i in range(8):
        f = base + 0.01 * rng.normal(size=(16, 16))
        if i == 5:
            f[:8, :8] = np.roll(base[:8, :8], (1, 0), (0, 1))
        frames.append(("s", i, 16, 16, f.ravel().tolist()))
    frames.append(("none", 0, 16, 16, base.ravel().tolist()))
    df = spark.createDataFrame(frames, "stack string, frame long, height int, width int, pixels array<double>")
    boxes = spark.createDataFrame([("s", r * 2 + c + 1, c * 8, r * 8, c * 8 + 8, r * 8 + 8) for r in (0, 1) for c in (0, 1)], "stack string, roi long, x0 long, y0 long, x1 long, y1 long")
    out = images.residual_moved(df, boxes, 2, 1)
    assert out.count() == 9
    shifts = {(r["frame"], r["roi"]): (r["dy"], r["dx"]) for r in images.residual_shifts(out).collect()}
    assert len(shifts) == 32 and shifts[(5, 1)] == (-1, 0)
    assert all(v == (0, 0) for k, v in shifts.items() if k != (5, 1))
    got = np.array(next(r["pixels"] for r in out.collect() if r["stack"] == "s" and r["frame"] == 5)).reshape(16, 16)
    assert np.allclose(got[:7, :8], base[:7, :8], atol=0.1)


def test_panel_channels(spark):
    rows = [("a", 0, 1.0, 5.0), ("a", 1, 3.0, None), ("b", 0, 2.0, None), ("c", 0, None, None)]
    df = spark.createDataFrame(rows, "trace_id string, idx long, raw double, corrected double")
    got = {(r["trace_id"], r["idx"]): (r["channel"], r["value"]) for r in signals.panel_channel(df, ["corrected", "raw"]).collect()}
    assert got == {("a", 0): ("corrected", 5.0), ("a", 1): ("corrected", None), ("b", 0): ("raw", 2.0), ("c", 0): (None, None)}


def test_missing_pixels_rounds_and_empty_stacks(spark):
    rng = np.random.default_rng(8)
    base = rng.normal(size=(16, 16))
    moves = [(0, 0)] * 6 + [(1, 0), (0, -1)]
    frames = [np.roll(base, m, (0, 1)) for m in moves]
    frames[6][3, 3] = np.nan
    for f in frames:
        f[12, 12] = np.nan  # no frame has this pixel
    rows = [("s", i, 16, 16, f.ravel().tolist()) for i, f in enumerate(frames)] + [("blank", 0, 16, 16, [None] * 256)]
    df = spark.createDataFrame(rows, "stack string, frame long, height int, width int, pixels array<double>")
    for rounds in (1, 2):
        got = {(r["stack"], r["frame"]): (r["dy"], r["dx"]) for r in images.motion_shifts(df, 2, rounds=rounds).collect()}
        assert got == {("s", i): (-y, -x) for i, (y, x) in enumerate(moves)} | {("blank", 0): (0, 0)}
    boxes = spark.createDataFrame([("s", 1, 0, 0, 8, 8)], "stack string, roi long, x0 long, y0 long, x1 long, y1 long")
    out = images.residual_moved(df, boxes.limit(0), 2, 1)
    assert out.count() == 9 and images.residual_shifts(out).count() == 0
    assert images.residual_moved(df.limit(0), boxes, 2, 1).count() == 0
