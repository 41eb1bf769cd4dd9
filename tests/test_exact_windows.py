"""Windows and triggers along traces with gaps, sparse positions and pieces of any size, beside the same over whole arrays."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from traceloom.functions.peaks import schmitt
from traceloom.operators import detection, masks, ordered, signals


def sparse(spark, values, step=10, hole=None, name="t"):
    at = np.arange(len(values)) * step
    if hole:
        at[hole:] += 50_000
    return spark.createDataFrame([(name, int(i), float(v)) for i, v in zip(at, values)], "trace_id string, idx long, v double"), at


@pytest.mark.parametrize("half", [3, 40, 700])
@pytest.mark.parametrize("edges", ["nearest", "reflect"])
def test_rolling_rank_counts_rows(spark, monkeypatch, half, edges):
    monkeypatch.setattr(signals, "PIECE", 300)
    x = np.random.default_rng(half).normal(size=2000).round(3)
    rows, at = sparse(spark, x, 10, 777)
    got = {r["idx"]: r["y"] for r in signals.rolling_rank(rows, "v", half, "y", 20.0, edges).collect()}
    wide = np.pad(x, half, mode="edge" if edges == "nearest" else "reflect")
    windows = np.sort(np.lib.stride_tricks.sliding_window_view(wide, 2 * half + 1), axis=1)
    want = windows[:, int((2 * half + 1) * 0.2)]
    assert got == dict(zip(at.tolist(), want.tolist()))


def test_rolling_rank_with_each_traces_own_width(spark, monkeypatch):
    monkeypatch.setattr(signals, "PIECE", 64)
    x = np.random.default_rng(1).normal(size=300)
    a, _ = sparse(spark, x, 1, name="a")
    b, _ = sparse(spark, x, 1, name="b")
    rows = a.withColumn("h", F.lit(5)).unionByName(b.withColumn("h", F.lit(90)))
    got = {(r["trace_id"], r["idx"]): r["y"] for r in signals.rolling_rank(rows, "v", F.col("h"), "y").collect()}
    for name, half in (("a", 5), ("b", 90)):
        want = np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, half, mode="edge"), 2 * half + 1), axis=1)
        assert [got[name, i] for i in range(300)] == want.tolist()


@pytest.mark.parametrize("lag", [1, 5, -3])
def test_lags_over_gaps(spark, monkeypatch, lag):
    monkeypatch.setattr(signals, "PIECE", 100)
    x = np.arange(500.0)
    rows, at = sparse(spark, x, 7, 123)
    got = {r["idx"]: r["y"] for r in signals.lagged(rows, "v", lag, "y").collect()}
    want = [x[i - lag] if 0 <= i - lag < 500 else None for i in range(500)]
    assert [got[int(i)] for i in at] == want


def test_lag_keeps_nulls(spark):
    rows = spark.createDataFrame([("t", 0, 1.0), ("t", 20_000, None), ("t", 40_000, 3.0)], "trace_id string, idx long, v double")
    assert [r["y"] for r in signals.lagged(rows, "v", 1, "y").orderBy("idx").collect()] == [None, 1.0, None]


def test_filter_doesnt_see_pieces(spark, monkeypatch):
    x = np.cumsum(np.random.default_rng(4).normal(size=6000))
    rows, _ = sparse(spark, x, 1)
    rows = rows.withColumn("fs", F.lit(1000.0))
    whole = {r["idx"]: r["y"] for r in detection.filtered(rows, "v", "fs", 120.0, 5, False, "y").collect()}
    monkeypatch.setattr(detection, "PIECE", 500)
    monkeypatch.setattr(detection, "HALO", 500)
    cut = {r["idx"]: r["y"] for r in detection.filtered(rows, "v", "fs", 120.0, 5, False, "y").collect()}
    assert len(cut) == 6000 and max(abs(whole[i] - cut[i]) for i in range(1000, 5000)) < 1e-6


def test_trigger_over_many_pieces(spark, monkeypatch):
    monkeypatch.setattr(detection, "PIECE", 256)
    monkeypatch.setattr(masks, "PIECE", 256)
    rng = np.random.default_rng(7)
    x = np.concatenate([np.zeros(300), np.full(3000, 3.0), rng.uniform(0, 6, 900), np.zeros(200), np.full(40, 6.0)])
    x[300:320] = 6.0
    rows = spark.createDataFrame([("t", i, float(v), 5.0, 2.0) for i, v in enumerate(x)], "trace_id string, idx long, v double, hi double, lo double")
    got = sorted((r["start"], r["end"]) for r in detection.triggered_regions(rows, "v", "hi", "lo", 10, 5).collect())
    on = np.flatnonzero(np.diff(np.r_[0, schmitt(x, np.full(len(x), 5.0), np.full(len(x), 2.0), 10, 5).astype(int), 0]))
    assert got == [(int(a), int(b)) for a, b in on.reshape(-1, 2)] and got[0][1] > 3300


def test_carried_over_levels(spark):
    rng = np.random.default_rng(3)
    rows = [(k, int(b), None if rng.random() < 0.5 else int(rng.integers(100))) for k in ("a", None) for b in sorted(rng.choice(5000, 300, replace=False))]
    df = spark.createDataFrame(rows, "k string, b long, v long")
    for how, later, put in (("max", False, lambda v: max(v, default=None)), ("sum", False, sum), ("nearest", False, lambda v: v[-1] if v else None), ("nearest", True, lambda v: v[0] if v else None)):
        got = {(r["k"], r["b"]): r["o"] for r in ordered.carried(df, ["k"], "b", "v", "o", how, later, fan=40).collect()}
        for k, b, _ in rows:
            past = [v for k2, b2, v in rows if k2 == k and (b2 > b if later else b2 < b) and v is not None]
            assert got[k, b] == put(past)
