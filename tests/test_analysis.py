import numpy as np
from tests.test_signals import trace
from traceloom.operators import analysis


def rates(spark, fs=1000.0):
    return spark.createDataFrame([("t", fs)], "trace_id string, fs double")


def test_impulses_go_and_flat_tops_stay(spark):
    x = 0.1 * np.random.default_rng(1).normal(size=600)
    x[100:120] += np.concatenate([np.linspace(0, 9, 10), np.linspace(9, 0, 10)])
    x[300:340] += 5.0
    x[300:340] -= 0.99 * 0.1 * np.random.default_rng(1).normal(size=600)[300:340]
    x[400:520] += np.linspace(0, 9, 120)
    regions = spark.createDataFrame([("t", 100, 120), ("t", 300, 340), ("t", 400, 520)], "trace_id string, start long, end long")
    got = sorted((r["start"], r["end"]) for r in analysis.without_impulses(trace(spark, x), regions, "v", rates(spark)).collect())
    assert got == [(300, 340), (400, 520)]


def test_long_plateaus_are_joined_over_short_gaps_only(spark):
    cut = [(0, 150), (200, 400), (600, 640), (1000, 1200), (1250, 1280), (1300, 1500), (2000, 2140), (2261, 2500)]
    regions = spark.createDataFrame([("t", a, b) for a, b in cut], "trace_id string, start long, end long")
    got = sorted((r["start"], r["end"]) for r in analysis.rejoined(regions, rates(spark)).collect())
    assert got == [(0, 400), (600, 640), (1000, 1200), (1250, 1280), (1300, 1500), (2000, 2140), (2261, 2500)]
