from math import erfc, log

import numpy as np
from pyspark.sql import functions as F

from tests.test_signals import trace
from traceloom.operators import detection, signals, templates

SHAPE = np.array([0.2, 0.6, 1.0, 0.8, 0.5, 0.3, 0.2, 0.1])
AT = [150, 320, 470, 640, 810, 1000, 1180, 1350]


def spiky(sign=1.0, n=1500, seed=0):
    x = 0.05 * np.random.default_rng(seed).normal(size=n)
    for at in AT:
        x[at - 2 : at + 6] += sign * 2 * SHAPE
    return x


def found(spark, x, picks, **how):
    df = trace(spark, x).withColumn("fs", F.lit(1000.0))
    out = templates.template_spikes(df, "v", spark.createDataFrame([("t", p) for p in picks], "trace_id string, idx long"), **how)
    return sorted(r["spike_index"] for r in out.collect())


def test_logarithm_of_the_normal_distribution():
    z = np.array([-8.0, -2.0, -0.5, 0.0, 1.0, 3.0])
    assert np.allclose(templates.log_normal_cdf(z), [log(0.5 * erfc(-v / 2**0.5)) for v in z], rtol=1e-5)


def test_examples_find_their_like_up_and_down(spark):
    assert found(spark, spiky(), [150, 470]) == AT
    assert found(spark, spiky(-1.0), [320]) == AT


def test_no_examples_and_noise(spark):
    assert found(spark, spiky(), []) == []
    assert found(spark, spiky(), [], autopick=True) == AT
    noise = 0.05 * np.random.default_rng(5).normal(size=1500)
    noise[700:708] += 2 * SHAPE
    assert found(spark, noise, [702]) == [702]


def test_blocked_samples_and_pieces(spark, monkeypatch):
    assert found(spark, spiky(), [150], blocked=F.col("idx").between(600, 700)) == [a for a in AT if a != 640]
    monkeypatch.setattr(templates, "PIECE", 200)
    monkeypatch.setattr(detection, "PIECE", 300)
    monkeypatch.setattr(detection, "HALO", 300)
    assert found(spark, spiky(), [150, 470]) == AT
