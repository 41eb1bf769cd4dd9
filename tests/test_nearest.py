import numpy as np

from traceloom.operators import detection


def test_nearest_sample_however_far(spark):
    rng = np.random.default_rng(3)
    t = {"a": np.round(np.r_[rng.uniform(0, 50, 150), rng.uniform(900, 950, 50), [4e8]], 1), "b": np.array([7.0]), "c": np.array([2.0, 2.0, 4.0])}
    samples = [(k, i, float(x)) for k, v in t.items() for i, x in enumerate(v)] + [("a", 500, None), ("n", 0, None)]
    at = {"a": np.round(np.r_[rng.uniform(-100, 1100, 80), [-1e6, 1e9, 475.0]], 1), "b": np.array([-3.0, 7.0, 1e5]), "c": np.array([3.0, 2.0, 9.0])}
    wanted = [(k, float(x)) for k, v in at.items() for x in v] + [("n", 1.0), ("none", 1.0)]
    df, want = spark.createDataFrame(samples, "trace_id string, idx long, t double"), spark.createDataFrame(wanted, "trace_id string, at double")
    best = {(k, float(x)): min(range(len(t[k])), key=lambda i: (abs(t[k][i] - x), t[k][i], i)) for k, v in at.items() for x in v}
    for piece in (16, 65_536):
        got = {(r["trace_id"], r["at"]): r["idx"] for r in detection.nearest_sample(df, want, piece).collect()}
        assert got == best | {("n", 1.0): None, ("none", 1.0): None}
