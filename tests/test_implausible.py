import numpy as np

from traceloom.functions.isolation import isolation_scores
from traceloom.operators import implausible as I


def course(n, seed=0):
    rng = np.random.default_rng(seed)
    x = 100 + np.cumsum(rng.normal(0, 0.02, n)) + rng.normal(0, 0.3, n)
    for at in range(40, n - 20, 120):
        x[at : at + 12] += np.array([2, 4, 6, 5, 4, 3.5, 3, 2.5, 2, 1.5, 1, 0.5])
    return x


def test_spikes_frozen_and_events():
    x = course(600)
    x[100], x[101], x[300] = 300.0, 310.0, -100.0
    x[400:430] = x[400]
    out = I.judge(np.arange(600), x)
    assert set(out.loc[out.spike, "pos"]) == {100, 101, 300}
    assert set(out.loc[out.frozen, "pos"]) == set(range(400, 430))


def test_many_sources_at_once_and_short_ones():
    a, b = course(200, 1), course(150, 2)
    b[70] = 1e6
    pos = np.r_[np.arange(200), np.arange(150), [5, 6]]
    out = I.judge(pos, np.r_[a, b, [1.0, 9.0]], np.array([0, 200, 350]))
    assert out.loc[out.spike, "row"].tolist() == [270] and not out.score[-2:].any()


def test_rows_across_pieces(spark):
    n = I.PIECE + 300
    x = course(n, 3)
    x[I.PIECE - 1] = x[I.PIECE] = -9999.0
    x[50:100] = 7.0
    rows = [("t", "k", i, float(v)) for i, v in enumerate(x)]
    rows += rows[:10] + [("t", "k", n, None), ("t", "k", n + 1, float("nan")), ("t", "k", n + 2, float("inf")), ("t", None, 1, 1.0), ("t", "k", None, 1.0)]
    scored = I.score_readings(spark.createDataFrame(rows, "table_name string, series_key string, pos long, value double")).toPandas()
    assert len(scored) == n and scored.pos.is_unique
    assert set(scored.loc[scored.spike, "pos"]) == {I.PIECE - 1, I.PIECE} and set(scored.loc[scored.frozen, "pos"]) == set(range(50, 100))


def test_empty(spark):
    assert I.score_readings(spark.createDataFrame([], "table_name string, series_key string, pos long, value double")).count() == 0


def test_scores_are_the_same_again():
    x = np.random.default_rng(1).normal(size=(300, 3))
    x[7] = 40
    s = isolation_scores(x, np.array([0]))
    assert s.argmax() == 7 and (s == isolation_scores(x, np.array([0]))).all()


def test_a_source_scores_the_same_in_any_batch():
    x = np.random.default_rng(2).normal(size=(900, 3))
    starts, seeds = np.array([0, 300, 320, 500]), np.array([3, 9, 4, 5])
    together = isolation_scores(x, starts, seeds=seeds)
    for a, b, k in zip(starts, np.r_[starts[1:], 900], seeds):
        assert (isolation_scores(x[a:b], np.array([0]), seeds=np.array([k])) == together[a:b]).all()


def test_few_readings_are_all_drawn():
    # without replacement every tree of a small source holds all its readings: equal ones can't be told apart
    x = np.r_[np.zeros(40), 1.0][:, None]
    s = isolation_scores(x, np.array([0]))
    one = 2.0 ** (-1 / (2 * (np.log(40) + 0.5772156649) - 2 * 40 / 41))
    assert np.isclose(s[-1], one, atol=1e-5) and np.ptp(s[:-1]) == 0


def test_the_gate_keeps_ordinary_readings_out():
    out = I.judge(np.arange(4000), course(4000, 5))
    assert (out.score < I.ISOLATED).mean() > 0.8


def test_physical_range_holds_for_short_sources():
    out = I.judge(np.arange(3), np.array([1.0, -9999.0, 4294967295.0]))
    assert out.out_of_range.tolist() == [False, True, True] and not out.spike.any()
