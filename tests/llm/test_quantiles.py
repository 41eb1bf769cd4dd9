import numpy as np

from traceloom.llm import quantiles as Q


def true_rank_error(values, asked, at):
    values = np.sort(values)
    out = 0.0
    for q, v in zip(at, asked):
        target = max(np.ceil(q * len(values)), 1)
        lo, hi = np.searchsorted(values, v, "left") + 1, np.searchsorted(values, v, "right")
        out = max(out, lo - target, target - hi)
    return out


def test_bound_holds_in_any_order_of_merging():
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.lognormal(size=40_000), np.full(5_000, 1.0), np.sort(rng.normal(size=5_000))])
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    parts = [(0.0, [1], [np.sort(p)]) for p in np.array_split(values, 37)]
    tree = [Q.merge_summaries(parts[i : i + 5], 128) for i in range(0, 37, 5)]
    n, error, weights, buffers = Q.merge_summaries([t[1:] for t in tree], 128)
    assert n == len(values) and sum(w * len(b) for w, b in zip(weights, buffers)) == n
    assert true_rank_error(values, Q.quantiles_of(weights, buffers, at), at) <= error < 0.06 * n
    assert sum(len(b) for b in buffers) < 128 * 12


def test_small_groups_are_exact(spark):
    rows = [("t", i, float(v)) for i, v in enumerate([5, 1, 4, 2, 3])] + [("t", 9, None), ("t", 10, float("nan")), ("t", 11, float("inf")), (None, 1, 7.0), ("u", 1, float("-inf"))]
    df = spark.createDataFrame(rows, "k string, pos long, value double")
    got = {r["k"]: (r["n"], r["rank_error"], r["value"]) for r in Q.read_off(Q.summarise(df, ["k"]), ["k"], [0.5]).collect()}
    assert got == {"t": (5, 0.0, 3.0), None: (1, 0.0, 7.0)}


def test_large_group_over_chunks(spark):
    n = 200_000
    df = spark.range(n).selectExpr("'t' k", "id pos", "cast(pmod(id * 7919, 200000) as double) value", "pmod(id, 3) day")
    daily = Q.summarise(df, ["k", "day"])
    for summaries in (Q.summarise(df, ["k"]), Q.combine(daily, ["k"])):
        for r in Q.read_off(summaries, ["k"], [0.1, 0.5, 0.999]).collect():
            assert r["n"] == n and abs(r["value"] + 1 - np.ceil(r["q"] * n)) <= r["rank_error"] < 0.01 * n


def test_empty(spark):
    assert Q.summarise(spark.createDataFrame([], "k string, pos long, value double"), ["k"]).count() == 0


def test_hot_group_with_and_without_positions_is_collapsed(spark, monkeypatch):
    monkeypatch.setattr(Q, "CHUNK", 500)
    monkeypatch.setattr(Q, "FAN_IN", 4)
    monkeypatch.setattr(Q, "LOOSE", 32)
    n = 30_000
    df = spark.range(n).selectExpr("if(id % 50 = 0, concat('k', id), 'hot') k", "if(id % 3 = 0, null, id) pos", "cast(pmod(id * 7919, 30011) as double) value")
    hot = np.sort(df.where("k = 'hot'").toPandas()["value"].to_numpy())
    rows = Q.summarise(df, ["k"], k=32).collect()
    assert len(rows) == n // 50 + 1
    at = [0.0, 0.1, 0.5, 0.99, 1.0]
    top = next(r for r in rows if r["k"] == "hot")
    assert top["n"] == len(hot) and max(map(len, top["buffers"])) <= 32 and max(top["weights"]) > 100
    assert true_rank_error(hot, Q.quantiles_of(top["weights"], [np.array(b) for b in top["buffers"]], at), at) <= top["rank_error"] < 0.3 * len(hot)


def test_many_metrics_and_repeated_keys(spark):
    nan = float("nan")
    df = spark.createDataFrame([(None, 1, 1.0, nan), (None, 2, 2.0, 5.0), ("a", None, 3.0, None), ("a", None, 3.0, None)], "k string, pos long, x double, y double")
    got = {(r["k"], r["metric"]): (r["n"], r["buffers"]) for r in Q.summarise(df, ["k"], ["x", "y"]).collect()}
    assert got == {(None, "x"): (2, [[1.0, 2.0]]), (None, "y"): (1, [[5.0]]), ("a", "x"): (2, [[3.0, 3.0]])}
