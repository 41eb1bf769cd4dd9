import random

from traceloom.operators.intervals import periods_and_gaps, spans_from_ms
from traceloom.operators.ordered import bucketed_lag
from pyspark.sql import functions as F


def brute(spans):
    out = []
    for k in {s[0] for s in spans}:
        merged = []
        for _, s, e in sorted(x for x in spans if x[0] == k):
            if merged and s <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], e)
            else:
                merged.append([s, e])
        out += [(k, "period", s, e) for s, e in merged]
        out += [(k, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


def test_random_intervals_in_small_buckets(spark):
    rng = random.Random(3)
    spans = [(rng.choice("ab"), s, s + rng.choice((1, 3, 10, 400))) for s in (rng.randrange(-500, 3000) for _ in range(300))]
    spans += spans[:20]
    df = spark.createDataFrame(spans, "entity string, s long, e long")
    for bucket in (7, 100, 10_000_000):
        assert sorted(map(tuple, periods_and_gaps(df, bucket).collect())) == brute(spans)


def test_dirty_times_and_clashing_columns(spark):
    nan, inf = float("nan"), float("inf")
    rows = [("t", 1.0, 2.0, 5), ("t", 2.0, 3.0, 5), ("t", None, 9.0, 5), ("t", nan, 9.0, 5), ("t", 4.0, inf, 5), ("t", 6.0, 5.0, 5), ("t", 7.0, 7.0, 5), (None, 1.0, 1.5, 5), ("t", 1e300, 2e300, 5)]
    df = spark.createDataFrame(rows, "entity string, start double, end double, bucket int")
    got = sorted(map(tuple, periods_and_gaps(spans_from_ms(df, "entity", "start", "end")).collect()), key=str)
    assert got == [("t", "period", 1000, 3000), (None, "period", 1000, 1500)] or got == [(None, "period", 1000, 1500), ("t", "period", 1000, 3000)]


def test_empty(spark):
    assert periods_and_gaps(spark.createDataFrame([], "entity string, s long, e long")).count() == 0


def test_lag_across_buckets(spark):
    df = spark.createDataFrame([("k", i, f"v{i}") for i in range(50)] + [(None, 3, "x"), (None, 40, "y")], "k string, i long, v string")
    got = {(r["k"], r["i"]): r["before"] for r in bucketed_lag(df, ["k"], F.floor(F.col("i") / 7), ["i"], "v", "before").collect()}
    assert got["k", 0] is None and all(got["k", i] == f"v{i - 1}" for i in range(1, 50))
    assert got[None, 3] is None and got[None, 40] == "x"
