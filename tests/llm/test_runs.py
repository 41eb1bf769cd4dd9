import random

from traceloom.llm import runs
from pyspark.sql import functions as F


def brute(events, gap=1):
    out = []
    for entity in {e[0] for e in events if e[0] is not None}:
        run = None
        for pos, kind in sorted({(p, k) for e, p, k in events if e == entity and p is not None}, key=lambda x: (x[0], x[1] or "\0")):
            if run and kind is not None and run[0] == kind and pos - run[2] <= gap:
                run[2], run[3] = pos, run[3] + 1
                continue
            if run and run[0] is not None:
                out.append((entity, *run))
            run = [kind, pos, pos, 1]
        if run and run[0] is not None:
            out.append((entity, *run))
    return sorted(out)


def test_random_runs_cut_into_stretches(spark):
    rng = random.Random(2)
    events = [(e, p, rng.choice("aaab")) for e in "xy" for p in range(200) if rng.random() < 0.9]
    events = [(e, p, None if rng.random() < 0.03 else k) for e, p, k in events] + [("x", None, "a"), (None, 1, "a")]
    events += events[:30]
    df = spark.createDataFrame(events, "entity string, pos long, kind string").withColumn("stretch", F.lit(1))
    for stretch in (8, 50, 8192):
        for gap in (1, 3):
            got = sorted(map(tuple, runs.collapse_runs(df, gap, stretch).select("entity", "kind", "first_pos", "last_pos", "n").collect()))
            assert got == brute(events, gap), (stretch, gap)


def test_spellings(spark):
    states = {"Accepted ": "accepted", "accpeted": "accepted", "state: held": "held", "heldd": "held", "in-valid": "invalid", "re-scued": "rescued", "\theld": "held", "zzzzzz": None, "": None, None: None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in states], "s string").select("s", runs.clean_state(F.col("s"))).collect()}
    assert got == states
    labels = ["ROI01_mask10", "roi01_mask10", "Roi 01_mask10", "ROI1_mask10", "ROI01-Mask10", " ROI01 mask10"]
    got = {r[0] for r in spark.createDataFrame([(x,) for x in labels], "s string").select(runs.clean_label(F.col("s"))).collect()}
    assert got == {"roi1mask10"}


def test_empty(spark):
    assert runs.collapse_runs(spark.createDataFrame([], "entity string, pos long, kind string")).count() == 0


def test_slips_in_labels_dont_end_a_run_but_numbers_do(spark):
    kinds = ["held|roi1mask1", "held|roi1mask1", "held|rol1mask1", "held|roi1msk1", "held|roi1mask2", "held|roi1mask2", "accepted|roi1mask2"]
    df = spark.createDataFrame([("e", i, k) for i, k in enumerate(kinds)], "entity string, pos long, kind string")
    for stretch in (2, 3, 100):
        got = sorted((r["first_pos"], r["last_pos"], r["kind"], r["n"]) for r in runs.collapse_runs(df, 1, stretch).collect())
        assert got == [(0, 3, kinds[0], 4), (4, 5, kinds[4], 2), (6, 6, kinds[6], 1)]


def test_the_anchor_decides_not_the_event_before():
    assert runs.alike("held|abcdefgh1", "held|abcdefxy1") and runs.alike("held|abcdefxy1", "held|abcdzzxy1")
    assert not runs.alike("held|abcdefgh1", "held|abcdzzxy1") and not runs.alike("a|x1", "a|y1") and not runs.alike("\0", "held|x")
