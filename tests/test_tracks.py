import numpy as np
from pyspark.sql import functions as F

from traceloom.functions import scalars
from traceloom.operators import images


def followed(spark, frames, **how):
    df = spark.createDataFrame([(0, i, 10, 10, f.ravel().tolist()) for i, f in enumerate(frames)], "stack long, frame long, height int, width int, pixels array<double>")
    mask = spark.createDataFrame([(1, y, x, 1.0) for y in range(3, 7) for x in range(3, 7)], "mask long, y long, x long, w double")
    rows = images.tracked_masks(df, mask, 1, 2, **how).orderBy("frame").collect()
    return [(r["frame"], r["dy"], r["dx"], r["state"]) for r in rows]


def test_pieces_of_frames_follow_on_from_each_other(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(10, 10))
    base[3:7, 3:7] += np.add.outer(np.arange(4), np.arange(4))
    where = [(0, 0), (1, 0), (1, 1), (2, 2), (-2, -2), (-2, -1), (-1, 0), (0, 0), (0, 1), (2, 1), (1, 1), (0, 0)]
    frames = [np.roll(base, s, (0, 1)) + 0.05 * rng.normal(size=(10, 10)) for s in where]
    frames[6] = rng.normal(size=(10, 10))
    whole = followed(spark, frames, least_score=0.8)
    assert {s for *_, s in whole} == {"accepted", "rescued", "held"} and len(whole) == 12
    monkeypatch.setattr(images, "FRAMES", 2)
    assert followed(spark, frames, least_score=0.8) == whole


def test_numbers_on_scales(spark):
    shown = {1000.0: "1000", 2.5: "2.5", 0.05: "0.05", 0.5: "0.5", 1e-5: "1e-05", -0.25: "-0.25", 0.126: "0.13", 12.34: "12.3", 0.0996: "0.1"}
    got = {r[0]: r[1] for r in spark.createDataFrame([(v,) for v in shown], "v double").select("v", scalars.shown_number(F.col("v"))).collect()}
    assert got == shown
    labels = {0.5: "500 ms", 2.0: "2 s", 0.002: "2 ms"}
    assert {r[0]: r[1] for r in spark.createDataFrame([(v,) for v in labels], "v double").select("v", scalars.time_label(F.col("v"))).collect()} == labels


def test_small_rules(spark):
    one = spark.range(1)
    picked = one.select(
        scalars.parabola_vertex(F.lit(1.0), F.lit(2.0), F.lit(1.5)).alias("vertex"),
        scalars.signed_shift(F.lit(7), F.lit(8)).alias("shift"),
        scalars.background_mode(F.lit(" Local ")).alias("mode"),
        scalars.report_number(F.lit(float("nan"))).alias("none"),
        scalars.report_number(F.lit(123.456)).alias("some"),
        scalars.recording_of(F.lit("A|B")).alias("rec"),
        scalars.roi_of(F.lit("A|B")).alias("roi"),
        scalars.roi_of(F.lit("A | B | C")).alias("deep"),
        scalars.short_label(F.lit("abcdefgh"), 5).alias("short"),
    ).first()
    assert abs(picked["vertex"] - 1 / 6) < 1e-9 and picked["shift"] == -1 and picked["mode"] == "parent_tile"
    assert (picked["none"], picked["some"], picked["rec"], picked["roi"], picked["deep"], picked["short"]) == ("", "123.5", "Ungrouped", "A|B", "B | C", "abcd...")
