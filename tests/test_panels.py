from traceloom.operators import images, signals


def test_panel_has_all_regions_up_to_the_shortest(spark):
    rows = [(f"r | ROI {k:02d}", i, float(10 * k + i)) for k in range(1, 7) for i in range(5 if k == 4 else 8)] + [("alone", 3, 1.0)]
    got = signals.aligned_panel(spark.createDataFrame(rows, "trace_id string, idx long, raw double"), "raw").collect()
    assert {(r["recording_id"], r["row_no"]): r["regions"] for r in got} == {("r", i): {f"ROI {k:02d}": 10.0 * k + i for k in range(1, 7)} for i in range(5)} | {("Ungrouped", 0): {"alone": 1.0}}


def test_signals_of_all_masks(spark):
    rows = [("s", 0, 0, True, 1.0), ("s", 5, 0, True, 6.0), ("s", 5, 1, False, 7.0)]
    got = images.tracked_signals(spark.createDataFrame(rows, "source_tiff string, mask_index long, frame long, tv boolean, sg double")).orderBy("frame").collect()
    assert [(r["mask_0"], r["mask_2"], r["mask_5"]) for r in got] == [(1.0, None, 6.0), (None, None, None)]
