from datetime import datetime

from traceloom.operators.clocks import clock_records, in_one_unit, off_milliseconds, sampling_rates, unit_named_in
from pyspark.sql import functions as F


def tables(spark, traces, spikes, frames, recordings):
    return (
        spark.createDataFrame(traces, "trace_id string, idx long, t double, owner int"),
        spark.createDataFrame(spikes, "trace_name string, spike_index long, spike_time double, notes string"),
        spark.createDataFrame(frames, "source_tiff string, frame long, time_ms double"),
        spark.createDataFrame(recordings, "recording_id string, source_tiff string, time_header string, sampling_rate_hz double, comment string, raw_fields map<string,string>"),
    )


def test_units_offsets_and_misleading_text(spark):
    factor = {"A": 1e-3, "B": 1.0, "C": 1e3, "D": 1 / 60000, "E": 1e6}
    rates = {"A": 500.0, "B": 1250.0, "C": 400.0, "D": 2500.0, "E": 625.0}
    traces = [(f"{r} | ROI 01", k, (k + 7) * 1000 / rates[r] * f, 0) for r, f in factor.items() for k in range(120)]
    traces += traces[:5] + [("A | ROI 01", 500, None, 0), ("A | ROI 01", 501, float("nan"), 0), ("Z | x", 0, 1.0, 0), (None, 1, 1.0, 0)]
    frames = [("a.tif", f, f * 2.0) for f in range(60)] + [("b.tif", f, float(f)) for f in range(60)]
    spikes = [("B | ROI 01", 30, (30 + 7) * 0.8 * 1000, "t in us"), ("B | ROI 01", 31, (31 + 7) * 0.8, "entered as seconds")]
    recordings = [(r, {"A": "a.tif", "B": "b.tif"}.get(r, f"{r}.tif"), "Time (ms)", None if r == "C" else rates[r], "x @ 0.4 kHz", {"Width": "1"}) for r in factor]
    t, s, f, rec = tables(spark, traces, spikes, frames, recordings)
    out = in_one_unit(clock_records(t, s, f), sampling_rates(rec))
    rows = {(r["table_name"], r["series_key"], r["pos"]): r for r in out.collect()}
    assert rows["trace_samples", "A | ROI 01", 10]["unit"] == "s" and rows["trace_samples", "A | ROI 01", 10]["time_us"] == 34_000
    assert rows["trace_samples", "C | ROI 01", 10]["time_us"] == 42_500
    assert {rows["trace_samples", f"{k} | ROI 01", 50]["unit"] for k in "D"} == {"min"} and rows["trace_samples", "E | ROI 01", 50]["unit"] == "ns"
    assert rows["signal_frames", "b.tif", 40]["unit"] == "sample" and rows["signal_frames", "b.tif", 40]["time_us"] == 32_000
    found = {(r["table_name"], r["series_key"], r["pos"]) for r in off_milliseconds(out).collect()}
    assert ("spikes", "B | ROI 01", 30) in found and ("spikes", "B | ROI 01", 31) not in found
    assert not any(k[1] in ("B | ROI 01", "a.tif") and k[0] != "spikes" for k in found)
    assert ("signal_frames", "b.tif", 0) not in found and ("signal_frames", "b.tif", 1) in found


def test_empty(spark):
    t, s, f, rec = tables(spark, [], [], [], [])
    assert off_milliseconds(in_one_unit(clock_records(t, s, f), sampling_rates(rec))).count() == 0


def test_words(spark):
    texts = {"Time (µs)": "us", "t_ns": "ns", "Zeit (Sek.)": "s", "elapsed [min]": "min", "time in milliseconds": "ms", "values in usec": "us", "x": None, "": None, "Timestamp": None}
    got = {r[0]: r[1] for r in spark.createDataFrame([(k,) for k in texts], "t string").select("t", unit_named_in(F.col("t"))).collect()}
    assert got == texts


def test_no_sort_and_no_interpreted_scores(spark):
    t, s, f, rec = tables(spark, [("A | x", k, k * 0.5, 0) for k in range(9)], [("A | x", 2, 1.0, "in s"), ("A | x", 2, 1.0, "in ms")], [], [("A", None, None, 2000.0, None, None)])
    out = in_one_unit(clock_records(t, s, f), sampling_rates(rec))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan and "lambdafunction" not in plan and "lambda " not in plan
    assert plan.count("array_max(") == 1
    found = {(r["table_name"], r["pos"]): (r["unit"], r["time_us"], r["on_clock"]) for r in out.collect()}
    assert len(found) == 10 and found["trace_samples", 3] == ("ms", 1500, True) and found["spikes", 2] == ("ms", 1000, True)


def test_equally_likely_units_and_notes_of_repeated_records(spark):
    # with a period of 1 ms a count of periods is the number of milliseconds; of equal units the last name counts
    t, s, f, rec = tables(spark, [("A | x", k, float(k), 0) for k in range(30)], [], [], [("A", None, None, 1000.0, None, None)])
    assert {(r["unit"], r["factor"], r["posterior"]) for r in in_one_unit(clock_records(t, s, f), sampling_rates(rec)).where("pos > 0").collect()} == {("sample", 1.0, 0.5)}
