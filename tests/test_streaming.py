from traceloom.streaming import incremental


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_roi_means(spark, tmp_path):
    spark.createDataFrame([(1, 1, [float(i) for i in range(16)])], "stack long, frame long, pixels array<double>").write.parquet(str(tmp_path / "f"))
    stream = spark.readStream.schema("stack long, frame long, pixels array<double>").parquet(str(tmp_path / "f"))
    got = {r["roi"]: r["value"] for r in run(incremental.roi_means(stream, 2, 4), "means")}
    assert got == {1: 2.5, 2: 4.5, 3: 10.5, 4: 12.5}


def test_tracker(spark, tmp_path):
    rows = [("m", i, k) for i, k in enumerate("aaabbba")] + [("m", 9, "a")]
    spark.createDataFrame(rows, "entity string, pos long, kind string").coalesce(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("entity string, pos long, kind string").parquet(str(tmp_path / "e"))
    got = sorted((r["kind"], r["first_pos"], r["last_pos"], r["n"]) for r in run(incremental.run_tracker(stream), "runs"))
    assert got == [("a", 0, 2, 3), ("a", 6, 6, 1), ("b", 3, 5, 3)]


def test_frozen_threshold(spark, tmp_path):
    spark.createDataFrame([("t", 1.0), ("t", 9.0)], "trace_id string, value double").write.parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema("trace_id string, value double").parquet(str(tmp_path / "s"))
    levels = spark.createDataFrame([("t", 5.0)], "trace_id string, threshold double")
    assert [r["value"] for r in run(incremental.frozen_threshold_spikes(stream, levels), "over")] == [9.0]
